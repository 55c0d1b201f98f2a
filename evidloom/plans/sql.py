"""Pieces of the equivalent DuckDB SQL, put together from common table expressions."""
from __future__ import annotations

from evidloom.functions.text import SPACE, WORD, quote


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    """Inline table; lists become DuckDB lists."""

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(cell(x) for x in v) + "]" + ("" if v else "::VARCHAR[]")
        return lit(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS _v({', '.join(names)})"


def query(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + final


def whole_word_re2(term: str) -> str:
    edge = WORD.replace("[", "[^", 1)
    return f"(^|{edge}){quote(term)}($|{edge})"


def has_word(low: str, term: str) -> str:
    return f"regexp_matches({low}, {lit(whole_word_re2(term))})"


def normalized(text: str) -> str:
    return f"trim(regexp_replace({text}, {lit(SPACE + '+')}, ' ', 'g'))"


def sentence_array(text: str) -> str:
    marked = f"regexp_replace({normalized(text)}, '([.!?]) +', '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"
