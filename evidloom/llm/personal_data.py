"""Personal data in texts: patterns propose, checksums confirm, words near by adjust the score.

Base spans (email, ip, card, phone) follow fixed patterns and checks. The operator adds account numbers that pass the
mod-97 check, and scores every span: a start value for its kind, more after a confirmed checksum, more or less by the
context words around it. Texts are scanned whole, in Arrow batches, without a shuffle.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from evidloom.llm.columns import carried
from evidloom.llm.workers import in_arrow, slices
from evidloom.shipping import ship_by_value

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from every digit, so only first digits are tried
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KINDS = ["email", "ip", "card", "phone", "iban"]
START = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: characters around a span that are searched for context words
REACH = 40
#: whole words near a span that speak for it and against it: English, German, French, Spanish
FOR = {"email": {"mail", "email", "contact", "write", "kontakt", "courriel", "correo", "contacto"},
       "ip": {"ip", "address", "host", "server", "adresse", "serveur", "servidor"},
       "card": {"card", "visa", "credit", "payment", "karte", "kreditkarte", "carte", "tarjeta"},
       "phone": {"call", "phone", "tel", "telephone", "mobile", "fax", "telefon", "handy", "téléphone", "teléfono"},
       "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"}}
AGAINST = {"email": {"example", "beispiel", "exemple", "ejemplo"}, "ip": {"version", "release", "section"},
           "card": {"isbn", "order", "serial"}, "phone": {"order", "total"}, "iban": {"example", "beispiel", "exemple", "ejemplo"}}
WORDS = re.compile(r"[^\W\d_]+")
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
                   StructField("score", DoubleType())])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """As finditer, but looks only at the run of name characters before each @ sign: linear in long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        m = EMAIL.match(text, low) if low < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind and start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    return [("iban", m.start(), m.end()) for m in IBAN.finditer(text)
            if 15 <= len(m.group().replace(" ", "")) <= 34 and mod97(m.group().replace(" ", ""))]


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORDS.findall(f"{text[max(0, start - REACH):start]} {text[end:end + REACH]}".lower()))
    value = START[kind] + (0.1 if kind in ("card", "iban") else 0)
    value += 0.2 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST[kind])
    return round(min(1.0, max(0.0, value)), 3)


def with_personal_data(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``personal_data``: all spans (kind, start, end, score) of every whole text, by kind, then start.

    Null and empty texts have no spans; rows are taken one by one, so keys may be null or repeated; a column named
    ``personal_data`` is replaced.
    """
    source = carried(df, ["personal_data"], F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([source.schema["row"]]).add("personal_data", ArrayType(SPAN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    found.append([{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)}
                                  for k, a, b in base_spans(t) + added_spans(t)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], schema.fieldNames())

    return in_arrow(source, run, schema).select("row.*", "personal_data")


ship_by_value(__name__)
