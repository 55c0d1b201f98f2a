"""Column expressions for text preparation."""
from __future__ import annotations

import re
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidloom.fixed_values import CONTROL_MARKER, DROPPED_HTML_TAGS

# White space and word characters as explicit classes, since `\s`, `\w` and `\b` differ between regex engines.
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
# Runs of white space other than one blank, which most texts are full of and which stays as it is. The ranges before && are
# two quick tests that all other ASCII characters fail.
_GUARD = r"[\x00-\x20\x{85}-\x{3000}&&"
UNEVEN_SPACE = f"{_GUARD}{SPACE.replace(' ', '')}]{_GUARD}{SPACE}]*| {_GUARD}{SPACE}]+"
_QUOTE = re.compile(r"([^\w\s])")


def quote(term: str) -> str:
    """Regex for the literal text of a term, valid for Java and RE2."""
    return _QUOTE.sub(r"\\\1", term)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def whole_word(term: str) -> str:
    """Regex for a term with a word boundary on both sides."""
    left = "(?<!" if _is_word(term[0]) else "(?<="
    right = "(?!" if _is_word(term[-1]) else "(?="
    return f"{left}{WORD}){quote(term)}{right}{WORD})"


def any_whole_word(terms: list[str]) -> str:
    """Regex for any of the terms; terms with the same kinds of edge share their boundary tests."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for t in terms:
        groups.setdefault((_is_word(t[0]), _is_word(t[-1])), []).append(quote(t))
    return "|".join(
        f"(?<{'!' if left else '='}{WORD})(?:{'|'.join(quoted)})(?{'!' if right else '='}{WORD})"
        for (left, right), quoted in groups.items())


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNEVEN_SPACE, " "))


#: character references: decimal, hexadecimal, or one of the named ones of HTML 4
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {f"&{n};": html5[f"{n};"] for n in sorted(name2codepoint)} | {"&apos;": "'"}


def dropped_parts(dropped: list[str] = DROPPED_HTML_TAGS) -> str:
    """Regex of comments and dropped elements with all they hold. What opens first decides; what is never closed goes on
    to the end of the page."""
    elements = [rf"<{tag}(?:\s[^>]*)?>.*?(?:</{tag}\s*>|\z)" for tag in dropped]
    return "(?is)" + "|".join([*elements, r"<!--.*?(?:-->|\z)"])


def _character(reference: Column) -> Column:
    """Text of a reference; an unknown name stays, a number that is no character becomes the replacement character."""
    low, n = F.lower(reference), F.length(reference)
    digits = F.when(F.startswith(low, F.lit("&#x")), F.conv(F.substring(reference, F.lit(4), n - 4), 16, 10)).otherwise(
        F.substring(reference, F.lit(3), n - 3))
    code = digits.try_cast("int")
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.when(F.startswith(low, F.lit("&#")), char).otherwise(F.coalesce(F.try_element_at(named, reference), reference))


def decode_references(text: Column) -> Column:
    """Every character reference decoded once, so that ``&amp;lt;`` gives ``&lt;``."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    between = F.split(text, REFERENCE, -1)
    pieces = F.zip_with(F.slice(between, 1, F.size(found)), F.transform(found, _character), lambda a, b: F.concat(a, b))
    return F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), F.element_at(between, -1))).otherwise(text)


def html_to_text(html: Column, dropped: list[str] = DROPPED_HTML_TAGS) -> Column:
    """Visible text of a page: dropped elements, comments and tags out, references decoded, white space collapsed."""
    out = F.regexp_replace(html, dropped_parts(dropped), " ")
    return normalize_whitespace(decode_references(F.regexp_replace(out, r"(?s)<[^>]*>", " ")))


def page_main_text(html: Column) -> Column:
    """Text of the article or main element without tables; the whole page when that is empty."""
    no_tables = F.regexp_replace(html, r"(?is)<table(\s[^>]*)?>.*?</table\s*>", " ")
    parts = [
        F.nullif(html_to_text(F.regexp_extract(no_tables, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>", 1)), F.lit(""))
        for tag in ("article", "main")
    ]
    return F.coalesce(*parts, html_to_text(html))


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])" + SPACE + "+")


def contains_any(text: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(F.lower(text), F.lit(t.lower()))
    return out


def url_authority(url: Column) -> Column:
    """Network location of a URL, with port and user info; an empty string when there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def strip_marker(text: Column, marker: str = CONTROL_MARKER) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(marker), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def clean_words(text: Column) -> Column:
    """Lower-case words split at white space, with full stops and commas removed."""
    words = F.split(F.translate(F.lower(text), ".,", ""), SPACE + "+")
    return F.filter(words, lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case words and single punctuation marks in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_']+|[^\p{{L}}\p{{N}}_'\s]"), F.lit(0))


def not_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACE, "") != "", F.lit(False))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")
