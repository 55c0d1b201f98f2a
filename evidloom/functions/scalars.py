"""Scalar column expressions: profile texts, bands, names, prices, numbers and JSON."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import string_array
from evidloom.functions.text import SPACE, title_case


def formulation(terms: Column, cuts: list[tuple[int, str]] = fv.FORMULATION_CUTS,
                otherwise: str = fv.FORMULATION_ELSE) -> Column:
    """Formulation by the number of terms; cuts are given from the largest down."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for least, name in cuts:
        out = out.when(F.size(terms) >= least, F.lit(name))
    return out.otherwise(otherwise)


def kb_dosage(severity: Column, age: Column, child_safe: Column) -> Column:
    base = F.when(severity == "high", fv.DOSAGE_HIGH).when(severity == "low", fv.DOSAGE_LOW).otherwise(
        fv.DOSAGE_STANDARD)
    prefix = F.when((age == "young") & ~child_safe, fv.DOSAGE_YOUNG_PREFIX).when(
        age == "elder", fv.DOSAGE_ELDER_PREFIX).otherwise("")
    return F.concat(prefix, base)


def contraindications(flags: Column) -> Column:
    return F.array_compact(F.array(
        F.when(~F.coalesce(flags["child_safe"], F.lit(True)), fv.CONTRAINDICATION_CHILD),
        F.when(~F.coalesce(flags["elderly_safe"], F.lit(True)), fv.CONTRAINDICATION_ELDER),
        F.when(~F.coalesce(flags["pregnant_safe"], F.lit(True)), fv.CONTRAINDICATION_PREGNANT),
    ))


def age_band(age: Column, scheme: str) -> Column:
    """Age band: ``intake`` and ``demo`` take a number of years, ``kb`` takes an intake band."""
    if scheme == "intake":
        return F.when(age <= 12, "children").when(age >= 50, "elderly").otherwise("youth")
    if scheme == "demo":
        return F.when(age < 25, "young").when(age >= 60, "elder").otherwise("middle")
    if scheme == "kb":
        low = F.lower(age)
        return F.when(low == "children", "child").when(low == "elderly", "elder").otherwise("young")
    raise ValueError(f"unknown age scheme: {scheme}")


def gender_or_male(gender: Column) -> Column:
    return F.when(F.lower(gender) == "female", "female").otherwise("male")


def severity_or_medium(severity: Column) -> Column:
    return F.when(F.lower(severity).isin(*fv.SEVERITIES), F.lower(severity)).otherwise("medium")


def remedy_name(name: Column, terms: Column, generic_mark: str = fv.GENERIC_NAME_MARK,
                generic_name: str = fv.GENERIC_NAME) -> Column:
    """Remedy name with its cleaned terms: a generic name is replaced by them, another name is followed by three."""
    kept = F.filter(
        F.coalesce(terms, string_array([])),
        lambda t: ~F.rlike(t, F.lit(r"\p{N}")) & ~F.contains(F.lower(t), F.lit("days"))
        & ~F.contains(F.lower(t), F.lit("times")) & (F.length(t) > 2),
    )
    titled = F.transform(kept, title_case)
    generic = F.contains(name, F.lit(generic_mark)) | (name == generic_name)
    return (
        F.when(F.size(titled) == 0, name)
        .when(generic, F.array_join(F.slice(titled, 1, 5), ", "))
        .otherwise(F.concat(name, F.lit(" ("), F.array_join(F.slice(titled, 1, 3), ", "), F.lit(")")))
    )


def dosage_adjust(dosage: Column, age_category: Column, severity: Column) -> Column:
    """Half dose for the young and the old, then an intensive wrapper for high severity; neither is added twice."""
    scaled = F.when(
        F.lower(age_category).isin(*fv.SCALED_AGES) & ~F.contains(dosage, F.lit(fv.SCALED_MARK)),
        F.concat(F.lit(fv.SCALED_PREFIX), dosage),
    ).otherwise(dosage)
    return F.when(
        (F.lower(severity) == "high") & ~F.contains(scaled, F.lit(fv.INTENSIVE_MARK)),
        F.concat(F.lit(fv.INTENSIVE_PREFIX), scaled, F.lit(fv.INTENSIVE_SUFFIX)),
    ).otherwise(scaled)


def pregnancy_status(gender: Column, is_pregnant: Column) -> Column:
    return (
        F.when(gender_or_male(gender) == "male", fv.PREGNANCY_MALE)
        .when(is_pregnant, fv.PREGNANCY_YES)
        .otherwise(fv.PREGNANCY_NO)
    )


def keyword_class(name: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Value of the first rule with a keyword inside the lower-case name."""
    low = F.lower(name)
    out = F.when(F.lit(False), F.lit(otherwise))
    for value, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, F.lit(value))
    return out.otherwise(otherwise)


def slug(name: Column) -> Column:
    return F.lower(F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("")))


def price_parse(price: Column) -> Column:
    """All digits of a price text as one number, 0 without digits ("199.50" gives 19950)."""
    return F.coalesce(F.regexp_replace(price, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def bmi(weight: Column, height_cm: Column) -> Column:
    """Body-mass index to one decimal; NULL for a zero height."""
    metres = height_cm / 100.0
    return F.round(weight / F.nullif(metres * metres, F.lit(0.0)), 1)


def json_salvage(text: Column, schema: str, default: Column) -> Column:
    """Struct parsed from the text between the first and the last brace; ``default`` when nothing parses."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.from_json(found, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fields = [f.split()[0] for f in schema.split(",")]
    good = F.struct(*[parsed[f].alias(f) for f in fields])
    return F.when(parsed.isNotNull() & parsed["_bad"].isNull(), good).otherwise(default)


def normalize_list(value: Column) -> Column:
    """Lower-case trimmed items of a JSON list (blank items dropped); a plain string becomes one item."""
    items = F.filter(
        F.transform(F.from_json(value, "array<string>"), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    return (
        F.when(value.isNull(), string_array([]))
        .when(F.startswith(F.trim(value), F.lit("[")), F.coalesce(items, string_array([])))
        .otherwise(F.array(F.lower(F.trim(value))))
    )


def join_or(value: Column, fallback: str, is_array: bool = True) -> Column:
    """Items joined with a comma, or the text itself; the fallback for NULL and for an empty text."""
    if is_array:
        return F.coalesce(F.array_join(value, ", "), F.lit(fallback))
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def display_name(name: Column, style: str = "title") -> Column:
    """Name with spaces for underscores, in title case or with only the first character raised."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    if style == "title":
        return title_case(spaced)
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2147483647))


def pct(value: Column) -> Column:
    return F.round(value * 100, 2)


def minor_units(amount: Column) -> Column:
    return amount.cast("long") * 100


def bar_width(impact: Column) -> Column:
    return F.least(F.abs(impact) * 90, F.lit(100.0))


def lenient_int(text: Column) -> Column:
    """Leading integer of a text, else 0."""
    return F.coalesce(F.regexp_extract(text, rf"^{SPACE}*([+-]?[0-9]+)", 1).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def lenient_float(text: Column) -> Column:
    """Leading decimal number of a text, else 0."""
    number = F.regexp_extract(text, rf"^{SPACE}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def confidence(terms: Column) -> Column:
    """Confidence of an evidence row from its number of distinct terms."""
    return F.round(F.least(F.lit(fv.CONFIDENCE_TOP), F.lit(fv.CONFIDENCE_BASE) + F.lit(fv.CONFIDENCE_STEP)
                           * F.size(terms)), 3)
