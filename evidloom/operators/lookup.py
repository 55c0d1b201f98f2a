"""Lookups in the knowledge base: eligibility, fallback cascades, relaxed search, recommendation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import broadcast_if_small, string_array
from evidloom.functions import scalars as sc
from evidloom.operators.common import first_by, top_k
from evidloom.operators.profile import PatientDims
from evidloom.operators.similar import fuzzy_best_match

BUCKET = ["topic", "age_group", "gender", "severity"]


def eligibility_matrix(rules: DataFrame, dims: PatientDims | None = None, wildcard: str = "all") -> DataFrame:
    """Flat patient matrix: one row per topic, combination and allowed remedy; an empty bucket has a NULL remedy.

    ``rules`` has ``(topic, remedy_ord, …, allowed_ages, allowed_genders, allowed_severities)``. A list is an array, or
    text as it was written: a JSON list, or one plain word. Items are compared trimmed and in lower case. A missing list
    (NULL) allows everyone; an empty one, or a JSON null, nobody. Combinations come from a literal array, empty buckets
    from one flag per combination and topic, so no row is joined to any other. (Exploded rows look small to the planner,
    which broadcasts them in a join.)
    """
    dims = dims or PatientDims()
    lists = ("allowed_ages", "allowed_genders", "allowed_severities")
    others = [c for c in rules.columns if c not in ("topic", *lists)]
    rules = rules.withColumns({c: _allowed_items(rules, c) for c in lists})

    def allowed(column: str, value: Column) -> Column:
        return F.col(column).isNull() | F.array_contains(column, F.lit(wildcard)) | F.array_contains(column, value)

    def fits(age: Column, gender: Column, severity: Column) -> Column:
        return allowed("allowed_ages", age) & allowed("allowed_genders", gender) & allowed("allowed_severities", severity)

    def expanded(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.explode(dims.array()).alias("_c")).select("*", "_c.*").drop("_c")

    kept = expanded(rules.where(F.col("topic").isNotNull())).where(fits(*[F.col(c) for c in BUCKET[1:]])).drop(*lists)
    filled = rules.groupBy("topic").agg(F.array(*[
        F.bool_or(F.col("topic").isNotNull() & fits(*map(F.lit, combo))) for combo in dims.combos()]).alias("_filled"))
    empty = expanded(filled).where(~F.coalesce(F.get("_filled", "combo_ord"), F.lit(False))).drop("_filled")
    return empty.unionByName(kept, allowMissingColumns=True).select(*BUCKET, "combo_ord", *others)


def _allowed_items(rules: DataFrame, column: str) -> Column:
    if rules.schema[column].dataType.typeName() == "array":
        return F.filter(F.transform(column, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    raw = F.col(column)
    return F.when(F.trim(raw) == "null", string_array([])).when(raw.isNotNull(), sc.normalize_list(raw))


def kb_lookup(requests: DataFrame, kb: DataFrame, on: list[str] = BUCKET) -> DataFrame:
    """Left join of requests with the rows of their bucket."""
    return requests.join(broadcast_if_small(kb), on, "left")


def kb_lookup_fallback(requests: DataFrame, kb: DataFrame,
                       defaults: list[tuple[str, str]] = fv.DEFAULT_REMEDIES) -> DataFrame:
    """Rows of the exact bucket, else of the topic's first non-empty bucket, else the default names and dosages.

    ``requests`` has the bucket columns, ``kb`` also ``combo_ord``, ``medicine_name``, ``dosage`` and ``remedy_ord``
    (NULL in an empty bucket). Adds ``match_level``. The filled buckets of a topic (at most one per patient combination)
    are one array, by which a request picks its bucket in place; one join then fetches the remedies.
    """
    filled = kb.where(F.col("remedy_ord").isNotNull())
    index = filled.groupBy("topic").agg(
        F.collect_set(F.struct("combo_ord", "age_group", "gender", "severity")).alias("_filled"))
    rows = requests.join(broadcast_if_small(index), "topic", "left")
    own = F.exists("_filled", lambda b: (b["age_group"] == F.col("age_group")) & (b["gender"] == F.col("gender"))
                   & (b["severity"] == F.col("severity")))
    level = F.when(own, "exact").when(F.col("_filled").isNotNull(), "first").otherwise("default")
    first = F.array_min("_filled")
    rows = rows.select(
        *requests.columns, level.alias("match_level"),
        *[F.when(own, F.col(c)).otherwise(first[c]).alias(f"_{c}") for c in BUCKET[1:]])
    named = ["remedy_ord", "medicine_name", "dosage"]
    others = [c for c in kb.columns if c not in BUCKET + ["combo_ord"] + named]
    source = filled.select(
        "topic", *[F.col(c).alias(f"_{c}") for c in BUCKET[1:]],
        F.struct(F.col("remedy_ord").cast("long").alias("remedy_ord"), "medicine_name", "dosage").alias("_found"), *others)
    literal = F.array(*[
        F.struct(F.lit(i).cast("long").alias("remedy_ord"), F.lit(n).alias("medicine_name"), F.lit(d).alias("dosage"))
        for i, (n, d) in enumerate(defaults)])
    joined = rows.join(broadcast_if_small(source), ["topic", *[f"_{c}" for c in BUCKET[1:]]], "left")
    picked = F.when(F.col("match_level") == "default", literal).otherwise(F.array("_found"))
    return joined.withColumn("_r", F.explode(picked)).select(
        *requests.columns, "match_level", *[F.col(f"_r.{c}").alias(c) for c in named], *others)


def relaxed_lookup(requests: DataFrame, kb: DataFrame, k: int = 3, wildcard: str = "all") -> DataFrame:
    """First ``k`` rows in knowledge-base order (``kb_ord``) for topic, severity, gender and age, where a ``wildcard``
    bucket also fits; when there is none, for topic and severity only. A request without rows stays with NULLs.

    The knowledge base is cut to ``k`` rows per cell first and requests are resolved per distinct bucket, so neither a
    popular bucket nor a large cell is one task's work.
    """
    rows = [c for c in kb.columns if c not in BUCKET]
    wanted = requests.select(*BUCKET).distinct()
    tries = wanted.select(
        "*", F.explode(F.array_distinct(F.array("age_group", F.lit(wildcard)))).alias("_age"),
    ).select("*", F.explode(F.array_distinct(F.array("gender", F.lit(wildcard)))).alias("_gender"))
    cells = top_k(kb, BUCKET, [F.asc("kb_ord")], k).select(
        "topic", "severity", F.col("age_group").alias("_age"), F.col("gender").alias("_gender"), *rows)
    strict = tries.join(cells, ["topic", "severity", "_age", "_gender"]).drop("_age", "_gender")
    strict = top_k(strict, BUCKET, [F.asc("kb_ord")], k, "rank").withColumn("match_level", F.lit("strict"))
    loose_kb = top_k(kb, ["topic", "severity"], [F.asc("kb_ord")], k, "rank").select(
        "topic", "severity", "rank", *rows)
    unmatched = wanted.join(strict.select(*BUCKET).distinct(), BUCKET, "left_anti")
    loose = unmatched.join(loose_kb, ["topic", "severity"]).withColumn("match_level", F.lit("relaxed"))
    return requests.join(strict.unionByName(loose), BUCKET, "left")


def catalog_image(products: DataFrame, files: DataFrame, rules: list[tuple[str, list[str]]],
                  otherwise: str, name: str = "name") -> DataFrame:
    """Add ``image``: the path of the file with the product's slug, else the class of the first keyword."""
    tagged = products.withColumn("slug", sc.slug(F.col(name)))
    paths = files.select("slug", "path").dropDuplicates(["slug"])
    return tagged.join(paths, "slug", "left").withColumn(
        "image", F.coalesce("path", sc.keyword_class(F.col(name), rules, otherwise))).drop("path")


def register_new(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key does not exist yet; the first one of a key within the batch wins."""
    return first_by(new, [key], [F.asc(order)]).join(existing.select(key).distinct(), key, "left_anti")


def recommend(triaged: DataFrame, kb: DataFrame, topic_keys: DataFrame,
              defaults: list[tuple[str, str]] = fv.DEFAULT_REMEDIES, cutoff: int = fv.LOOKUP_CUTOFF,
              scorer: str = "weighted") -> DataFrame:
    """Remedies of successful rows: topic by similarity to the label, bucket cascade, names, doses, pregnancy note.

    ``triaged`` has ``label, age_category, gender, severity, is_pregnant``; ``topic_keys`` has ``(key_ord, key)``.
    """
    rows = triaged.where(F.col("status") == "success")
    match = fuzzy_best_match(rows.select(F.col("label").alias("a")), topic_keys, cutoff, scorer)
    match = match.select(F.col("a").alias("label"), F.coalesce("key", F.lit("")).alias("topic"))
    given = ["gender", "severity"]
    rows = rows.join(broadcast_if_small(match), "label").withColumnsRenamed({c: f"given_{c}" for c in given})
    rows = rows.withColumns({
        "age_group": sc.age_band(F.col("age_category"), "kb"),
        "gender": sc.gender_or_male(F.col("given_gender")),
        "severity": sc.severity_or_medium(F.col("given_severity")),
    })
    found = kb_lookup_fallback(rows, kb, defaults)
    name = sc.remedy_name(F.coalesce("medicine_name", F.lit("Protocol")), F.coalesce("top_terms", string_array([])))
    dose = sc.dosage_adjust(F.coalesce("dosage", F.lit(fv.DEFAULT_REMEDY_DOSAGE)), F.col("age_category"),
                            F.col("given_severity"))
    return found.withColumn("remedy", name).withColumn("remedy_dosage", dose).withColumn(
        "pregnancy_status", sc.pregnancy_status(F.col("given_gender"), F.col("is_pregnant")))
