"""Secrets in texts, with DataFrame functions only: fixed patterns, and a randomness test battery for other strings.

A candidate is a run of at least 20 key characters, wherever it stands; dots, '@' and '=' part runs, and '=' at the end
of one is its padding. Its encoding (letters, hex, base 32, base 64) gives the alphabet that a random string of it would
use. Three tests look at it: chi-squared of its characters against the uniform alphabet, runs of character classes, and
serial correlation of neighbours. Without a digit, runs say nothing (names in camel case or with hyphens have as many), so
the letters take their place: how far they are from the frequencies of written ones. The scores against what written words
and numbers show grow with the length. Which scores count as discoveries is decided by the false discovery rate among all
candidates of a length class, with a digit or without, over the whole table.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.columns import carried

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: the run of characters is matched whole, so asking for the least length in the pattern drops the same matches
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
KINDS = ["assign", "access", "hex", "random"]
#: share of false discoveries, chance that written text repeats a character, and that it changes the character class
RATE, REPEATS, CHANGES = 0.01, 0.075, 0.10
#: deviations of a test of randomness that exclude a candidate
DEVIATES = 3.5
#: mean frequencies of the letters a to z in English, German, French and Spanish, in thousandths
WRITTEN = [85, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 62, 19, 6, 67, 74, 68, 41, 12, 11, 2, 8, 5]
#: log2 of the frequency over that of a random letter, its mean in written text, and its deviation there, half as much
#: again as of independent letters since those of a word are not
LETTER = [math.log2(26 * w / sum(WRITTEN)) for w in WRITTEN]
LETTER_MEAN = sum(w * v for w, v in zip(WRITTEN, LETTER)) / sum(WRITTEN)
LETTER_SPREAD = 1.5 * math.sqrt(sum(w * (v - LETTER_MEAN) ** 2 for w, v in zip(WRITTEN, LETTER)) / sum(WRITTEN))
#: chance that a written run without a digit repeats a character: less, as both cases and few letters of each word meet
LETTERS_REPEAT = 0.06
#: added to the length class of candidates without a digit
NO_DIGIT = 1000
MASK = "[secret]"
#: values of a block of a running sum, and spans from which a text is masked by its list of characters
RUN, MANY = 64, 64
_FAR = 2147483647


def _let(value: Column, build) -> Column:
    """``build`` of a value that is computed once, also where it stands inside a function of array elements."""
    return F.get(F.transform(F.array(value), build), 0)


def _running(values: Column, zero: int, op) -> Column:
    """Array of ``op`` over all values up to each one. An array grows by copying, so this goes by blocks: about
    n * RUN + (n / RUN)^2 copied values instead of n^2. ``values`` is not empty."""
    none = F.expr("cast(array() as array<int>)")
    last = lambda v: F.floor((F.size(v) - 1) / RUN).cast("int")
    cut = _let(values, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda k: F.slice(v, k * RUN + 1, RUN)))

    def before(acc, x):
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def upto(acc, x):
        now = op(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    def whole(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), op))
        starts = F.aggregate(totals, F.struct(F.lit(zero).alias("at"), none.alias("out")), before)["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.aggregate(
            b, F.struct(s.alias("at"), none.alias("out")), upto)["out"]))

    return _let(cut, whole)


def _matches(text: Column, pattern: str) -> Column:
    """(s, e, m) of all matches from left to right: code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    ends = _running(sizes, 0, lambda a, b: a + b)
    return F.when(F.size(found) > 0, F.zip_with(ends, found, lambda e, m: F.struct(
        (e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))).otherwise(empty)


def _encoding(m: Column) -> Column:
    """(k, change): size of the alphabet, and how often neighbours of a random string differ in class."""
    def of(k, change):
        return F.struct(F.lit(float(k)).alias("k"), F.lit(change).alias("change"))

    return (F.when(m.rlike("^([a-z]+|[A-Z]+)=*$"), of(26, 1e-6)).when(m.rlike("^[A-Za-z]+=*$"), of(52, 0.5))
            .when(m.rlike("^[A-Za-z+/_-]+=*$"), of(54, 0.535)).when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), of(16, 0.469)).when(m.rlike("^[A-Z2-7]+=*$"), of(32, 0.305))
            .when(m.rlike("^[A-Za-z0-9]+=*$"), of(62, 0.622)).otherwise(of(64, 0.645)))


def _classes(chars: Column) -> Column:
    return F.transform(chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1)
                       .when(c.between("0", "9"), 2).otherwise(3))


def _neighbours(values: Column) -> Column:
    n = F.size(values)
    return F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def _letters(chars: Column) -> Column:
    """(n, sum): number of letters, and the sum of their values of LETTER."""
    values = F.array(*[F.lit(v) for v in LETTER])
    own = F.filter(chars, lambda c: F.lower(c).between("a", "z"))
    return F.struct(F.size(own).cast("double").alias("n"),
                    _sum(own, lambda c: F.get(values, F.ascii(F.lower(c)) - 97)).alias("sum"))


def _battery(found: Column) -> Column:
    """(s, e, length_class, bin): evidence of each candidate in tenths of a decade; 0 if a test speaks against it."""
    def prepared(x):
        chars = F.split(F.rtrim(x["m"], F.lit("=")), "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), chars.alias("c"), F.size(chars).cast("double").alias("n"),
                        _encoding(x["m"]).alias("enc"), _neighbours(_classes(chars)).alias("kinds"),
                        F.transform(chars, lambda c: F.ascii(c).cast("double")).alias("codes"),
                        (_sum(chars, lambda c: F.ascii(c).cast("double")) / F.size(chars)).alias("mean"))

    def counted(x):
        squares = _sum(F.array_distinct(x["c"]), lambda c: F.pow(F.size(F.filter(x["c"], lambda y: y == c)), F.lit(2)))
        mean = x["mean"]
        spread = _sum(x["codes"], lambda v: (v - mean) * (v - mean))
        along = _sum(_neighbours(x["codes"]), lambda p: (p["a"] - mean) * (p["b"] - mean))
        digit = F.exists(x["c"], lambda c: c.between("0", "9"))
        return F.struct(
            x["s"], x["e"], x["n"].alias("n"), x["enc"].alias("enc"), digit.alias("digit"),
            F.when(~digit, _letters(x["c"])).alias("letters"),
            (x["enc"]["k"] / x["n"] * squares - x["n"]).alias("chi"),
            _sum(x["kinds"], lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0)).alias("changes"),
            F.when(spread > 0, along / spread).otherwise(1.0).alias("serial"))

    def tested(x):
        n, k, change = x["n"], x["enc"]["k"], x["enc"]["change"]
        spread = F.sqrt(2 * (k - 1))
        repeats = F.when(x["digit"], REPEATS).otherwise(LETTERS_REPEAT)
        written = k * (1 + (n - 1) * F.greatest(repeats, 1.6 / k)) - n
        z_chi = (written - x["chi"]) / (spread * F.greatest(F.lit(1.0), k * repeats / 2))
        z_runs = (x["changes"] - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
        against = ((x["chi"] - (k - 1)) / spread > DEVIATES) | (F.abs(x["serial"]) * F.sqrt(n) > DEVIATES) | (
            (x["changes"] - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)) < -DEVIATES)
        letters = x["letters"]["n"]
        z_letters = (letters * LETTER_MEAN - x["letters"]["sum"]) / (LETTER_SPREAD * F.sqrt(F.greatest(letters, F.lit(1.0))))
        z = F.least((z_chi + F.when(x["digit"], z_runs).otherwise(z_letters)) / F.sqrt(F.lit(2.0)), F.lit(12.0))
        # decades of the upper tail of the normal distribution, by its logistic approximation
        decades = F.log10(1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
        return F.struct(x["s"], x["e"], (F.floor(F.log2(n) * 2).cast("int") + F.when(x["digit"], 0).otherwise(NO_DIGIT)).alias("length_class"),
                        F.when(against, 0).otherwise(F.least(F.floor(10 * decades), F.lit(600)).cast("int")).alias("bin"))

    return F.transform(F.transform(F.transform(found, prepared), counted), tested)


def discovery_bins(df: DataFrame, text: str, rate: float = RATE) -> dict[int, int]:
    """By length class: the least evidence that counts as a discovery, over all candidates of the table.

    Candidates are counted by class and evidence; some tens of classes reach the driver, each with one number.
    """
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = (df.select(_matches(own, CANDIDATE).alias("f")).where("size(f) > 0")
             .select(F.explode(_battery(F.col("f"))).alias("b")).groupBy("b.length_class", "b.bin").agg(F.count("*").alias("c")))
    ranked = found.selectExpr("length_class", "bin", "sum(c) over (partition by length_class order by bin desc) as rank",
                              "sum(c) over (partition by length_class) as total")
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.lit(rate) * F.col("rank") / F.col("total"))
    return {r[0]: r[1] for r in passed.groupBy("length_class").agg(F.min("bin")).collect()}


def with_secrets(df: DataFrame, text: str, rate: float = RATE) -> DataFrame:
    """``df`` with ``secrets``: (start, kind, end) of all spans of every whole text, by start, then kind as in KINDS.

    The base kinds follow their patterns; ``random`` spans are the discoveries of the battery that overlap no base span.
    Null and empty texts have no spans; rows are independent, so keys may be null or repeated; a column named
    ``secrets`` is replaced.
    """
    bins = discovery_bins(df, text, rate)
    own = F.coalesce(F.col("own"), F.lit(""))
    found = carried(df, ["secrets"], F.col(f"`{text}`").cast("string").alias("own")).select(
        "row", F.filter(_matches(own, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6).alias("a"),
        _matches(own, ACCESS).alias("b"), _matches(own, HEX).alias("c"), _matches(own, CANDIDATE).alias("d"))

    def as_kind(column, kind):
        return F.transform(column, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end")))

    base = F.concat(*(as_kind(F.col(c), k) for k, c in enumerate("abc")))
    least = F.expr("cast(map() as map<int,int>)") if not bins else F.create_map(
        *[F.lit(x) for pair in sorted(bins.items()) for x in pair])
    accepted = F.filter(_battery(F.col("d")), lambda x: x["bin"] >= F.coalesce(F.try_element_at(least, x["length_class"]), F.lit(601)))
    added = F.when(F.size("d") > 0, as_kind(accepted, 3)).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))
    return (found.select("row", base.alias("base"), added.alias("added"))
            .select("row", F.when(F.size("added") > 0, _free(F.col("base"), F.col("added"))).otherwise(F.array_sort("base")).alias("secrets"))
            .select("row.*", "secrets"))


def _free(base: Column, added: Column) -> Column:
    """Base spans, and added ones that overlap none of them, in order: one pass over all from either side."""
    spans = F.array_sort(F.concat(base, added))
    is_base = lambda x: x["kind"] < 3
    ends = _running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
    starts = F.reverse(_running(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), x["start"]).otherwise(_FAR))), _FAR, lambda a, b: F.least(a, b)))
    told = F.zip_with(F.zip_with(spans, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts,
                      lambda t, s: F.struct(t["x"].alias("x"), ((t["x"]["kind"] < 3) | ((t["e"] <= t["x"]["start"]) & (s >= t["x"]["end"]))).alias("ok")))
    return F.transform(F.filter(told, lambda t: t["ok"]), lambda t: t["x"])


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"),
                                                                    x["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, put as one mark."""
    upto = _running(F.transform(spans, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))

    def whole(part) -> Column:
        pieces = F.zip_with(spans, F.slice(F.concat(F.array(F.lit(0)), upto), 1, F.size(spans)), lambda x, at: F.when(
            x["start"] >= at, F.concat(part(at, x["start"] - at), F.lit(MASK))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(upto, -1), F.length(text)))

    few = whole(lambda at, n: F.substring(text, at + 1, n))
    # cutting far into a text walks over all before it, so many cuts are made in a list of its characters
    many = _let(F.split(text, ""), lambda chars: whole(lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    return F.when(F.size(spans) > MANY, many).when(F.size(spans) > 0, few).otherwise(text)
