"""Near-duplicate vectors by randomised-rotation binary codes with confidence bounds.

Each vector is rotated at random and kept as the signs of its coordinates, with the correction factor <code, vector>. The
product of a rotated query with a code, divided by the factor, estimates the cosine without bias; a bound on its error
says which pairs can reach the threshold, and only these are computed from the vectors in double precision. Pairs are
looked for among vectors that share the signs of some rotated coordinates in one of several tables; the number of signs
grows with the logarithm of the number of vectors and the number of tables follows from the recall that is asked for.
Equal vectors are one class with a count, so that copies give no pairs. A search of two blocks gives no pairs either, but
the number of links of each vector and the smallest vector that links join it with.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.components import components
from evidloom.llm.storage import stored
from evidloom.llm.workers import in_arrow
from evidloom.shipping import ship_by_value

#: vectors of a bucket that one search handles, vectors a bucket should hold, and the bound's width in deviations
BLOCK, BUCKET, WIDTH = 1024, 256, 4.0
#: components of vectors that exact products hold at a time
COMPONENTS = 2_000_000


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; first divided by their largest component, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1)[:, None]


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Signs for each table, and tables, so that a pair at the threshold shares a bucket with the chance ``recall``."""
    bits = min(24, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def bucket_codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each unit vector in each table: signs of ``bits`` directions."""
    dim = unit.shape[1]
    out = np.zeros((len(unit), tables), np.int64)
    for t in range(tables):
        directions = np.random.default_rng(1000 + t).standard_normal((dim, bits))
        out[:, t] = ((unit @ directions) > 0) @ (1 << np.arange(bits))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, turn: np.ndarray,
                wanted=lambda i, j: np.ones(len(i), bool)) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with a cosine of at least ``threshold``, of those that ``wanted`` lets through."""
    dim = a.shape[1]
    query, data = (a @ turn).astype(np.float32), b @ turn
    code = np.where(data >= 0, 1.0, -1.0) / math.sqrt(dim)
    factor = (code * data).sum(axis=1)
    error = WIDTH * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / math.sqrt(max(1, dim - 1))
    estimate = (query @ code.T.astype(np.float32)) / factor
    i, j = np.nonzero(estimate + error >= threshold)
    keep, step = np.zeros(len(i), bool), max(1, COMPONENTS // dim)
    for k in range(0, len(i), step):
        x, y = i[k:k + step], j[k:k + step]
        some = np.flatnonzero(wanted(x, y))
        keep[k + some] = np.einsum("ij,ij->i", a[x[some]], b[y[some]]) >= threshold
    return i[keep], j[keep]


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of the numbers below ``n``: the smallest one that the pairs (i, j) join it with."""
    top = np.arange(n)
    while True:
        a, b = top[i], top[j]
        apart = a != b
        if not apart.any():
            return top
        np.minimum.at(top, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (top[top] != top).any():
            top = top[top]


def _valid(vector: str) -> str:
    return (f"{vector} is not null and size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = "
            f"double('infinity')) and exists({vector}, x -> x != 0)")


def vector_components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                      recall: float = 0.99) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Null, empty and zero vectors and those with null or non-finite components are linked with nothing; vectors of
    different length are not compared. Rows with equal vectors are linked with one another. Rows of one id are rows of their
    own, whatever their vectors; a row without an id is linked with nothing and has a null component. An empty table gives an
    empty result; further columns are not read. ``recall`` is the chance to find a pair just at the threshold; closer
    pairs are found with a higher one. No link is below the threshold.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.expr(_valid("v")), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1)), "d": F.size("v")})
    rows = rows.withColumn("ok", F.col("ok") & F.col("key").isNotNull())
    # a class has a number of its own, as ids may repeat with other vectors
    classes = stored(rows.where("ok").groupBy("h1", "h2", "d")
                     .agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    bits, tables = table_sizes(classes.count(), threshold, recall)

    def tabled(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                v = part.column(3).flatten().to_numpy().reshape(-1, d)
                codes = bucket_codes(unit(v), bits, tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3),
                                                  pa.array(list(codes))], ["rep", "copies", "d", "v", "codes"])

    coded = stored(in_arrow(classes.select("rep", "copies", "d", "v"), tabled,
                            "rep long, copies long, d int, v array<double>, codes array<long>"), "codes")
    buckets = coded.select("rep", "d", F.posexplode("codes").alias("t", "code"))
    sizes = buckets.groupBy("d", "t", "code").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("c"))
    dealt = (buckets.join(sizes.where("c > 1"), ["d", "t", "code"]).withColumn("b", F.pmod(F.xxhash64("rep"), "blocks")))
    own = dealt.select("rep", "d", "t", "code", F.col("b").alias("i"), F.explode(F.expr("sequence(b, blocks - 1)")).alias("j"),
                       F.lit(True).alias("asks"))
    other = dealt.select("rep", "d", "t", "code", F.explode(F.expr("sequence(0L, b)")).alias("i"), F.col("b").alias("j"),
                         F.lit(False).alias("asks"))
    tasks = (own.union(other).join(coded.select("rep", "copies", "v", "codes"), "rep")
             .repartition("d", "t", "code", "i", "j").sortWithinPartitions("d", "t", "code", "i", "j"))

    def run(batches):
        current, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5))))
            edges = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if keys[low] != current:
                    yield _search(current, held, threshold)
                    current, held = keys[low], []
                held.append(batch.slice(low, high - low))
        yield _search(current, held, threshold)

    links = stored(in_arrow(tasks.select("rep", "d", "t", "code", "i", "j", "asks", "copies", "v", "codes"), run,
                            "rep long, least long, n long"), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("rep").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "rep")
    joined = stored(classes.select("rep", "first").join(found, "rep"), "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(least, "component").select("rep", "least")
    told = (classes.select("h1", "h2", "d", "rep", "first", "copies").join(counts, "rep", "left").join(joined, "rep", "left")
            .select("h1", "h2", "d", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
                    F.coalesce("least", "first").alias("c"), F.lit(True).alias("ok")))
    return (rows.drop("v").join(told, ["h1", "h2", "d", "ok"], "left")
            .select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce(F.when(F.col("key").isNotNull(), F.col("c")), "key").alias("component_id"))
            .withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key))


def _search(current, held: list, threshold: float) -> pa.RecordBatch:
    """(rep, least, n) from the close pairs of the asking and the other vectors of one pair of blocks that share no
    earlier bucket: vectors linked with ``rep``, copies counted, and the smallest vector it is joined with."""
    names = ["rep", "least", "n"]
    if not held:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names)
    d, t, _, i, j = current
    table = pa.Table.from_batches(held).combine_chunks()
    asks = table.column("asks").to_numpy()
    sides = []
    for side in (table.filter(pa.array(asks)), table.filter(pa.array(~asks))):
        v = side.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        codes = np.array(side.column("codes").to_pylist(), np.int64).reshape(side.num_rows, -1)[:, :t]
        sides.append((side.column("rep").to_numpy(), side.column("copies").to_numpy(), codes,
                      unit(v)))
    (ra, ca, ka, va), (rb, cb, kb, vb) = sides
    turn = rotation(d, 7)
    reps, place = np.unique(np.concatenate([ra, rb]), return_inverse=True)
    pa_, pb_ = place[:len(ra)], place[len(ra):]
    count, least = np.zeros(len(reps)), np.arange(len(reps))
    for low in range(0, len(va), 256):
        def new(a, b):
            fresh = ~(ka[low + a] == kb[b]).any(axis=1)
            return fresh & (ra[low + a] < rb[b]) if i == j else fresh

        a, b = close_pairs(va[low:low + 256], vb, threshold, turn, new)
        x, y = pa_[low + a], pb_[b]
        count += np.bincount(x, cb[b], len(reps)) + np.bincount(y, ca[low + a], len(reps))
        known = np.arange(len(reps))
        least = smallest_reached(len(reps), np.concatenate([x, known]), np.concatenate([y, least]))
    linked = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (
        reps[linked], reps[least[linked]], count[linked].astype(np.int64))], names)


ship_by_value(__name__)
