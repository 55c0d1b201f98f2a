"""Jaccard join of documents on word shingles, as a T-occurrence search with DivideSkip.

A document of n shingles can only be linked with one that holds at least T = ceil(0.8 n) of them. It therefore posts only
its n - T + l shingles of smallest hash, with l = 1 + 20 % of n: linked documents have l of these in common (the smaller
l of both). Lists of one document drop out, and with them most documents, as fewer than l of their postings are left. Of a
remaining document's lists the l - 1 longest are its long lists; linked documents meet in a list that is short for both.
Postings are dealt by ranges of the hash, as sorted runs, so that a list costs each task that adds to it only a part of one
run; a key occurs at most once for each document.

Candidates are taken in two steps. First every document of a short list is compared with the first one of that list, which
joins groups of copies without pairs inside them. Then the documents of lists that still span several components, one
for each set of shingles in a component, post all of their shingles, so that passages which many documents share become
long lists; the documents of lists that again span several components form groups, which are compared block by block. A
comparison is a T-occurrence search: the query document's shingles
name inverted lists over a block of candidates; the short lists are merged by a heap, documents that may still reach
the overlap are looked up in the long ones by binary search.
"""
from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evidloom.llm.components import components
from evidloom.llm.storage import stored
from evidloom.llm.textarrays import Words, buffers, mix, separators
from evidloom.llm.workers import in_arrow, key_and_text, map_slices, slices
from evidloom.shipping import ship_by_value

WORD_SEPARATOR = separators((0x20, 0x20), (0x09, 0x0D))
SHINGLE, PERCENT = 5, 80
#: ids of candidate documents that are broadcast to pick their texts; beyond it texts are joined by a shuffle
BROADCAST_IDS = 2_000_000
#: candidates that one search handles, and parts of the candidates of one query document
BLOCK, SALTS = 256, 16
#: ranges of the hash (as bits) that postings are dealt by, and postings that a task holds before it writes runs
RANGE_BITS, POSTINGS_HELD = 10, 2_000_000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after another, and their number by text."""
    words = Words(*buffers(column), WORD_SEPARATOR)
    value, doc, _ = words.windows(size)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(column))


def needed(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any linked set."""
    return -(-percent * n // 100)


def _extra(n):
    return 1 + n // 5


def _set_sizes(rows: DataFrame, size: int) -> DataFrame:
    """(key, n, print): set size and fingerprint of the set of each text."""
    schema = StructType([StructField("key", LongType()), StructField("n", LongType()), StructField("print", LongType())])

    def step(batch):
        value, count = shingle_sets(batch.column(1), size)
        begin = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            total = np.append(np.uint64(0), np.cumsum(mix(value)))
            prints = mix(total[begin + count] - total[begin] + count.astype(np.uint64))
        return {"key": batch.column(0), "n": count.astype(np.int64), "print": prints.view(np.int64)}

    return map_slices(rows, "text", step, schema)


def _posted(batch: pa.RecordBatch, size: int, percent: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and key of each posting of a slice."""
    value, count = shingle_sets(batch.column(1), size)
    begin = np.cumsum(count) - count
    keep = count if whole else np.where(count > 0, np.minimum(count, count - -(-percent * count // 100) + _extra(count)), 0)
    place = np.repeat(begin, keep) + np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
    return value[place], np.repeat(batch.column(0).to_numpy(), keep)


def _shared_postings(rows: DataFrame, size: int, percent: int, whole: bool) -> DataFrame:
    """(key, h, length): postings of lists of at least two documents, with the length of the list."""
    def runs(batches):
        import pyarrow.compute  # noqa: F401
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(_posted(part, size, percent, whole))
                n += len(held[-1][0])
                if n >= POSTINGS_HELD:
                    yield _as_runs(held)
                    held, n = [], 0
        if n:
            yield _as_runs(held)

    def lists(batches):
        current, held = None, []
        for batch in batches:
            for r, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if r != current:
                    yield from _lists(held)
                    current, held = r, []
                held.append(_unpacked(n, packed))
        yield from _lists(held)

    dealt = in_arrow(rows.where("key is not null"), runs, "range int, n long, packed binary")
    return in_arrow(dealt.repartition("range").sortWithinPartitions("range"), lists, "key long, h long, length long")


def _as_runs(held: list) -> pa.RecordBatch:
    """One sorted run for each range of the hash: differences of hashes, then keys, compressed."""
    value, key = (np.concatenate([x[i] for x in held]) for i in range(2))
    order = np.argsort(value, kind="stable")
    value, key = value[order], key[order]
    codec = pa.Codec("zstd", compression_level=1)
    part = (value >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    packed = []
    for low, high in zip(edges[:-1], edges[1:]):
        steps = np.diff(value[low:high], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        keys = np.ascontiguousarray(key[low:high], np.int64).view(np.uint8).reshape(-1, 8).T
        packed.append(codec.compress(np.concatenate([steps, keys]).tobytes(), asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges)),
                                       pa.array(packed, pa.binary())], ["range", "n", "packed"])


def _unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 16 * n), np.uint8).reshape(16, n)
    return (np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64),
            np.ascontiguousarray(planes[8:].T).view(np.int64).ravel())


def _lists(held: list):
    """Lists of at least two documents among the runs of one range."""
    if not held:
        return
    value, key = (np.concatenate([x[i] for x in held]) for i in range(2))
    order = np.lexsort((key, value))
    value, key = value[order], key[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
    value, key = value[new], key[new]
    edges = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    length = np.diff(np.append(edges, len(value)))
    length = np.repeat(length, length)
    keep = np.flatnonzero(length > 1)
    for at in range(0, len(keep), 100_000):
        some = keep[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(value[some].view(np.int64)),
                                          pa.array(length[some])], ["key", "h", "length"])


def divide_skip(query: np.ndarray, members: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Positions of the member sets linked with the query set; sets are ascending arrays of distinct hashes."""
    least = needed(len(query), percent)
    sizes = np.array([len(m) for m in members])
    fits = np.flatnonzero((sizes > 0) & (100 * sizes >= percent * len(query)) & (percent * sizes <= 100 * len(query)))
    if not len(query) or not len(fits):
        return []
    joined = np.concatenate([members[i] for i in fits])
    owner = np.repeat(fits, sizes[fits])
    at = np.minimum(np.searchsorted(query, joined), len(query) - 1)
    same = query[at] == joined
    at, owner = at[same], owner[same]
    order = np.argsort(at, kind="stable")
    lists = [x for x in np.split(owner[order], np.flatnonzero(np.diff(at[order])) + 1) if len(x)]
    lists.sort(key=len)
    if len(lists) < least:
        return []
    n_long = min(least - 1, len(lists) - 1)
    short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
    out = []
    for member, hits in groupby(heapq.merge(*(x.tolist() for x in short))):
        count = sum(1 for _ in hits)
        if count < least - n_long:
            continue
        total = len(query) + int(sizes[member])
        enough = -(-percent * total // (100 + percent))
        for k, x in enumerate(long):
            if count + len(long) - k < enough:
                break
            i = int(np.searchsorted(x, member))
            count += i < len(x) and x[i] == member
        if count >= enough and 100 * count >= percent * (total - count):
            out.append(member)
    return out


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose key is in the written table ``ids``."""
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, "key", "left_semi")


def _linked(rows: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of those (q, m) pairs that are linked, by a search for each query document over its candidates."""
    ids = stored(pairs.select(F.col("q").alias("key")).union(pairs.select("m")).distinct(), "candidate-ids")
    texts = stored(_with_ids(rows, ids), "candidate-texts")
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int"))
    asks = dealt.select("q", "salt").distinct().select("q", F.col("q").alias("m"), "salt")
    everything = dealt.select("q", "m", "salt").union(asks).join(texts.withColumnRenamed("key", "m"), "m")
    ordered = (everything.select("q", "salt", "m", (F.col("q") == F.col("m")).alias("asks"), "text")
               .repartition("q", "salt").sortWithinPartitions("q", "salt", F.desc("asks")))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        query, block = (None, None, None), []
        for batch in batches:
            for part in slices(batch, "text"):
                value, count = shingle_sets(part.column(4), size)
                sets = np.split(value, np.cumsum(count)[:-1]) if part.num_rows else []
                found = []
                for q, salt, m, asks, own in zip(*(part.column(i).to_pylist() for i in range(4)), sets):
                    if asks:
                        found += _search(query, block, percent)
                        query, block = (q, salt, own), []
                    else:
                        block.append((m, own))
                        if len(block) == BLOCK:
                            found += _search(query, block, percent)
                            block = []
                yield _links(found)
        yield _links(_search(query, block, percent))

    return in_arrow(ordered, run, "u long, v long")


def _search(query, block, percent) -> list[tuple[int, int]]:
    if not block:
        return []
    return [(query[0], block[i][0]) for i in divide_skip(query[2], [b[1] for b in block], percent)]


def _links(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["u", "v"])


def _compatible(percent: int):
    return (F.lit(100) * F.least("qn", "mn") >= F.lit(percent) * F.greatest("qn", "mn")) & (F.col("q") != F.col("m"))


def ngram_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                     percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``.

    Words are runs of bytes other than blanks, A-Z lower-cased; a text of fewer than ``size`` words, but not none, has one
    shingle. Null, empty and blank texts have no shingles and are linked with nothing. ``key`` is a whole number; rows
    that repeat a key share a component; a null key gives a null component. An empty table gives an empty result.
    """
    rows = key_and_text(df, key, text).withColumn("key", F.col("key").cast("long"))
    sets = stored(_set_sizes(rows, size), "set-sizes")
    known = sets.where("key is not null and n > 0").distinct()
    active = _short_lists(rows, known, size, percent, whole=False)
    links = stored(_linked(rows, stored(_stars(active, percent), "star-pairs"), size, percent), "links")
    joined = stored(components(links), "classes").withColumnRenamed("id", "key")
    waiting = stored(_open_lists(active, joined).groupBy("component", "n", "print").agg(F.min("key").alias("key")),
                     "waiting").select("key")
    again = _short_lists(_with_ids(rows, waiting), known, size, percent, whole=True)
    stars = stored(_stars(_open_lists(again, joined), percent), "star-pairs")
    links = stored(links.union(_linked(rows, stars, size, percent)), "links")
    joined = stored(components(links), "classes").withColumnRenamed("id", "key")
    final = components(links.union(_searched_groups(rows, _open_lists(again, joined), size, percent)))
    return sets.join(final.withColumnRenamed("id", "key"), "key", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _stars(active: DataFrame, percent: int) -> DataFrame:
    """Pairs (q, m) of each document of a list with the first one of it."""
    first = active.groupBy("h").agg(F.min(F.struct("key", "n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    return (active.join(first, "h").select(F.col("f.key").alias("q"), F.col("f.n").alias("qn"), F.col("key").alias("m"),
                                           F.col("n").alias("mn")).where(_compatible(percent)).select("q", "m").distinct())


def _short_lists(rows: DataFrame, known: DataFrame, size: int, percent: int, whole: bool) -> DataFrame:
    """(key, n, print, h): the short lists of documents that share enough of their postings."""
    least = f"int(ceil(n * {percent} / 100))" if whole else f"int(1 + floor(n * {percent} / 500))"
    shared = (_shared_postings(rows, size, percent, whole).groupBy("key")
              .agg(F.sort_array(F.collect_list(F.struct("length", "h"))).alias("lists")).join(known, "key")
              .where(f"size(lists) >= {least}")
              .select("key", "n", "print", F.expr(f"slice(lists, 1, size(lists) - {least} + 1)").alias("lists")))
    return stored(shared, "short-lists").select("key", "n", "print", F.explode("lists.h").alias("h"))


def _open_lists(active: DataFrame, joined: DataFrame) -> DataFrame:
    """The lists that span several components, with the component of each document."""
    now = active.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    spans = now.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    return now.join(spans.select("h"), "h")


def _searched_groups(rows: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of linked documents of different components.

    Documents that meet in lists, directly or over others, form a group. A group is cut into blocks, and each pair of its
    blocks is one search: every document of one block asks, the other block is indexed.
    """
    members = stored(members, "open-lists")
    lead = members.groupBy("h").agg(F.min("key").alias("v"))
    groups = components(members.join(lead, "h").select(F.col("key").alias("u"), "v"))
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = members.groupBy("key").agg(F.first("component").alias("class"))
    dealt = (groups.join(blocks, "component").join(own.withColumnRenamed("key", "id"), "id")
             .withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    dealt = stored(dealt.select(F.col("id").alias("key"), "component", "class", "b", "blocks"), "groups")
    texts = stored(_with_ids(rows, dealt.select("key")), "candidate-texts")
    asks = dealt.select("*", F.explode(F.expr("sequence(b, blocks - 1)")).alias("other"))
    tasks = (asks.select("component", F.col("b").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "key", "class")
             .union(_indexed(dealt)))
    ordered = (tasks.join(texts, "key").select("component", "i", "j", "asks", "key", "class", "text")
               .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        current, held = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                value, count = shingle_sets(part.column(6), size)
                sets = np.split(value, np.cumsum(count)[:-1]) if part.num_rows else []
                found = []
                for g, i, j, asks, key, label, own in zip(*(part.column(i).to_pylist() for i in range(6)), sets):
                    if (g, i, j) != current:
                        found += _between(held, percent)
                        current, held = (g, i, j), []
                    held.append((asks, key, label, own))
                yield _links(found)
        yield _links(_between(held, percent))

    return in_arrow(ordered, run, "u long, v long")


def _indexed(dealt: DataFrame) -> DataFrame:
    """The rows of each block as the indexed side of the searches of the blocks up to it."""
    return dealt.select("*", F.explode(F.expr("sequence(0L, b)")).alias("other")).select(
        "component", F.col("other").alias("i"), F.col("b").alias("j"), F.lit(False), "key", "class")


def _between(held: list, percent: int) -> list[tuple[int, int]]:
    """Links of asking and indexed documents whose classes are not joined yet; links found join them."""
    top: dict[int, int] = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out, indexed = [], [h for h in held if not h[0]]
    for asks, key, label, own in held:
        if not asks:
            continue
        rest = [h for h in indexed if find(h[2]) != find(label)]
        for i in divide_skip(own, [h[3] for h in rest], percent) if rest else []:
            if find(rest[i][2]) != find(label):
                top[find(rest[i][2])] = find(label)
                out.append((key, rest[i][1]))
    return out


ship_by_value(__name__)
