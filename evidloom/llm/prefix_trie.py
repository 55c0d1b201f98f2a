"""Trie of conversation prefixes, with totals of all subtrees by parallel tree contraction.

A conversation is a sequence of turns; every distinct sequence of its first d turns is a node. Turns are numbered and
prefixes hashed by runs: rows are dealt by range, each run is folded on its own, and what comes before a run is carried
into it, so a conversation with a large share of the rows is many tasks. Prefixes are compared by two 64-bit hashes.

Totals: rounds alternate rake (all leaves add their totals to their parents) and compress (of a chain of nodes with one
child each, an independent set is taken out; its weights go to the link of the child). A raked node's total is final.
Contracted nodes are put back in reverse order of rounds: total of the node = its own part + link + total of its child.
The number of rounds grows with the logarithm of the number of nodes, also for a single chain, and the sum of the rows of
all rounds is proportional to the nodes.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm.skew import join_hot
from evidloom.llm.storage import stored
from evidloom.llm.workers import in_arrow
from evidloom.shipping import ship_by_value

WORD = r"[^ \t-\r]+"
#: conversations that share a beginning, the longest shared beginning, and ids in one block of a digest's input
SHARED, LONGEST, BLOCK = 20, 3, 8_192


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, run, pos, x, y, words): turns in order from 1; x and y identify role and text, run is a range of rows.

    Order is by turn, nulls first; turns of one number are ordered by a digest of role and text. Null role or text is
    empty; rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"),
                        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv is not null")
    rows = rows.select("conv", "turn", *[F.conv(F.substring("digest", at, 16), 16, -10).cast("long").alias(n)
                                         for at, n in ((1, "x"), (17, "y"))], "words",
                       F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = [F.col("turn").asc_nulls_first(), "x", "y"]
    dealt = stored(rows.repartitionByRange("conv", *order, "salt").withColumn("run", F.spark_partition_id()).drop("salt"), "turns")
    within = Window.partitionBy("conv", "run").orderBy(*order)
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy("conv", "run").count().withColumn("carry", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counted = dealt.withColumn("row", F.row_number().over(within)).join(carry.drop("count"), ["conv", "run"])
    return stored(counted.select("conv", "run", (F.col("row") + F.col("carry")).alias("pos"), "x", "y", "words"), "numbered")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv, n_turns of the rebuilt one) and their rebuilt turns (conv, run, pos, x, y, words).

    The first h turns come from the first conversation of the block of SHARED ids, h = crc32 of the id by 4; the
    conversation's own turns follow after its first h.
    """
    h = (F.crc32(F.col("conv").cast("string")) % (LONGEST + 1)).cast("int")
    sizes = stored(numbered.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    base = (numbered.where((F.col("conv") % SHARED == 0) & (F.col("pos") <= LONGEST)).groupBy("conv")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "words"))).alias("first"))
            .withColumnRenamed("conv", "base"))
    plan = (sizes.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % SHARED).join(base, "base", "left")
            .withColumn("first", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(base.schema["first"].dataType))))
    plan = stored(plan.withColumn("taken", F.size("first")), "plan")
    head = plan.select("conv", F.lit(-1).alias("run"), F.explode("first").alias("t")).select(
        "conv", "run", F.col("t.pos").cast("long").alias("pos"), "t.x", "t.y", "t.words")
    own = join_hot(numbered.withColumn("h", h).where("pos > h"), plan.select("conv", "taken"), ["conv"], sizes)
    own = own.select("conv", "run", (F.col("pos") - F.col("h") + F.col("taken")).cast("long").alias("pos"), "x", "y", "words")
    convs = plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return convs, head.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, words, last) for each turn: hashes of the prefix up to it and of the one before."""
    marks = [F.xxhash64("pos", "x", "y"), F.xxhash64(F.lit(1), "y", "x", "pos")]
    rows = stored(turns.select("conv", "run", "pos", "words", *[m.alias(n) for m, n in zip(marks, "xy")]), "rebuilt")
    within = Window.partitionBy("conv", "run").orderBy("pos")
    whole = Window.partitionBy("conv")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max("pos").alias("top"))
    carry = runs.select("conv", "run", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"c{c}") for c in "xy"],
                        F.max("top").over(whole).alias("n"))
    found = rows.withColumn("a", F.bit_xor("x").over(within)).withColumn("b", F.bit_xor("y").over(within))
    found = found.join(carry, ["conv", "run"])
    a, b = F.col("a").bitwiseXOR(F.col("cx")), F.col("b").bitwiseXOR(F.col("cy"))
    return stored(found.select("conv", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"),
                               b.bitwiseXOR(F.col("y")).alias("up_b"), "words", (F.col("pos") == F.col("n")).alias("last")), "prefixes")


def joined_digests(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """SHA-256 of the ascending, comma-joined values of each key.

    Values are dealt by range and joined in blocks of BLOCK, so a key with very many values reaches the task that digests
    it as few rows, which it streams.
    """
    dealt = stored(rows.select(*keys, value).repartitionByRange(*keys, value).withColumn("run", F.spark_partition_id()), "ends")
    place = F.row_number().over(Window.partitionBy("run", *keys).orderBy(value))
    blocks = dealt.withColumn("block", F.floor((place - 1) / BLOCK)).groupBy("run", *keys, "block").agg(
        F.array_join(F.array_sort(F.collect_list(value)).cast("array<string>"), ",").alias("part"))
    sorted_rows = blocks.repartition(*keys).sortWithinPartitions(*keys, "run", "block").select(*keys, "part")
    schema = sorted_rows.drop("part").schema.add(out, "string")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *key, part in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(part.encode())
            if done:
                yield _batch(done, batch, out)
            last = batch
        if now is not None:
            yield _batch([(*now, digest.hexdigest())], last, out)

    return in_arrow(sorted_rows, run, schema)


def _batch(rows: list[tuple], like: pa.RecordBatch, out: str) -> pa.RecordBatch:
    columns = list(zip(*rows))
    names = like.schema.names[:-1]
    return pa.RecordBatch.from_arrays([pa.array(c, like.schema.field(n).type) for c, n in zip(columns, names)]
                                      + [pa.array(columns[-1], pa.string())], [*names, out])


def _priority(node: str) -> Column:
    """Lowest set bit of the depth, then a hash: on an untouched chain every second node is smaller than its neighbours."""
    depth = F.col(f"{node}.depth")
    return F.struct(depth.bitwiseAND(-depth), F.xxhash64(node), F.col(node))


def subtree_totals(tree: DataFrame, values: list[str], name: str = "contract") -> DataFrame:
    """(node, *values) summed over the subtree of every node of ``tree``: (node, parent, *values), one root without parent.

    ``node`` and ``parent`` are structs with a field ``depth``. Every join is on unique keys; many children of one parent
    meet only in sums, which Spark pre-aggregates.
    """
    links = [f"w_{v}" for v in values]
    active = stored(tree.select("node", "parent", *values, *[F.lit(0).cast("long").alias(w) for w in links]), name)
    raked, squeezed = [], []
    while True:
        kids = active.where("parent is not null").groupBy("parent").agg(
            F.count("*").alias("n"), F.min("node").alias("child")).withColumnRenamed("parent", "node")
        state = stored(active.join(kids, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))), name)
        leaves = state.where("n = 0 and parent is not null")
        raked.append(state.where("n = 0").select("node", *values))
        if state.limit(2).count() < 2:
            break
        gains = leaves.groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(v) + F.col(w)).alias(f"g_{v}") for v, w in zip(values, links)])
        chain = state.where("n = 1 and parent is not null")
        above = chain.select(F.col("child").alias("node"), _priority("node").alias("above"))
        below = state.join(above.select("node"), "node").select(
            F.col("parent").alias("node"), F.col("n").alias("below_n"), _priority("node").alias("below"),
            *[F.col(w).alias(f"b_{w}") for w in links])
        own = _priority("node")
        chosen = chain.join(below, "node").join(above, "node", "left").where(
            (F.col("below_n") > 0) & ((F.col("below_n") != 1) | (own < F.col("below")))
            & (F.col("above").isNull() | (own < F.col("above"))))
        chosen = stored(chosen.select("node", "parent", "child", *values, *links, *[f"b_{w}" for w in links]), name)
        squeezed.append(chosen.select("node", "child", *[(F.col(v) + F.col(f"b_{w}")).alias(v) for v, w in zip(values, links)]))
        moves = chosen.select(F.col("child").alias("node"), F.col("parent").alias("up"),
                              *[(F.col(v) + F.col(w)).alias(f"m_{v}") for v, w in zip(values, links)])
        rest = state.where("n > 0").join(chosen.select("node"), "node", "left_anti")
        rest = rest.join(moves, "node", "left").join(gains, "node", "left")
        zero = F.lit(0)
        active = rest.select("node", F.coalesce("up", "parent").alias("parent"),
                             *[(F.col(v) + F.coalesce(f"g_{v}", zero)).alias(v) for v in values],
                             *[(F.col(w) + F.coalesce(f"m_{v}", zero)).alias(w) for v, w in zip(values, links)])
    done = raked[-1]
    for leaves, chosen in zip(reversed(raked[:-1]), reversed(squeezed)):
        later = done.select(F.col("node").alias("child"), *[F.col(v).alias(f"t_{v}") for v in values])
        back = chosen.join(later, "child").select("node", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
        done = done.unionByName(stored(back, name)).unionByName(leaves)
    return done


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    An empty table has no conversation and gives no rows; repeated rows are turns of their own; further columns are ignored.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    rows = prefixes(turns)
    least = convs.agg(F.min("conv"), F.count("*")).first()
    if not least[1]:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
                "ends_sha256 string")
    found = stored(rows.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    up = ["up", "up_a", "up_b"]
    below = found.withColumn("up", F.col("depth") - 1)
    kids = stored(below.groupBy(*up).agg(F.count("*").alias("n")), "kids")
    names = found.select(F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent_conv"))
    deeper = join_hot(below.where("depth > 1"), names, up, kids.where("up > 0"))
    columns = ["conv", "depth", "a", "b", "parent_conv", "n_convs", "words"]
    number = lambda v: F.lit(v).cast("long")
    top = deeper.sparkSession.range(1).select(
        number(least[0]).alias("conv"), *[number(0).alias(c) for c in ("depth", "a", "b")], number(None).alias("parent_conv"),
        number(least[1]).alias("n_convs"), number(0).alias("words"))
    first = below.where("depth = 1").withColumn("parent_conv", F.lit(least[0]).cast("long"))
    children = kids.select(F.col("up").alias("depth"), F.when(F.col("up") > 0, F.col("up_a")).otherwise(0).alias("a"),
                           F.when(F.col("up") > 0, F.col("up_b")).otherwise(0).alias("b"), F.col("n").alias("n_children"))
    children = children.groupBy("depth", "a", "b").agg(F.sum("n_children").alias("n_children"))
    ends = joined_digests(rows.where("last").select("depth", "a", "b", "conv").unionByName(
        convs.where("n_turns = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b")], "conv")),
        ["depth", "a", "b"], "conv", "ends_sha256")
    keys = ["depth", "a", "b"]
    nodes = deeper.select(*columns).unionByName(first.select(*columns)).unionByName(top)
    nodes = nodes.join(children, keys, "left").join(ends, keys, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    nodes = stored(nodes.withColumn("node", F.struct("conv", "depth")), "trie")
    tree = nodes.select("node", F.when(F.col("depth") > 0, F.struct(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")))
                        .alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    return nodes.join(totals, "node").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")


ship_by_value(__name__)
