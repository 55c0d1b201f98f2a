"""Token-id shards in training order, by a keyed permutation of all sequences.

Texts become rows of ``stride`` ids. Every sequence gets a number without gaps, a Feistel network with cycle-walking maps
the numbers one to one onto slots, and range partitions of the slots write binary shards in which slot s lies at a
fixed place. A reader can start at any slot and read on; a writer that runs again replaces a shard with the same bytes.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from evidloom.llm.bpe import default_tokenizer, encoder
from evidloom.llm.remote import opened, whole_file
from evidloom.llm.storage import shared_folder, stored
from evidloom.llm.workers import in_arrow, key_and_text, slices
from evidloom.shipping import ship_by_value

#: ids of a sequence, id that ends a text and fills its last sequence, sequences of a shard, rounds of the network
STRIDE, END_ID, SHARD, ROUNDS, KEY = 256, 50256, 32_768, 6, 20240229
#: range partitions at most; each writes as many shards, one after another, as fall to it
PARTS = 20_000
#: words whose ids a worker keeps from the counting to the encoding, which reads the same texts (some 60 MB when full)
WORDS = 1_000_000


def feistel(number: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers, a permutation of 0 ... total - 1; values beyond it walk on along their cycle."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    value = number.astype(np.uint64)

    def once(v):
        left, right = v >> np.uint64(half), v & low
        with np.errstate(over="ignore"):
            for r in range(ROUNDS):
                x = (right + np.uint64(key) + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    value = once(value)
    while (out := np.flatnonzero(value >= total)).size:
        value[out] = once(value[out])
    return value.astype(np.int64)


def _zstd():
    """Functions that compress a block of bytes and give it back.

    Those of zstandard keep their tables between blocks, which is several times quicker for blocks as small as a sequence;
    where it is not installed, Arrow's take its place. Both read what the other wrote.
    """
    try:
        import zstandard
    except ImportError:
        codec = pa.Codec("zstd", compression_level=1)
        return (lambda block: codec.compress(block, asbytes=True)), (lambda block, size: codec.decompress(block, size, asbytes=True))
    unpacker = zstandard.ZstdDecompressor()
    return zstandard.ZstdCompressor(level=1).compress, (lambda block, size: unpacker.decompress(block, size))


def _unpack(blocks: list[bytes], stride: int) -> np.ndarray:
    """Bytes of the ids of each sequence, one row for each."""
    back = _zstd()[1]
    planes = np.frombuffer(b"".join([back(x, 2 * stride) for x in blocks]), np.uint8).reshape(-1, 2, stride)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(-1, 2 * stride)


def _filled(ids: np.ndarray, offsets: np.ndarray, stride: int):
    """Sequences of a slice as rows of ids, with the text, the place in it and the ids of the text in each."""
    size = np.diff(offsets) + 1
    count = -(-size // stride)
    first = np.cumsum(count) - count
    rows = np.full((int(count.sum()), stride), END_ID, "<u2")
    place = np.repeat(first * stride - offsets[:-1], size - 1) + np.arange(len(ids))
    rows.ravel()[place] = ids
    text = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(rows)) - first[text]
    return rows, text, piece, np.minimum(stride, size[text] - piece * stride)


def _encoded(batches, path: str, stride: int):
    import pyarrow.compute  # noqa: F401
    for batch in batches:
        for some in slices(batch, "text"):
            yield some.column(0), *encoder(path, WORDS).encode(some.column(1))


def sequence_counts(rows: DataFrame, stride: int, path: str) -> DataFrame:
    """(part, n): sequences of each task of the scan."""
    def run(batches):
        import pyarrow.compute  # noqa: F401
        n = sum(int((-(-(encoder(path, WORDS).counts(some.column(1)) + 1) // stride)).sum())
                for batch in batches for some in slices(batch, "text"))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n])], ["part", "n"])

    return in_arrow(rows, run, "part int, n long")


def in_training_order(df: DataFrame, key: str, text: str, stride: int = STRIDE, path: str | None = None,
                      permutation: int = KEY) -> tuple[DataFrame, int]:
    """(key, piece, slot, n_tokens, packed) of every whole text's ids and an end id, cut into sequences; and their number.

    The last sequence of a text is filled with end ids. A null or empty text is one sequence of end ids. Texts are encoded
    twice, first to count the sequences of each task, so that no copy of all ids is kept besides the shuffle; the number
    of each task's sequences reaches the driver. A task that finds other counts than the first time fails.
    """
    path = path or default_tokenizer()
    if encoder(path).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("shards hold ids as 16-bit numbers; this vocabulary has more than 65,536")
    rows = key_and_text(df, key, text)
    counts = {r.part: r.n for r in sequence_counts(rows, stride, path).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    sent = df.sparkSession.sparkContext.broadcast((before, counts))
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("piece", IntegerType()),
                         StructField("slot", LongType()), StructField("n_tokens", IntegerType()),
                         StructField("packed", BinaryType())])

    def run(batches):
        part, local, packed = TaskContext.get().partitionId(), 0, _zstd()[0]
        for keys, ids, offsets in _encoded(batches, path, stride):
            filled, text, piece, size = _filled(ids, offsets, stride)
            # high bytes, then low bytes: smaller when compressed than ids in their order
            planes = np.ascontiguousarray(filled.view(np.uint8).reshape(-1, stride, 2).transpose(0, 2, 1)).reshape(len(filled), -1)
            slot = feistel(sent.value[0][part] + local + np.arange(len(filled)), total, permutation)
            local += len(filled)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(slot), pa.array(size.astype(np.int32)),
                 pa.array([packed(p) for p in planes], pa.binary())], schema.fieldNames())
        if local != sent.value[1].get(part, 0):
            raise RuntimeError("the input gave other rows to this task when its sequences were counted")

    return in_arrow(rows, run, schema), total


def write_shards(ordered: DataFrame, total: int, folder: str, stride: int = STRIDE, shard: int = SHARD) -> DataFrame:
    """Write shard-NNNNNN.bin files of ``shard`` slots and return (key, piece, slot, shard, byte_offset, n_tokens, ids_crc32)."""
    shards = max(1, -(-total // shard))
    parts = min(shards, PARTS)
    dealt = (ordered.withColumn("shard", F.floor(F.col("slot") / shard))
             .repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot").select("key", "piece", "slot", "shard", "n_tokens", "packed"))
    schema = StructType([*(dealt.schema[c] for c in ("key", "piece", "slot", "shard")), StructField("byte_offset", LongType()),
                         StructField("n_tokens", IntegerType()), StructField("ids_crc32", LongType())])

    def run(batches):
        current, rows = None, []
        for batch in batches:
            shard_ids = batch.column(3).to_numpy()
            for low, high in _runs(shard_ids):
                if shard_ids[low] != current:
                    if rows:
                        yield close(current, rows)
                    current, rows = shard_ids[low], []
                rows.append(batch.slice(low, high - low))
        if rows:
            yield close(current, rows)

    def close(number, rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        data = [row.tobytes() for row in _unpack(table.column("packed").to_pylist(), stride)]
        whole_file(f"{folder}/shard-{number:06d}.bin", data)
        slots = table.column("slot").to_numpy()
        return pa.Table.from_arrays(
            [*table.columns[:4], pa.array((slots - number * shard) * 2 * stride), table.column("n_tokens"),
             pa.array([zlib.crc32(d) for d in data], pa.int64())], schema.fieldNames()).combine_chunks().to_batches()[0]

    return in_arrow(dealt, run, schema)


def _runs(values: np.ndarray):
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def read_slots(folder: str, first: int, count: int, stride: int = STRIDE, shard: int = SHARD):
    """Sequences of the slots from ``first`` on, as arrays of ids; stops at the end of the last shard."""
    slot = first
    while slot < first + count:
        store, path = opened(f"{folder}/shard-{slot // shard:06d}.bin")
        try:
            file = store.open_input_file(path)
        except FileNotFoundError:
            return
        with file:
            n = min(first + count - slot, shard - slot % shard)
            data = np.frombuffer(file.read_at(n * 2 * stride, slot % shard * 2 * stride), "<u2")
        yield from data.reshape(-1, stride)
        if len(data) < n * stride:
            return
        slot += n


def materialise(df: DataFrame, key: str, text: str, folder: str | None = None, stride: int = STRIDE) -> DataFrame:
    """Write all texts of ``df`` as shards in training order; one row for each sequence tells where it lies.

    Null and empty texts are sequences of end ids; rows with null or repeated keys are sequences like any other; an empty
    table writes no shard and gives no row; further columns are not read.
    """
    folder = folder or shared_folder(df.sparkSession, "shards")
    ordered, total = in_training_order(df, key, text, stride)
    return stored(write_shards(ordered, total, folder, stride), "shard-rows").withColumnRenamed("key", key)


ship_by_value(__name__)
