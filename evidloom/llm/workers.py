"""What tasks of this subpackage share: slices of Arrow batches, per-worker state, output batches."""
from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidloom.shipping import ship_by_value

#: bytes of text that one step works on; a longer text is a slice of its own
SLICE_BYTES = 500_000
#: bytes of a batch, which the JVM and a Python worker each hold
BATCH_BYTES = 4 << 20


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over all of its tasks."""
    module = sys.modules.setdefault("_evidloom_worker_state", types.ModuleType("_evidloom_worker_state"))
    return module.__dict__.setdefault("state", {})


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.frombuffer(pa.compute.binary_length(column).fill_null(0).cast(pa.int64()).buffers()[1], np.int64,
                          len(column)) if len(column) else np.zeros(0, np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for low, high in zip(edges, [*edges[1:], len(column)]):
        yield batch.slice(low, high - low)


def give_back() -> None:
    """Freed memory of this process goes back to the system, so that the stages of a long job do not add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, in a worker that frees what a task leaves: its functions are cycles of objects."""
    def task(batches):
        give_back()
        yield from run(batches)
        give_back()

    return task


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow of a tidied ``run``, over batches of about BATCH_BYTES.

    Spark takes the size from the session when it evaluates the result, so it is set there, unless the session has a
    value of its own. No result depends on it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def map_slices(df: DataFrame, text: str, step: Callable[[pa.RecordBatch], dict], schema: StructType) -> DataFrame:
    """Apply ``step`` to slices of whole texts; it gives the columns of ``schema`` by name."""
    import pyarrow.compute  # noqa: F401
    names = schema.fieldNames()

    def run(batches):
        import pyarrow.compute  # noqa: F401
        for batch in batches:
            for part in slices(batch, text):
                out = step(part)
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names)

    return in_arrow(df, run, schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def key_and_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that further columns can't clash."""
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


ship_by_value(__name__)
