"""Streaming jobs: message triage to an append-only log, and running dialogue texts."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidloom import fixed_values as fv
from evidloom.shipping import ship_by_value

ship_by_value(__name__)


def start_triage_stream(source: DataFrame, log_rows: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                        once: bool = False) -> StreamingQuery:
    """Run ``log_rows`` (triage and log-row selection) on every micro-batch and append the result below ``sink``.

    Each batch overwrites its own ``batch=<id>`` folder, so a batch that is repeated after a failure leaves no copies.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        log_rows(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dialogue_stream(source: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Running text of every conversation from a stream of ``(conv_id, turn, text)``, as ``dialogue_accumulate`` gives it.

    The state of a key is its text and its last turn. Turns of one micro-batch are sorted. A turn that arrives after a
    later one was given out can't change what was said: it comes out with ``late`` set and no text, and the state stays.
    NULL texts add nothing. With ``idle_ms`` the state of a silent conversation is dropped after that time.
    """
    before, after = fv.FOLLOW_UP

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns = pd.concat(list(chunks)).sort_values("turn", kind="stable")
        text, last = state.get if state.exists else (None, None)
        texts, late = [], []
        for turn, part in zip(turns["turn"], turns["text"]):
            late.append(last is not None and turn < last)
            if not late[-1]:
                last = int(turn)
                if part is not None:
                    text = part if text is None else f"{text}{before}{part.replace('_', ' ')}{after}"
            texts.append(None if late[-1] else text or "")
        state.update((text, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": key[0], "turn": turns["turn"], "dialogue": texts, "late": late})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return source.groupBy("conv_id").applyInPandasWithState(
        advance, "conv_id long, turn long, dialogue string, late boolean", "text string, last long", "append", timeout)
