"""Structured Streaming forms of the operators that run on feeds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.functions.text import content_hash
from brindle.operators.messages import TriageConfig, triage


def triage_stream(messages: DataFrame, now: float, config: TriageConfig = TriageConfig()) -> DataFrame:
    """``triage`` over a feed: it holds no state, so the batch operator serves as it is."""
    return triage(messages, now, config)


def first_texts(chunks: DataFrame, time: str = "ingested", delay: str = "1 day") -> DataFrame:
    """Chunks of a feed whose text is new within the watermark; state is bounded by ``delay``.

    Against all history, use ``upsert_batch`` with ``foreachBatch``.
    """
    hashed = chunks.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def upsert_batch(known: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the rows of a batch whose text no stored chunk has."""

    def run(batch: DataFrame, _: int) -> None:
        hashed = batch.withColumn("content_hash", content_hash(F.col("text")))
        write(hashed.join(known().select("content_hash").distinct(), "content_hash", "left_anti"))

    return run


def counted_by_window(messages: DataFrame, time: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(window, channel, n_messages): messages per channel and window; rows later than ``delay`` are left out."""
    return messages.withWatermark(time, delay).groupBy(F.window(time, width), "channel").agg(F.count("*").alias("n_messages"))


def streak_stream(outcomes: DataFrame, threshold: int = 3) -> DataFrame:
    """(key, seq, streak, eligible) over a feed of (key, seq, unchanged): one number of state per key.

    Rows of one key are taken in order of ``seq`` within a batch; the batches' own order is that of the feed.
    """

    def run(key: tuple, batches, state: GroupState):
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, unchanged in zip(rows["seq"], rows["unchanged"], strict=True):
            streak = streak + 1 if unchanged else 0
            out.append((key[0], seq, streak, streak >= threshold))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["key", "seq", "streak", "eligible"])

    return outcomes.groupBy("key").applyInPandasWithState(run, "key string, seq long, streak long, eligible boolean", "streak long", "append", GroupStateTimeout.NoTimeout)
