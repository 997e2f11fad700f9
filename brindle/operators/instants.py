"""Normalised instants of every message table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.timestamps import utc_us
from brindle.session import bounded_broadcast


def with_clock(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """Rows with ``_zone`` and ``_order`` of their ``channel``; null where the channel is null or unknown.

    A channel that the clock lists more than once counts by its least (zone, order), so rows never multiply.
    """
    key = lambda c: F.lower(F.trim(c))
    known = clock.groupBy(key(F.col("channel")).alias("_channel")).agg(F.min(F.struct("zone", "date_order")).alias("_clock"))
    known = known.select("_channel", F.col("_clock.zone").alias("_zone"), F.col("_clock.date_order").alias("_order"))
    return rows.join(bounded_broadcast(known), key(rows["channel"]) == known["_channel"], "left").drop("_channel")


def instants(values: DataFrame, clock: DataFrame) -> DataFrame:
    """(ref_table, record_id, msg_index, channel, value) rows to distinct (ref_table, record_id, msg_index, utc_us).

    Values that denote no instant have no row; see ``to_utc_us``. Repeated rows give one row. Extra columns are dropped.
    An empty table gives an empty result.
    """
    timed = with_clock(values.select("ref_table", "record_id", "msg_index", "channel", "value"), clock)
    timed = timed.select("ref_table", "record_id", "msg_index", utc_us("value", "_zone", "_order").alias("utc_us"))
    return timed.where(F.col("utc_us").isNotNull()).distinct()


def message_values(triage: DataFrame, sent: DataFrame, threads: DataFrame) -> DataFrame:
    """All timestamp values of the three message tables, in one shape."""

    def flat(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(key).cast("string").alias("record_id"), F.lit(0).alias("msg_index"), "channel", F.col(value).alias("value"))

    inner = threads.select(F.col("id").alias("record_id"), "channel", F.posexplode("messages").alias("msg_index", "message"))
    inner = inner.select(F.lit("sample_email_thread").alias("ref_table"), "record_id", "msg_index", "channel", F.col("message.date").alias("value"))
    return flat(triage, "sample_messages_for_triage", "id", "received_at").unionByName(flat(sent, "sent_messages", "sent_id", "sent_at")).unionByName(inner)
