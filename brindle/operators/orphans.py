"""References to records that do not exist, by bitmap difference.

Keys are dictionary-encoded to integers within hash ranges. Per range and month there is one bitmap of the codes that
are referred to and one of the codes whose record was stored before that month; the difference of the two holds every
reference that may be an orphan, and its bits are decoded to keys. References of the month in which a record was stored
survive that step, so the decoded rows are held against the record's own time at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import blocks_of_bytes

#: A container of a bitmap holds this many codes, as in the usual compressed bitmap layouts.
CONTAINER = 1 << 16
#: A container with at most this many bits is kept as a sorted array of 16-bit integers, else as packed bits.
SPARSE = 4096
#: Bytes of keys that one range is meant to hold.
RANGE_BYTES = 16 << 20
#: Parts into which the references of one (key, month) are dealt for the join with the decoded rows.
SALT = 16
NO_MONTH = -(1 << 30)
SEPARATOR = "\x1f"


class Bitmap:
    """Compressed bitmap over non-negative integers."""

    def __init__(self, codes: np.ndarray = np.empty(0, np.int64)):
        self.parts: dict[int, np.ndarray] = {}
        self.add(codes)

    def add(self, codes: np.ndarray) -> None:
        codes = np.unique(codes.astype(np.int64))
        cuts = np.flatnonzero(np.diff(codes // CONTAINER)) + 1
        for own in np.split(codes, cuts) if len(codes) else ():
            h, low = int(own[0] // CONTAINER), (own % CONTAINER).astype(np.uint16)
            if h in self.parts:
                low = np.union1d(np.flatnonzero(self._bits(self.parts[h])).astype(np.uint16) if self.parts[h].dtype == np.uint8 else self.parts[h], low)
            self.parts[h] = self._pack(low)

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= SPARSE:
            return low
        bits = np.zeros(CONTAINER, bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray) -> np.ndarray:
        if part.dtype == np.uint8:
            return np.unpackbits(part).astype(bool)
        bits = np.zeros(CONTAINER, bool)
        bits[part] = True
        return bits

    def and_not(self, other: Bitmap) -> np.ndarray:
        """Codes of this bitmap that the other one lacks, in order."""
        left = []
        for h, part in self.parts.items():
            if h not in other.parts:
                low = np.flatnonzero(self._bits(part)) if part.dtype == np.uint8 else part
            elif part.dtype == np.uint16 and other.parts[h].dtype == np.uint16:
                low = np.setdiff1d(part, other.parts[h], assume_unique=True)
            else:
                low = np.flatnonzero(self._bits(part) & ~self._bits(other.parts[h]))
            left.append(low.astype(np.int64) + h * CONTAINER)
        return np.concatenate(left) if left else np.empty(0, np.int64)


def clean_key(key: Column) -> Column:
    """A key without outer white space (of any script) and letter case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(key, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")), F.lit(""))


def month_of(seconds: Column) -> Column:
    """Months since year 0 of epoch seconds, ``NO_MONTH`` for null and NaN."""
    at = F.timestamp_seconds(F.when(F.isnan(seconds), None).otherwise(seconds))
    return F.coalesce((F.year(at) * 12 + F.month(at) - 1).cast("int"), F.lit(NO_MONTH))


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of keys: encode, build the bitmaps of each month, subtract, decode.

    The bitmap of records grows from month to month, so each record is added once.
    """
    codes, keys = pd.factorize(pdf["target"] + SEPARATOR + pdf["key"])
    months, stored = pdf["month"].to_numpy(np.int64), pdf["is_parent"].to_numpy(bool)
    first, has = np.full(len(keys), np.nan), np.zeros(len(keys), bool)
    has[codes[stored]] = True
    first[codes[stored]] = pdf["first_at"].to_numpy(float)[stored]
    parents, since = codes[stored], months[stored]
    order = np.argsort(since, kind="stable")
    parents, since = parents[order], since[order]
    refs, ref_months = codes[~stored], months[~stored]
    order = np.argsort(ref_months, kind="stable")
    refs, ref_months = refs[order], ref_months[order]
    names, starts = np.unique(ref_months, return_index=True)
    present, added = Bitmap(), 0
    left, left_months = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # A reference without time counts against records of any time, so it comes last.
    for k in sorted(range(len(names)), key=lambda k: (names[k] == NO_MONTH, names[k])):
        upto = len(since) if names[k] == NO_MONTH else int(np.searchsorted(since, names[k], side="left"))
        present.add(parents[added:upto])
        added = max(added, upto)
        own = Bitmap(refs[starts[k] : starts[k + 1] if k + 1 < len(starts) else None]).and_not(present)
        left.append(own)
        left_months.append(np.full(len(own), names[k]))
    code = np.concatenate(left)
    split = [keys[c].split(SEPARATOR, 1) for c in code]
    # A record without time counts as stored ever since: it is held in every month's bitmap and never decoded.
    return pd.DataFrame({"target": [t for t, _ in split], "key": [k for _, k in split], "month": np.concatenate(left_months).astype("int32"), "parent_at": pd.array(np.where(has[code], first[code], np.nan), dtype="Float64"), "has_parent": has[code]}).astype({"target": object, "key": object})


def orphans(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Orphan references: (ref_table, ref_field, record_id, month), distinct; month is null where the row has no time.

    refs: (ref_table, ref_field, record_id, target, key, at); records: (target, key, at); times in epoch seconds.
    A reference is an orphan if its key, without outer white space and letter case, is no record's key of its target,
    or if the first such record's time is after the reference's. Blank and null keys are no references. Without a time
    of either side only presence counts. Repeated rows count once. Empty tables give an empty result.

    Keys are reduced to one row per (key, month) before any shuffle by key, so a key that most rows name costs no
    more than any other; the join back deals the rows of a key into ``SALT`` parts.
    """
    spark = refs.sparkSession
    seconds = lambda c: F.when(F.isnan(c), None).otherwise(c.cast("double"))
    refs = refs.select("ref_table", "ref_field", F.col("record_id").cast("string").alias("record_id"), "target", clean_key(F.col("key")).alias("key"), seconds(F.col("at")).alias("at"))
    refs = refs.where(F.col("key").isNotNull()).withColumn("month", month_of(F.col("at")))
    kept = records.select("target", clean_key(F.col("key")).alias("key"), F.coalesce(seconds(F.col("at")), F.lit(float("-inf"))).alias("at")).where(F.col("key").isNotNull())
    stored, kept = kept, kept.groupBy("target", "key").agg(F.min("at").alias("first_at"))
    no_time = F.col("first_at") == float("-inf")
    kept = kept.select("target", "key", F.when(no_time, NO_MONTH).otherwise(month_of(F.when(~no_time, F.col("first_at")))).alias("month"), "first_at", F.lit(True).alias("is_parent"))
    named = refs.select("target", "key", "month").distinct().select("target", "key", "month", F.lit(0.0).alias("first_at"), F.lit(False).alias("is_parent"))
    size = lambda df: df.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0))).first()[0]
    ranges = blocks_of_bytes(spark, size(refs) + size(stored), RANGE_BYTES)
    both = kept.unionByName(named).withColumn("range", F.pmod(F.xxhash64("target", "key"), F.lit(ranges)))
    left = both.groupBy("range").applyInPandas(lambda pdf: _survivors(pdf), "target string, key string, month int, parent_at double, has_parent boolean")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = refs.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALT)).cast("int"))
    found = dealt.join(left, ["target", "key", "month", "salt"]).where(~F.col("has_parent") | (F.col("parent_at") > F.col("at")))
    month = F.when(F.col("month") != NO_MONTH, F.format_string("%04d-%02d", F.floor(F.col("month") / 12), F.col("month") % 12 + 1))
    return found.select("ref_table", "ref_field", "record_id", month.alias("month")).distinct()


def store_references(chunks: DataFrame, contradictions: DataFrame) -> DataFrame:
    """The references of the text store's tables, as ``orphans`` takes them."""
    own = chunks.select(F.lit("chunks").alias("ref_table"), F.lit("source_id").alias("ref_field"), F.col("chunk_id").alias("record_id"), F.lit("sources").alias("target"), F.col("source_id").alias("key"), F.col("ingested_at").alias("at"))
    sides = contradictions.select(F.col("id").cast("string").alias("record_id"), F.col("detected_at").alias("at"), F.explode(F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("chunk_a", "chunk_b")))).alias("r"))
    sides = sides.select(F.lit("contradiction_log").alias("ref_table"), "r.ref_field", "record_id", F.lit("chunks").alias("target"), "r.key", "at")
    return own.unionByName(sides)


def store_records(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The records that references of the text store name."""
    one = sources.select(F.lit("sources").alias("target"), F.col("source_id").alias("key"), F.col("ingested_at").alias("at"))
    return one.unionByName(chunks.select(F.lit("chunks").alias("target"), F.col("chunk_id").alias("key"), F.col("ingested_at").alias("at")))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, field and month."""
    return found.groupBy("ref_table", "ref_field", "month").agg(F.count("*").alias("n_orphans"), F.countDistinct("record_id").alias("n_records"))
