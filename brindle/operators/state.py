"""Stored state: documents that may be missing or broken, settings merged over defaults, JSON columns, capped logs."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.warehouse import append_capped

#: Settings of the pattern store before any is written.
PATTERN_SETTINGS = {"enabled": False, "threshold": 3, "min_similarity": 0.85}


def load_document(spark: SparkSession, path: str, default: Any = None) -> Any:
    """The JSON document in a file of any file system that Spark knows; ``default`` if it is missing, empty or broken."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        return json.loads(rows[0]["value"]) if rows else default
    except Exception:  # a missing path and a broken document are the same to the caller
        return default


def merged_settings(defaults: dict, *layers: dict | None) -> dict:
    """Defaults with the keys of each further layer put over them, the last one winning; only the first level is merged.
    A layer that is null or no object changes nothing."""
    out = dict(defaults)
    for layer in layers:
        out.update(layer if isinstance(layer, dict) else {})
    return out


def changed_settings(settings: DataFrame, log: DataFrame, key: str, value: Any, now: float, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(settings, log) of (key, value) and (at, event, payload) rows after one setting is changed; the change is logged."""
    spark = settings.sparkSession
    row = spark.createDataFrame([(key, json.dumps(value))], "key string, value string")
    entry = spark.createDataFrame([(now, f"set_{key}", json.dumps({"value": value}))], "at double, event string, payload string")
    return settings.where(F.col("key") != key).unionByName(row), append_capped(log, entry, cap)


def logged(log: DataFrame, events: DataFrame, cap: int = 1000) -> DataFrame:
    """A log (at, event, payload) with the rows of ``events`` (at, event, and any others) appended: all other columns that are
    not null become the payload. The log keeps its last ``cap`` entries."""
    others = [c for c in events.columns if c not in ("at", "event")]
    entry = events.select("at", "event", F.to_json(F.struct(*others)).alias("payload") if others else F.lit("{}").alias("payload"))
    return append_capped(log, entry, cap)


def last_entries(log: DataFrame, limit: int = 50) -> DataFrame:
    """The last entries of a log in order of time: a top-k report."""
    return log.orderBy(F.desc("at")).limit(limit).orderBy("at")


def encoded(value: Column) -> Column:
    """JSON text of an array, struct or map; null stays null."""
    return F.to_json(value)


def decoded_tags(text: Column) -> Column:
    """Array of a JSON list of strings; null, broken and other JSON give an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decoded_object(text: Column) -> Column:
    """Map of a JSON object's first level, values as text; null and broken JSON give an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def public(rows: DataFrame) -> DataFrame:
    """Rows without the columns whose names begin with an underscore."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")])


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one JSON object, without its internal columns; nulls are written."""
    kept = public(rows)
    return kept.select(F.to_json(F.struct(*kept.columns), {"ignoreNullFields": "false"}).alias("json"))
