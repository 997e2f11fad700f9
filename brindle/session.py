"""Session helpers: settings, table access, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that the engine expects of every session. All are safe on a cluster; sizes are left to the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("brindle")
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without it, as in tests, gets
    a temporary folder; elsewhere no executor could read that, so a ``RuntimeError`` tells what is missing.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for a broadcast join if its rows take at most ``max_bytes``; otherwise leave the join to shuffle.

    The bytes are counted, not estimated: those of each row's columns as text, and 16 a column. Counting stops as soon as
    so many rows are seen that even empty ones are too many.
    """
    width = 16 * max(1, len(df.columns))
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(width))
    total = df.limit(max_bytes // width + 1).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= max_bytes else df


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: int = 100_000, parts: int = 32) -> DataFrame:
    """Join of ``many`` rows with at most a few rows of ``one`` per key, in which no key is a single task's work.

    Keys that more than ``hot`` rows of ``many`` have are dealt into ``parts`` by a hash of their rows, and only for those
    keys are the rows of ``one`` repeated. There can't be more such keys than rows / ``hot``; their list is broadcast if its
    size allows it. ``how`` is inner, left, left_semi or left_anti.
    """
    busy = many.groupBy(key).count().where(F.col("count") > hot).select(key, F.lit(True).alias("_busy"))
    if busy.isEmpty():
        return many.join(one, key, how)
    busy = bounded_broadcast(busy)
    dealt = many.join(busy, key, "left").withColumn("_part", F.when(F.col("_busy"), F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.lit(parts)).cast("int")).otherwise(0)).drop("_busy")
    copies = F.when(F.col("_busy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    repeated = one.join(busy, key, "left").withColumn("_part", F.explode(copies)).drop("_busy")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their number from 1 in the order of some columns, which should tell them apart.

    Rows are sorted over range partitions and numbered within them; only the partitions' counts, as many as there are
    partitions, come to the driver. No task holds all rows.
    """
    ranged = checkpointed(df.repartitionByRange(blocks(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def skipping_empty(run):
    """A ``mapInPandas`` function without its empty frames, whose columns may lack the types that Arrow needs."""

    def some(batches):
        for frame in run(batches):
            if len(frame):
                yield frame

    return some


def blocks(spark: SparkSession, least: int = 1) -> int:
    """Number of hash blocks for work that is spread by hand: that of the shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_of_bytes(spark: SparkSession, total: int, per_block: int) -> int:
    """Number of hash blocks so that each is meant to hold ``per_block`` bytes of ``total``; at least ``blocks``."""
    return blocks(spark, -(-int(total) // max(1, per_block)))
