"""Checkpoints, checked broadcasts and joins with hot keys."""

import pytest
from pyspark.sql import functions as F

from brindle import session


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("D", (), {"isDefined": lambda self: False})()})())

        @staticmethod
        def getConf():
            return {}

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpointed(Frame())
    assert session.checkpointed(spark.range(3)).count() == 3


def test_broadcasts_are_checked_by_bytes(spark):
    rows = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    hinted = lambda df: df is not rows and bool(df._jdf.queryExecution().logical().getClass().getSimpleName().endswith("Hint"))
    assert hinted(session.bounded_broadcast(rows, 200_000)) and not hinted(session.bounded_broadcast(rows, 50_000))
    assert hinted(session.bounded_broadcast(rows.limit(0)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, how):
    many = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id").union(spark.createDataFrame([(None, 1), (99, 2)], "k long, id long"))
    one = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (8, "d"), (None, "e")], "k long, v string")
    plain = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
    spread = session.spread_join(many, one, "k", how, hot=20, parts=4)
    assert spread.columns == many.join(one, "k", how).columns and sorted(map(tuple, spread.collect()), key=str) == plain
    assert session.spread_join(many.limit(0), one, "k", how, hot=20).count() == 0
