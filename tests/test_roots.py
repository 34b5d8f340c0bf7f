"""Tables that are columns of one plan, over more than one partition, where ids are not places."""

from pyspark.sql import functions as F

import loomframe as lf
from loomframe.plans.frame import Frame
from loomframe.queries import QUERIES


def test_arithmetic_of_several_partitions_keeps_every_point(spark):
    f = Frame.from_spark(spark.range(1000, numPartitions=4).select("id", (F.col("id") % 7 + 1).alias("a"), (F.col("id") % 5).alias("b")))
    a, b = f.features.copy("a"), f.features.copy("b")
    b.features.setNames(["a"])
    for got in (a + b, a * 2 - b / (abs(-a) + 1), lf.calculate.residuals(b, a)):
        both, x, y = f._beside(got)
        assert both is f._df  # columns of one plan: no join
        assert both.select(x[0], y[0]).count() == 1000
    both, x, y = f._beside(a + b)
    assert {tuple(r) for r in both.select(x[0], y[0]).collect()} == {(i, i % 7 + 1 + i % 5) for i in range(1000)}


def test_queries_of_several_partitions_keep_every_row(spark, tmp_path):
    rows = spark.range(400, numPartitions=4).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 9 + 1).cast("double").alias("l_quantity"), (F.col("id") % 3 / 100).alias("l_tax"), (F.col("id") % 11).cast("double").alias("l_extendedprice"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("elementwise_add", "elementwise_sub", "elementwise_mul", "elementwise_truediv", "residuals"):
        assert QUERIES[name](spark, str(tmp_path)).select("l_orderkey").distinct().count() == 400, name


def test_sums_of_sums_do_not_grow_without_end(spark):
    a = lf.data([[1], [2]])
    b = a + a
    for _ in range(18):
        a, b = b, a + b
    assert [r[0] for r in b.copy("pythonlist")] == [10946, 21892]
    assert b._root is None or b._root[2] <= 2_000


def test_points_of_a_mask_are_places(spark):
    f = Frame.from_spark(spark.range(40, numPartitions=4).select((F.col("id") + 1).alias("v")))
    assert f._point_ids([i >= 35 for i in range(40)]) == list(range(35, 40))
    assert f._df.filter(F.col("__pid") >= 35).count() == 5


def test_replacing_leaves_the_other_columns(spark):
    f = lf.data([[1, 2], [3, 4]], featureNames=["a", "b"])
    g = f.features.copy(["a", "b"])
    ten = f.features.copy("b") * 10
    ten.features.setNames(["ten"])
    g.features.replace(ten, "a")
    assert [list(r) for r in g.copy("pythonlist")] == [[20, 2], [40, 4]]
    assert [list(r) for r in f.copy("pythonlist")] == [[1, 2], [3, 4]]
