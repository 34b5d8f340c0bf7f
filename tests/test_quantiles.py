"""Exact quantiles of columns that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomframe as lf
from loomframe.plans import quantiles
from loomframe.plans.frame import Frame
from loomframe.plans.quantiles import exact_quantiles

P = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("few", [5, 40])
def test_as_the_exact_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    i = F.col("id")
    columns = {
        "spread": F.sin(i * 1.0) * F.pow(F.lit(10.0), i % 40), "equal": F.lit(3.5), "halves": F.when(i % 50 == 0, i * 1e-6).otherwise(i % 2), "integers": i % 11, "holes": F.when(i % 3 == 0, i),
        "infinite": F.when(i % 5 == 0, float("inf")).when(i % 7 == 0, float("-inf")).otherwise(F.cos(i * 1.0)), "missing": F.lit(None).cast("double"), "one": F.when(i == 77, 2.5),
    }
    df = spark.range(4001, numPartitions=5).select(*[c.cast("double").alias(n) for n, c in columns.items()]).cache()
    got = exact_quantiles(df, [F.col(n) for n in columns], P)
    want = df.agg(*[F.percentile(n, F.array(*map(F.lit, P))) for n in columns]).first()
    for n, a, b in zip(columns, got, want, strict=True):
        assert a == (list(b) if b else [None] * len(P)), n


def test_statistics_take_no_exact_percentile(spark):
    f = Frame.from_spark(spark.range(3000, numPartitions=3).select((F.col("id") * 7919 % 3001).alias("a"), F.col("id").cast("string").alias("t")))
    a = np.array([i * 7919 % 3001 for i in range(3000)])
    median, quarters, deviation = (f.feature_statistics(s) for s in ("median", "quartiles", "median absolute deviation"))
    assert not any("percentile(" in str(x._jdf.queryExecution().toString()).lower() for x in (median, quarters, deviation))
    assert median.first()[0] == np.median(a) and list(quarters.first()[0]) == np.percentile(a, [25, 50, 75]).tolist()
    assert deviation.first()[0] == np.median(np.abs(a - np.median(a)))
    assert median.first()[1] != median.first()[1]  # not of numbers


def test_medians_of_fills_and_of_all_cells(spark):
    f = lf.data([[1.0, 5.0], [None, 7.0], [3.0, None], [8.0, 2.0]], featureNames=["a", "b"])
    assert f.median() == 4.0 and f.medianAbsoluteDeviation() == 2.5
    f.features.fillMatching("median", lf.match.missing)
    assert f.copy("pythonlist") == [[1.0, 5.0], [3.0, 7.0], [3.0, 5.0], [8.0, 2.0]]
