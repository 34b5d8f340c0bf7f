"""Folds are parts of one plan, so that training and scoring them takes no join and no ranking."""

from pyspark.sql import functions as F

import loomframe as lf
from loomframe.functions import calculate as C
from loomframe.learn.tuning import GroupFoldIterator, KFold, KFoldIterator
from loomframe.plans import frame as frames
from loomframe.plans.frame import Frame


def table(spark, n=60):
    f = Frame.from_spark(spark.range(n, numPartitions=4).select((F.col("id") * 7 % n).alias("x"), (F.col("id") % 4).alias("g")), order=["x"])
    return f, f.features.copy("x"), f.features.copy("x") * 3 + 1


def test_folds_are_parts_of_one_plan(spark):
    _, x, y = table(spark)
    seen = []
    for (trainX, testX), (trainY, testY) in KFoldIterator([x, y], 7, 3):
        assert trainX._rooted()[0] is trainY._rooted()[0] and testX._rooted()[0] is testY._rooted()[0]
        assert trainX._rows == trainX._df.count() and testX._rows == testX._df.count() and trainX._rows + testX._rows == 60
        both, a, b = testX._beside(testY)
        got = [tuple(r) for r in both.select(a[0], b[0]).collect()]
        assert all(w == 3 * v + 1 for v, w in got)
        seen += [v for v, _ in got]
    assert sorted(seen) == list(range(60))


def test_folds_of_tables_of_their_own(spark):
    x, y = lf.data([[float(i)] for i in range(20)]), lf.data([[2.0 * i] for i in range(20)])
    for (trainX, testX), (trainY, testY) in KFoldIterator([x, y], 4, 1):
        assert [r[0] * 2 for r in testX.copy("pythonlist")] == [r[0] for r in testY.copy("pythonlist")]
        assert [r[0] * 2 for r in trainX.copy("pythonlist")] == [r[0] for r in trainY.copy("pythonlist")]
    f, x, y = table(spark)
    sizes = [g[1]._count() for g, *_ in GroupFoldIterator([f.features.copy("g"), x, y], 0)]
    assert sizes == [15] * 4


def test_tuning_ranks_once(spark, monkeypatch):
    """Each fit ranked its tables again before, 20 times and more for each argument."""
    calls, real = [], frames.ranked
    monkeypatch.setattr(frames, "ranked", lambda *a, **k: calls.append(1) or real(*a, **k))
    _, x, y = table(spark)
    tuning = lf.Tuning("brute force", "cross validation", performanceFunction=C.rootMeanSquareError)
    tuning.tune("RidgeRegression", x, y, {"lamb": lf.Tune([0, 1000])}, C.rootMeanSquareError, 7)
    assert tuning.bestArguments["lamb"] == 0 and len(tuning.allResults) == 2
    assert len(calls) <= 3
    one = KFold("RidgeRegression", x, y, C.rootMeanSquareError, 7)
    assert abs(one.validate({"lamb": 0}) - tuning.bestResult) < 1e-9 and len(one.deep) == 5


def test_neighbours_over_folds(spark):
    f, x, y = table(spark, 30)
    kfold = KFold("KNNClassifier", x, f.features.copy("g"), C.fractionCorrect, 7, folds=3)
    assert 0 <= kfold.validate({"k": 1}) <= 1
