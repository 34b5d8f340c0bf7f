import pytest

import loomframe as lf
from loomframe.exceptions import FileFormatException, ImproperObjectAction, InvalidArgumentValue, InvalidArgumentValueCombination


def rows(f):
    return f.copy("python list")


def test_merge_modes():
    left = lambda: lf.data([["a", 1, 2], ["a", 4, 3], ["b", -1, -2], ["c", -6, -5], ["c", -3, -4]], featureNames=["id", "f1", "f2"])
    right = lf.data([["a", 3, 4], ["b", -3, -4], ["c", -4, -3]], featureNames=["id", "f3", "f4"])
    f = left()
    f.merge(right, point="union", feature="union", onFeature="id")
    assert rows(f) == [["a", 1, 2, 3, 4], ["a", 4, 3, 3, 4], ["b", -1, -2, -3, -4], ["c", -6, -5, -4, -3], ["c", -3, -4, -4, -3]]
    other = lf.data([["a", 3, 4], ["c", -4, -3], ["d", -3, -4]], featureNames=["id", "f3", "f4"])
    f = left()
    f.merge(other, point="union", feature="union", onFeature="id")
    assert rows(f)[2] == ["b", -1, -2, None, None] and rows(f)[-1] == ["d", None, None, -3, -4]
    f = left()
    f.merge(other, point="intersection", feature="intersection", onFeature="id")
    assert f.features.getNames() == ["id"] and len(rows(f)) == 4
    f = left()
    f.merge(other, point="left", feature="left", onFeature="id")
    assert f.shape == (5, 3)
    with pytest.raises(InvalidArgumentValue):
        left().merge(lf.data([["c", 99, 1]], featureNames=["id", "f2", "f3"]), point="union", onFeature="id")
    with pytest.raises(InvalidArgumentValue):
        left().merge(left(), point="union", onFeature="id")
    with pytest.raises(InvalidArgumentValueCombination):
        left().merge(right, point="strict", feature="strict", onFeature="id")


def test_merge_on_point_names():
    a = lf.data([["a", 1], ["b", 2]], pointNames=["p", "q"], featureNames=["f1", "f2"])
    b = lf.data([[None, 5], ["z", 6]], pointNames=["p", "r"], featureNames=["f1", "f3"])
    a.merge(b, point="union", feature="union")
    assert sorted(a.points.getNames()) == ["p", "q", "r"]
    assert ["a", 1, 5] in rows(a) and ["z", None, 6] in rows(a)


def test_arithmetic():
    a, b = lf.data([[1, 2], [3, -7]]), lf.data([[2, 3], [2, 2]])
    assert rows(a + b) == [[3, 5], [5, -5]] and rows(a - 1) == [[0, 1], [2, -8]] and rows(2 * a) == [[2, 4], [6, -14]]
    assert rows(a // b) == [[0, 0], [1, -4]] and rows(a % b) == [[1, 2], [1, 1]]
    assert rows(a / b)[1] == [1.5, -3.5] and rows(a**2) == [[1, 4], [9, 49]] and rows(10 - a) == [[9, 8], [7, 17]]
    assert rows(a @ b) == [[6, 7], [-8, -5]] and rows(-a)[0] == [-1, -2] and rows(abs(a))[1] == [3, 7]
    with pytest.raises(ZeroDivisionError):
        a / 0
    with pytest.raises(ImproperObjectAction):
        a + lf.data([["x", "y"], ["z", "w"]])
    t, f = lf.data([[True, False]]), lf.data([[True, True]])
    assert rows(t & f) == [[True, False]] and rows(t ^ f) == [[False, True]] and rows(~t) == [[False, True]]
    row = lf.data([[10, 20]])
    assert rows(a + row.stretch) == [[11, 22], [13, 13]]
    col = lf.data([[1], [2]])
    assert rows(a * col.stretch) == [[1, 2], [6, -14]]


def test_shapes():
    f = lf.data([[1, 2, 3], [4, 5, 6]], featureNames=["a", "b", "c"], pointNames=["p", "q"])
    assert rows(f.T) == [[1, 4], [2, 5], [3, 6]] and f.T.features.getNames() == ["p", "q"] and f.T.points.getNames() == ["a", "b", "c"]
    assert f["q", "b"] == 5 and rows(f[0:1, "a":"b"]) == [[1, 2], [4, 5]] and f[1, -1] == 6
    g = f.copy()
    g.flatten()
    assert rows(g) == [[1, 2, 3, 4, 5, 6]]
    g.unflatten((2, 3))
    assert rows(g) == rows(f)
    f.replaceRectangle(0, 0, "b", 1, "c")
    assert rows(f) == [[1, 0, 0], [4, 0, 0]] and f.containsZero()
    f[0, 0] = 7
    assert f[0, 0] == 7
    assert lf.data([[[1, 2], [3, 4]]]).dimensions == (1, 2, 2)


def test_elements():
    f = lf.data([[1, 2], [0, 4]])
    assert f.countElements("> 1") == 2 and f.countUniqueElements() == {1: 1, 2: 1, 0: 1, 4: 1}
    assert rows(f.matchingElements(lf.match.zero)) == [[False, False], [True, False]]
    f.transformElements({1: 100})
    assert f[0, 0] == 100
    f.transformElements(lambda v: v + 1, preserveZeros=True)
    assert rows(f) == [[101, 3], [0, 5]]
    assert list(f.iterateElements(only=lf.match.nonZero)) == [101, 3, 5]
    assert f.mean() == pytest.approx(27.25) and f.max() == 101 and f == f.copy() and f.isApproximatelyEqual(f.copy())


def test_metrics():
    known = lf.data([[v] for v in [1, 2, 3, 4] * 3 + [1, 2, 3, 4]])
    got = lf.data([[v] for v in [1, 2, 3, 4] * 3 + [4, 3, 2, 1]])
    m = lf.calculate.confusionMatrix(known, got)
    assert rows(m) == [[3, 0, 0, 1], [0, 3, 1, 0], [0, 1, 3, 0], [1, 0, 0, 3]] and m.points.getNames()[0] == "predicted_1"
    a, b = lf.data([[1.0], [2.0], [3.0]]), lf.data([[1.0], [2.0], [5.0]])
    assert lf.calculate.rootMeanSquareError(a, b) == pytest.approx((4 / 3) ** 0.5)
    assert lf.calculate.rSquared(a, a) == 1 and lf.calculate.fractionIncorrect(a, b) == pytest.approx(1 / 3)
    k, p = lf.data([[1], [1], [0], [0]]), lf.data([[1], [0], [0], [0]])
    assert lf.calculate.precision(k, p) == 1 and lf.calculate.recall(k, p) == 0.5 and lf.calculate.f1Score(k, p) == pytest.approx(2 / 3)
    assert lf.calculate.detectBestResult(lf.calculate.rootMeanSquareError) == "min"
    assert lf.calculate.student_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)


def test_linear_algebra():
    a = lf.data([[2.0, 0.0], [0.0, 4.0]])
    assert rows(a.inverse()) == [[0.5, 0.0], [0.0, 0.25]] and rows(a.matrixPower(2)) == [[4.0, 0.0], [0.0, 16.0]]
    assert rows(a.solveLinearSystem(lf.data([[2.0], [8.0]]))) == [[1.0], [2.0]]
    x, y = lf.data([[1.0], [2.0], [3.0]]), lf.data([[2.0], [4.0], [6.0]])
    assert [r[0] for r in rows(lf.calculate.residuals(y, x))] == pytest.approx([0, 0, 0], abs=1e-9)


def test_csv(tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("# note\n\nb,i,f,s\nTrue,1,1.5,x\nFalse,,2,NA\n")
    f = lf.data(str(p))
    assert f.features.getNames() == ["b", "i", "f", "s"] and rows(f) == [[True, 1, 1.5, "x"], [False, None, 2.0, None]]
    q = tmp_path / "y.csv"
    q.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(FileFormatException):
        lf.data(str(q))
    out = tmp_path / "z.csv"
    f.save(str(out))
    assert out.read_text().splitlines()[0] == "b,i,f,s"
    m = tmp_path / "m.mtx"
    lf.data([[1.0, 0.0], [0.0, 2.0]]).save(str(m))
    assert rows(lf.data(str(m))) == [[1.0, 0.0], [0.0, 2.0]]
    assert rows(lf.data(str(p), keepFeatures=["s", "i"], keepPoints=[1])) == [[None, None]]


def test_learners(tmp_path):
    x = lf.data([[float(i), float(i % 3)] for i in range(30)], featureNames=["a", "b"])
    y = lf.data([[2.0 * i - i % 3] for i in range(30)], featureNames=["y"])
    model = lf.train("RidgeRegression", x, y, lamb=0)
    assert model.test(lf.calculate.rootMeanSquareError, x, y) < 1e-9
    model.save(str(tmp_path / "m"))
    assert rows(lf.loadTrainedLearner(str(tmp_path / "m")).apply(x))[3] == [pytest.approx(6.0)]
    labels = lf.data([[int(i >= 15)] for i in range(30)])
    assert lf.trainAndTest("KNNClassifier", lf.calculate.fractionCorrect, x, labels, k=3) == 1
    assert lf.trainAndTest("LogisticRegression", lf.calculate.fractionCorrect, x, labels) > 0.9
    tuned = lf.train("RidgeRegression", x, y, lamb=lf.Tune([0, 1000]), tuning=lf.Tuning(performanceFunction=lf.calculate.rootMeanSquareError, folds=3))
    assert tuned.arguments["lamb"] == 0 and len(tuned.tuning.allResults) == 2
    assert set(lf.learnerNames("loomframe")) >= {"loomframe.KNNImputation"}
    a, b = lf.data([[float(i)] for i in range(10)]).trainAndTestSets(0.25)
    assert a.shape == (8, 1) and b.shape == (2, 1)
    gap = lf.data([[1.0, 1.0], [1.0, None], [5.0, 9.0]])
    lf.fillMatching("KNNImputation", lf.match.missing, gap, k=1, mode="regression")
    assert rows(gap)[1] == [1.0, 1.0]


def test_custom_learner():
    class Constant(lf.CustomLearner):
        learnerType = "regression"

        def train(self, trainX, trainY, shift=0):
            self.v = trainY.mean() + shift

        def apply(self, testX):
            return lf.data([[self.v]] * testX.shape[0])

    x, y = lf.data([[1.0], [2.0]]), lf.data([[3.0], [5.0]])
    assert rows(lf.trainAndApply(Constant, x, y, shift=1)) == [[5.0], [5.0]]


def test_random_and_log(tmp_path):
    r = lf.random.data(20, 5, 0.4, randomSeed=3)
    assert r.shape == (20, 5) and r.countElements("== 0") == 40
    lf.log.active.setup(str(tmp_path / "log.sqlite"))
    lf.log.log("hello", "world")
    assert "world" in lf.showLog(searchForText="world")
    lf.settings.set("logger", "enabledByDefault", "False")
    assert lf.settings.get("logger", "enabledByDefault") == "False"


def test_streaming(spark, tmp_path):
    from loomframe.streaming import incremental

    spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 5.0)], "k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
    q = incremental.group_statistics(incremental.matching(stream, "v > 0"), "k", "v", ["mean", "count"]).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("grown").collect())) == [("a", 3.0, 2), ("b", 2.0, 1)]
