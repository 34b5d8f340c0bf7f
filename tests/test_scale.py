"""What a table does beyond one task: ranks by bisected ranges, neighbours by blocks, codes, files, packages, log."""

import pytest
from pyspark.sql import functions as F

import loomframe as lf
from loomframe import config, log
from loomframe.exceptions import PackageException
from loomframe.learn import packages
from loomframe.learn.learners import KNNClassifier
from loomframe.plans import frame as frames
from loomframe.plans.frame import ranked


@pytest.mark.parametrize("reverse", [False, True])
def test_ranges_give_every_row_its_place(spark, monkeypatch, reverse):
    monkeypatch.setattr(frames, "RANK_ROWS", 300)
    df = spark.range(5000).select(F.when(F.col("id") != 17, (F.col("id") * 7919) % 5003).alias("k"))
    got = [(r["k"], r["place"]) for r in ranked(df, [F.col("k")], "place", 5000, reverse=reverse).collect()]
    values = sorted(k for k, _ in got if k is not None)
    want = [*values[::-1], None] if reverse else [None, *values]
    assert [k for k, _ in sorted(got, key=lambda r: r[1])] == want
    assert sorted(p for _, p in got) == list(range(5000))


def test_ranges_of_several_keys(spark, monkeypatch):
    monkeypatch.setattr(frames, "RANK_ROWS", 100)
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got = ranked(df, [F.col("a"), F.col("b")], "place", 1000).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted((i % 3, i) for i in range(1000))


def test_codes_by_first_appearance_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(frames, "RANK_ROWS", 10)
    f = lf.data([[f"v{(i * 37) % 50}"] for i in range(200)], featureNames=["v"])
    values = f.features.copy("v").copy("pythonlist")
    back = f.transformFeatureToIntegers("v")
    first = list(dict.fromkeys(v[0] for v in values))
    assert [back[i] for i in range(50)] == first
    assert [r[0] for r in f.copy("pythonlist")] == [first.index(v[0]) for v in values]


def test_neighbours_by_blocks_as_by_broadcast(spark, monkeypatch):
    rows = [[float((i * 13) % 17), float((i * 7) % 11), ("a", "b", "c")[i % 3]] for i in range(120)]  # many ties
    f = lf.data(rows, featureNames=["x", "y", "label"])
    x, y = f.features.copy(["x", "y"]), f.features.copy("label")
    one = lf.trainAndApply("KNNClassifier", x, y, x, k=5).copy("pythonlist")
    scores = lf.train("KNNClassifier", x, y, k=5).getScores(x).copy("pythonlist")
    monkeypatch.setattr(KNNClassifier, "BLOCK", 50)
    monkeypatch.setattr(KNNClassifier, "LOT", 40)
    model = lf.train("KNNClassifier", x, y, k=5)
    assert model.apply(x).copy("pythonlist") == one
    assert model.getScores(x).copy("pythonlist") == scores

    def brute(p):
        near = sorted(range(len(rows)), key=lambda i: ((rows[i][0] - p[0]) ** 2 + (rows[i][1] - p[1]) ** 2, i))[:5]
        labels = [rows[i][2] for i in near]
        return max(dict.fromkeys(labels), key=labels.count)

    assert [r[0] for r in one] == [brute(r) for r in rows]


def test_hash_is_whole_and_of_content(spark):
    a, b = lf.data([[1, 2], [3, 4]]), lf.data([[1, 2], [3, 5]])
    assert isinstance(a.hashCode(), int) and 0 <= a.hashCode() < 10**9
    assert a.hashCode() == a.copy().hashCode() != b.hashCode()
    assert a.isApproximatelyEqual(a.copy()) and not a.isApproximatelyEqual(b)


def test_csv_of_odd_cells_comes_back(spark, tmp_path):
    f = lf.data([["a,b", 1], ['say "x"', 2], ["plain", 3]], featureNames=["t", "n, m"])
    f.save(str(tmp_path / "odd.csv"))
    back = lf.data(str(tmp_path / "odd.csv"))
    assert back.features.getNames() == ["t", "n, m"]
    assert [r[1] for r in back.copy("pythonlist")] == [1, 2, 3] and back.copy("pythonlist")[0][0] == "a,b"


def test_packages():
    assert packages.package("scikit-learn") is packages.SciKitLearn and packages.SparkML.accessible()
    assert packages.SparkML.version().startswith("4") and "KMeans" in packages.SparkML.learnerNames()
    assert packages.BuiltInLearners.learnerType("KNNClassifier") == "classification"
    with pytest.raises(PackageException):
        packages.package("nothing")
    with pytest.raises(PackageException):
        lf.train("sklearn.Ridge", None, None)


def test_log_of_trained_learners(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "active", log.SessionLogger(str(tmp_path), "runs"))
    monkeypatch.setitem(config.settings._session, ("logger", "enabledByDefault"), "True")
    monkeypatch.setitem(config.settings._session, ("logger", "enableCrossValidationDeepLogging"), "True")
    x, y = lf.data([[float(i)] for i in range(12)]), lf.data([[2.0 * i] for i in range(12)])
    model = lf.train("RidgeRegression", x, y, lamb=0)
    model.test(lf.calculate.rootMeanSquareError, x, y)
    model.save(str(tmp_path / "m"))
    lf.loadTrainedLearner(str(tmp_path / "m"))
    lf.learn.tuning.KFold("RidgeRegression", x, y, lf.calculate.rootMeanSquareError, folds=3).validate({"lamb": 0})
    kinds = {r[0] for r in log.active.extractFromLog("SELECT type FROM log")}
    assert {"run", "tl", "deepRun"} <= kinds
    log.active.cleanup()


def test_options_of_packages(monkeypatch):
    monkeypatch.setattr(packages.Keras, "optionNames", classmethod(lambda cls: ["location"]))
    config.setInterfaceOptions(packages.Keras)
    assert config.settings.get("keras", "location") == ""
    del config.settings._session["keras", "location"]


def test_neighbours_by_broadcast_have_tasks_by_their_pairs(spark, monkeypatch):
    f = lf.data([[float((i * 13) % 17), float(i % 7), "ab"[i % 2]] for i in range(200)], featureNames=["x", "y", "label"])
    f.points.sort("x")  # ranked in one task
    x, y = f.features.copy(["x", "y"]), f.features.copy("label")
    one = lf.trainAndApply("KNNClassifier", x, y, x, k=3)
    monkeypatch.setattr(KNNClassifier, "PAIRS", 4000)
    many = lf.trainAndApply("KNNClassifier", x, y, x, k=3)
    assert (one._df.rdd.getNumPartitions(), many._df.rdd.getNumPartitions()) == (1, 10)
    assert many.copy("pythonlist") == one.copy("pythonlist")
