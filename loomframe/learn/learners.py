"""Learners: those built in, those of Spark ML, and those a user defines, behind one train / apply / test interface."""

from __future__ import annotations

import inspect
import json
import os
import time

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import log
from loomframe.exceptions import InvalidArgumentValue, InvalidArgumentValueCombination, PackageException
from loomframe.functions import calculate as C
from loomframe.operators.verbs import _beside
from loomframe.plans.frame import PID, Frame, session


class CustomLearner:
    """Base of learners that a user defines: train(trainX, trainY, ...) and apply(testX, ...) on frames."""

    learnerType = "unknown"

    @classmethod
    def _parameters(cls, method: str, skip: set[str]) -> dict:
        found = inspect.signature(getattr(cls, method)).parameters
        return {n: p.default for n, p in found.items() if n not in skip}

    @classmethod
    def getTrainParameters(cls) -> list[str]:
        return list(cls._parameters("train", {"self", "trainX", "trainY"}))

    @classmethod
    def getTrainDefaults(cls) -> dict:
        return {n: d for n, d in cls._parameters("train", {"self", "trainX", "trainY"}).items() if d is not inspect.Parameter.empty}

    @classmethod
    def getApplyParameters(cls) -> list[str]:
        return list(cls._parameters("apply", {"self", "testX"}))

    @classmethod
    def getApplyDefaults(cls) -> dict:
        return {n: d for n, d in cls._parameters("apply", {"self", "testX"}).items() if d is not inspect.Parameter.empty}

    @classmethod
    def getLearnerParameterNames(cls) -> list[str]:
        return list(dict.fromkeys(cls.getTrainParameters() + cls.getApplyParameters()))

    @classmethod
    def getLearnerDefaultValues(cls) -> dict:
        return cls.getTrainDefaults() | cls.getApplyDefaults()

    def train(self, trainX, trainY=None):
        raise NotImplementedError

    def apply(self, testX):
        raise NotImplementedError

    def getScores(self, testX):
        raise NotImplementedError("the learner gives no scores")

    def incrementalTrain(self, trainX, trainY=None):
        raise NotImplementedError("the learner does not learn in steps")


def validateCustomLearnerSubclass(check) -> None:
    if not (isinstance(check, type) and issubclass(check, CustomLearner)):
        raise TypeError("a subclass of CustomLearner is needed")
    if check.learnerType not in ("classification", "regression", "featureselection", "dimensionreduction", "cluster", "transformation", "undefined", "unknown"):
        raise TypeError(f"no such type of learner: {check.learnerType!r}")
    for method, first in (("train", ["trainX", "trainY"]), ("apply", ["testX"])):
        if [p for p in inspect.signature(getattr(check, method)).parameters if p != "self"][: len(first)] != first:
            raise TypeError(f"{method} must begin with {first}")
    if check.train is CustomLearner.train or check.apply is CustomLearner.apply:
        raise TypeError("train and apply must be defined")


class RidgeRegression(CustomLearner):
    """Least squares with a penalty and no intercept, by the normal equations: one aggregation."""

    learnerType = "regression"

    def train(self, trainX, trainY, lamb: float = 0):
        g, r = C.gram(trainX, trainY)
        self.w = np.linalg.solve(g + lamb * np.eye(len(g)), r.reshape(len(g), -1))

    def apply(self, testX):
        return linear(testX, self.w, 0.0)


class MultiOutputRidgeRegression(RidgeRegression):
    """Ridge regression of each feature of trainY; the products of trainX are summed once for all."""


class MultiOutputLinearRegression(CustomLearner):
    """Linear regression with intercept of each feature of trainY."""

    learnerType = "regression"

    def train(self, trainX, trainY):
        g, r = C.gram(trainX, trainY, intercept=True)
        self.w = np.linalg.lstsq(g, r.reshape(len(g), -1), rcond=None)[0]

    def apply(self, testX):
        return linear(testX, self.w[1:], self.w[0])


def linear(X: Frame, w: np.ndarray, start) -> Frame:
    start = np.broadcast_to(np.asarray(start, float), (w.shape[1],))
    cols = []
    df, x, weight = X._rooted()
    for k in range(w.shape[1]):
        total = F.lit(float(start[k]))
        for i, c in enumerate(x):
            total = total + c * F.lit(float(w[i, k]))
        cols.append(total)
    return X._derived(df, cols, weight * w.shape[1], [None] * w.shape[1], X._rows)


def nearest(t: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each point of t the places in x of the k nearest, nearest first, of equals the first, and their squared
    distances. Products choose candidates, differences decide; steps of at most 4,000,000 distances."""
    out, square = [], (x * x).sum(1)
    step = max(1, 4_000_000 // max(1, len(x)))
    for at in range(0, len(t), step):
        part = t[at : at + step]
        own = (part * part).sum(1)
        far = own[:, None] + square - 2 * part @ x.T
        edge = np.partition(far, k - 1, 1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
        slack = 1e-9 * (own + square.max(initial=0.0))
        for row, p, e in zip(far, part, edge + slack, strict=True):
            some = np.flatnonzero(row <= e)
            exact = ((x[some] - p) ** 2).sum(1)
            best = np.argsort(exact, kind="stable")[:k]
            out.append((some[best], exact[best]))
    return out


class KNNClassifier(CustomLearner):
    """The most frequent label of the k nearest points; of several the nearest point's. Training points of BLOCK cells
    at most are broadcast, and test points dealt out so that a task compares some PAIRS at most; more are dealt into
    blocks, which lots of test points meet one by one, and each point's k nearest of every block are ranked again. Both
    ways give the same labels."""

    learnerType = "classification"
    BLOCK, LOT, PAIRS = 20_000_000, 20_000, 100_000_000

    def train(self, trainX, trainY, k: int = 5):
        n, p = trainX.shape
        df, x, y = _beside(trainX, trainY)
        cols = [c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]
        self.k, self.kind, self.n, self.width = min(k, n), trainY._types[0], n, p
        if n * p > self.BLOCK:
            self._train = df.select(F.col(PID).alias("place"), *cols, y[0].alias("label"))
            return
        got = df.orderBy(PID).select(*cols, y[0].alias("y")).toPandas()
        self.x, self.y = got.drop(columns="y").to_numpy(float), got["y"].tolist()

    def _near(self, testX: Frame):
        """A row for each test point: the labels of its nearest points, nearest first."""
        k, cols = self.k, testX._cols
        test = testX._df.select(PID, *[F.col(c).cast("double").alias(c) for c in cols])
        if hasattr(self, "_train"):
            return self._near_blocks(test, testX._count())
        held = session().sparkContext.broadcast((self.x, self.y))
        # places come from one task up to RANK_ROWS; the comparisons are to have many
        test = test.repartition(max(1, -(-testX._count() * self.n // self.PAIRS)), PID)

        def run(batches):
            import pandas as pd

            x, y = held.value
            for b in batches:
                yield pd.DataFrame({PID: b[PID], "labels": [[y[i] for i in near] for near, _ in nearest(b[cols].to_numpy(float), x, k)]})

        schema = T.StructType([T.StructField(PID, T.LongType()), T.StructField("labels", T.ArrayType(self.kind))])
        return test.mapInPandas(run, schema)

    def _near_blocks(self, test, rows: int):
        k, width = self.k, self.width
        blocks, lots = -(-self.n * width // self.BLOCK), -(-rows // self.LOT)
        # each lot of test points meets each block of training points once, in a task of its own
        t = test.withColumn("lot", F.pmod(F.xxhash64(PID), F.lit(lots)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        x = self._train.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        features, coords = [c for c in test.columns if c != PID], [f"x{i}" for i in range(width)]
        schema = T.StructType([T.StructField(PID, T.LongType()), T.StructField("far", T.DoubleType()), T.StructField("place", T.LongType()), T.StructField("label", self.kind)])

        def meet(a, b):
            import pandas as pd

            if not len(a) or not len(b):
                return pd.DataFrame({PID: [], "far": [], "place": [], "label": []})
            b = b.sort_values("place", ignore_index=True)
            got = nearest(a[features].to_numpy(float), b[coords].to_numpy(float), min(k, len(b)))
            at = np.concatenate([i for i, _ in got])
            return pd.DataFrame({PID: np.repeat(a[PID].to_numpy(), [len(i) for i, _ in got]), "far": np.concatenate([d for _, d in got]), "place": b["place"].to_numpy()[at], "label": b["label"].to_numpy()[at]})

        met = t.groupBy("lot", "block").cogroup(x.groupBy("lot", "block")).applyInPandas(meet, schema)
        first = met.withColumn("r", F.row_number().over(Window.partitionBy(PID).orderBy("far", "place"))).filter(F.col("r") <= k)
        return first.groupBy(PID).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]).alias("labels"))

    def apply(self, testX):
        votes = F.transform(F.array_distinct("labels"), lambda v: F.struct(F.size(F.filter("labels", lambda x: x.eqNullSafe(v))).alias("n"), v.alias("v")))
        most = F.array_max(F.transform("votes", lambda c: c["n"]))
        label = F.get(F.filter("votes", lambda c: c["n"] == F.col("most")), F.lit(0))["v"]
        df = self._near(testX).withColumn("votes", votes).withColumn("most", most)
        return testX._with(df.select(PID, label.alias("f0")), ["labels"], rows=testX._rows)

    def getScores(self, testX):
        labels = sorted(set(self.y) if hasattr(self, "y") else (r[0] for r in self._train.select("label").distinct().collect()))
        share = lambda v: F.size(F.filter("labels", lambda x: x.eqNullSafe(F.lit(v)))) / F.lit(float(self.k))
        return testX._with(self._near(testX).select(PID, *[share(v).alias(f"f{i}") for i, v in enumerate(labels)]), [str(v) for v in labels], rows=testX._rows)


class KNNImputation(CustomLearner):
    """Missing values of a feature from the nearest complete points: their mean, or most frequent value with mode='classification'."""

    learnerType = "transformation"

    def train(self, trainX, trainY=None, k: int = 5, mode: str | None = None):
        if mode not in ("classification", "regression"):
            raise InvalidArgumentValue("mode is 'classification' or 'regression'")
        self.k, self.mode = k, mode
        n, p = trainX.shape
        if n * p > KNNClassifier.BLOCK:
            raise InvalidArgumentValueCombination("too many cells to train on")
        self.x = np.array([[np.nan if v is None else v for v in r] for r in trainX._rows_list()], float)

    def apply(self, testX):
        held = session().sparkContext.broadcast(self.x)
        k, cols, vote = self.k, testX._cols, self.mode == "classification"

        def run(batches):
            import pandas as pd

            x = held.value
            for b in batches:
                t = b[cols].to_numpy(float)
                for row in t:
                    for j in np.flatnonzero(np.isnan(row)):
                        usable = ~np.isnan(x[:, j])
                        both = ~np.isnan(x[usable]) & ~np.isnan(row)
                        gap = np.where(both, (x[usable] - row) ** 2, 0).sum(1) * len(row) / np.maximum(both.sum(1), 1)
                        gap[both.sum(1) == 0] = np.inf
                        near = x[usable, j][np.argsort(gap, kind="stable")[:k]]
                        if len(near):
                            values, counts = np.unique(near, return_counts=True)
                            row[j] = values[counts.argmax()] if vote else near.mean()
                yield pd.DataFrame({PID: b[PID], **{c: t[:, i] for i, c in enumerate(cols)}})

        schema = T.StructType([T.StructField(PID, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in cols]])
        got = testX._df.select(PID, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(run, schema)
        return testX._with(got, rows=testX._rows)


class SparkLearner:
    """A Spark ML estimator under the interface of learners."""

    def __init__(self, module: str, name: str, kind: str):
        self.module, self.name, self.learnerType = module, name, kind

    def _class(self):
        import importlib

        return getattr(importlib.import_module(f"pyspark.ml.{self.module}"), self.name)

    def defaults(self) -> dict:
        e = self._class()()
        return {p.name: (e.getOrDefault(p) if e.hasDefault(p) else None) for p in e.params if p.name not in ("featuresCol", "labelCol", "predictionCol", "rawPredictionCol", "probabilityCol", "inputCol", "outputCol")}


SPARK = {f"spark.{n}": SparkLearner(m, n, k) for m, n, k in [("regression", "LinearRegression", "regression"), ("regression", "DecisionTreeRegressor", "regression"), ("regression", "RandomForestRegressor", "regression"), ("regression", "GBTRegressor", "regression"), ("regression", "GeneralizedLinearRegression", "regression"), ("regression", "IsotonicRegression", "regression"), ("classification", "LogisticRegression", "classification"), ("classification", "DecisionTreeClassifier", "classification"), ("classification", "RandomForestClassifier", "classification"), ("classification", "GBTClassifier", "classification"), ("classification", "NaiveBayes", "classification"), ("classification", "LinearSVC", "classification"), ("clustering", "KMeans", "cluster"), ("clustering", "BisectingKMeans", "cluster"), ("clustering", "GaussianMixture", "cluster"), ("feature", "StandardScaler", "transformation"), ("feature", "MinMaxScaler", "transformation"), ("feature", "MaxAbsScaler", "transformation"), ("feature", "PCA", "dimensionreduction")]}
BUILT_IN = {f"loomframe.{c.__name__}": c for c in (RidgeRegression, MultiOutputRidgeRegression, MultiOutputLinearRegression, KNNClassifier, KNNImputation)}
CUSTOM: dict[str, type] = {}


def registerLearnerClass(learner: type) -> None:
    validateCustomLearnerSubclass(learner)
    CUSTOM[f"custom.{learner.__name__}"] = learner


def find(name):
    """The learner of a name (its package may be left out), or a class."""
    if isinstance(name, type):
        registerLearnerClass(name)
        return name
    for table in (BUILT_IN, SPARK, CUSTOM):
        for full, learner in table.items():
            if name in (full, full.split(".", 1)[1]):
                return learner
    if name.split(".")[0] in ("sklearn", "keras", "autoimpute"):
        raise PackageException(f"learners of {name.split('.')[0]} are not passed through; those of Spark ML are: {learnerNames('spark')}")
    raise InvalidArgumentValue(f"no learner {name!r}; there are {learnerNames()}")


def learnerNames(package=None) -> list[str]:
    return sorted(n for t in (BUILT_IN, SPARK, CUSTOM) for n in t if package in (None, n.split(".")[0]))


def showLearnerNames(package=None) -> None:
    print("\n".join(learnerNames(package)))


def learnerType(learnerNames):
    several = isinstance(learnerNames, (list, tuple))
    out = [find(n).learnerType for n in (learnerNames if several else [learnerNames])]
    return out if several else out[0]


def learnerParameterDefaults(name) -> dict:
    learner = find(name)
    return learner.defaults() if isinstance(learner, SparkLearner) else learner.getLearnerDefaultValues()


def learnerParameters(name) -> list[str]:
    learner = find(name)
    return list(learner.defaults()) if isinstance(learner, SparkLearner) else learner.getLearnerParameterNames()


def showLearnerParameters(name) -> None:
    print("\n".join(learnerParameters(name)))


def showLearnerParameterDefaults(name) -> None:
    print("\n".join(f"{k}: {v}" for k, v in learnerParameterDefaults(name).items()))


# -- trained learners ---------------------------------------------------------------------------------------------------------


class TrainedLearner:
    def __init__(self, learnerName: str, arguments: dict, randomSeed=None, tuning=None):
        self.learnerName, self.arguments, self.randomSeed, self.tuning = learnerName, arguments, randomSeed, tuning
        self._learner = find(learnerName)

    @property
    def learnerType(self) -> str:
        return self._learner.learnerType

    def _fit(self, trainX: Frame, trainY, arguments: dict) -> TrainedLearner:
        if isinstance(trainY, (str, int)):
            at = trainX._feature_index(trainY)
            trainX, trainY = trainX._select([i for i in range(len(trainX._names)) if i != at]), trainX._select([at])
        if isinstance(self._learner, SparkLearner):
            self._fit_spark(trainX, trainY, arguments)
        else:
            known = self._learner.getTrainParameters()
            self._model = self._learner()
            self._model.train(trainX, trainY, **{k: v for k, v in arguments.items() if k in known})
        return self

    @staticmethod
    def _assembled(X: Frame, df, cols):
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="features").transform(df.select(*X._keys, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *(["label"] if "label" in df.columns else [])))

    def _fit_spark(self, X: Frame, Y, arguments: dict) -> None:
        estimator = self._learner._class()()
        self._labels = None
        if Y is not None:
            df, x, y = _beside(X, Y)
            label = y[0]
            if self.learnerType == "classification":
                self._labels = [r[0] for r in df.select(label.alias("v")).distinct().orderBy("v").collect()]
                label = F.array_position(F.array(*map(F.lit, self._labels)), y[0]).cast("double") - 1
            df = df.withColumn("label", label.cast("double"))
        else:
            df, x = X._df, [F.col(c) for c in X._cols]
        names = {p.name for p in estimator.params}
        for k, v in arguments.items():
            if k not in names:
                raise InvalidArgumentValue(f"{self.learnerName} has no parameter {k!r}")
            estimator._set(**{k: v})
        if "seed" in names and self.randomSeed is not None:
            estimator._set(seed=self.randomSeed)
        if "inputCol" in names:
            estimator._set(inputCol="features", outputCol="scaled")
        self._model = estimator.fit(self._assembled(X, df, x))

    def _transform_spark(self, X: Frame):
        return self._model.transform(self._assembled(X, X._df, [F.col(c) for c in X._cols]))

    def apply(self, testX: Frame, arguments=None, scoreMode: str | None = None, **kwarguments) -> Frame:
        """Labels; with scoreMode 'bestScore' labels and scores, with 'allScores' a feature for each label."""
        if scoreMode in ("bestScore", "allScores"):
            scores = self.getScores(testX)
            if scoreMode == "allScores":
                return scores
            cols = [F.col(c) for c in scores._cols]
            best = F.greatest(*cols) if len(cols) > 1 else cols[0]
            label = F.element_at(F.array(*[F.lit(n) for n in scores._names]), F.array_position(F.array(*cols), best).cast("int"))
            return scores._with(scores._df.select(*scores._keys, label.alias("f0"), best.alias("f1")), ["PredictedClassLabel", "LabelScore"], rows=scores._rows)
        args = (arguments or {}) | kwarguments
        if not isinstance(self._learner, SparkLearner):
            known = self._learner.getApplyParameters()
            return self._model.apply(testX, **{k: v for k, v in (self.arguments | args).items() if k in known})
        out = self._transform_spark(testX)
        if self.learnerType in ("transformation", "dimensionreduction"):
            from pyspark.ml.functions import vector_to_array

            width = len(out.select(vector_to_array("scaled")).first()[0])
            return testX._with(out.select(*testX._keys, *[vector_to_array("scaled")[i].alias(f"f{i}") for i in range(width)]), testX._names if width == len(testX._names) else [None] * width, rows=testX._rows)
        p = F.col("prediction")
        if self._labels is not None:
            p = F.element_at(F.array(*map(F.lit, self._labels)), (p + 1).cast("int"))
        return testX._with(out.select(*testX._keys, p.alias("f0")), ["prediction"], rows=testX._rows)

    def getScores(self, testX: Frame, arguments=None, **kwarguments) -> Frame:
        if not isinstance(self._learner, SparkLearner):
            return self._model.getScores(testX)
        from pyspark.ml.functions import vector_to_array

        out = self._transform_spark(testX)
        col = "probability" if "probability" in out.columns else "rawPrediction"
        return testX._with(out.select(*testX._keys, *[vector_to_array(col)[i].alias(f"f{i}") for i in range(len(self._labels))]), list(map(str, self._labels)), rows=testX._rows)

    def test(self, performanceFunction, testX: Frame, testY=None, arguments=None, **kwarguments):
        if isinstance(testY, (str, int)):
            at = testX._feature_index(testY)
            testX, testY = testX._select([i for i in range(len(testX._names)) if i != at]), testX._select([at])
        result = performanceFunction(testY, self.apply(testX, arguments, **kwarguments))
        log.active.logTLRun(None, self, "test", self.arguments | (arguments or {}) | kwarguments, result)
        return result

    def retrain(self, trainX, trainY=None, arguments=None, randomSeed=None, **kwarguments) -> None:
        self.arguments = self.arguments | (arguments or {}) | kwarguments
        self._fit(trainX, trainY, self.arguments)
        log.active.logTLRun(None, self, "retrain", self.arguments)

    def incrementalTrain(self, trainX, trainY=None, arguments=None, randomSeed=None) -> None:
        if isinstance(self._learner, SparkLearner):
            raise InvalidArgumentValue("the learner does not learn in steps")
        self._model.incrementalTrain(trainX, trainY)

    def getAttributes(self) -> dict:
        return {k: v for k, v in vars(self._model).items() if not k.startswith("_")} if not isinstance(self._learner, SparkLearner) else {p.name: self._model.getOrDefault(p) for p in self._model.params if self._model.isDefined(p)}

    def save(self, outputPath: str) -> None:
        """Spark's own form for Spark's models; numbers as JSON for those built in (nothing that runs code when read)."""
        os.makedirs(outputPath, exist_ok=True)
        state = {"learner": self.learnerName, "arguments": self.arguments, "labels": getattr(self, "_labels", None)}
        if isinstance(self._learner, SparkLearner):
            self._model.write().overwrite().save(f"file://{os.path.abspath(outputPath)}/model")
        elif hasattr(self._model, "_train"):
            raise InvalidArgumentValue("training points beyond a block stay a table; save that table instead")
        else:
            state["state"] = {k: (v.tolist() if isinstance(v, np.ndarray) else v.json() if isinstance(v, T.DataType) else v) for k, v in vars(self._model).items()}
        with open(os.path.join(outputPath, "learner.json"), "w") as f:
            json.dump(state, f)


def loadTrainedLearner(source: str, arguments=None, **kwarguments) -> TrainedLearner:
    with open(os.path.join(source, "learner.json")) as f:
        state = json.load(f)
    out = TrainedLearner(state["learner"], state["arguments"] | (arguments or {}) | kwarguments)
    out._labels = state["labels"]
    log.active.logTrainedLearner(None, out)
    if isinstance(out._learner, SparkLearner):
        from pyspark.ml.util import DefaultParamsReader

        path = f"file://{os.path.abspath(source)}/model"
        out._model = DefaultParamsReader.loadParamsInstance(path, session().sparkContext)
    else:
        out._model = out._learner()
        for k, v in state["state"].items():
            setattr(out._model, k, np.array(v) if isinstance(v, list) and k in ("w", "x") else T.DataType.fromJson(json.loads(v)) if k == "kind" else v)
    return out


class TrainedLearners:
    """A learner for each label (OneVsAll) or pair of labels (OneVsOne)."""

    def __init__(self, learnerName, X, Y, strategy, arguments, randomSeed):
        labels = [r[0] for r in Y._df.select("f0").distinct().orderBy("f0").collect()]
        self.labels, self.strategy, self.learnerName, self.learnerType = labels, strategy, learnerName, "classification"
        fit = lambda x, y: TrainedLearner(learnerName, arguments, randomSeed)._fit(x, y, arguments)
        flag = lambda f, a: f._with(f._df.select(*f._keys, (F.col("f0") == F.lit(a)).cast("long").alias("f0")), rows=f._rows)
        self.models = []
        if strategy == "OneVsAll":
            self.models = [(a, None, fit(X, flag(Y, a))) for a in labels]
        else:
            df, x, y = _beside(X, Y)
            for i, a in enumerate(labels):
                for b in labels[i + 1 :]:
                    part = df.filter(y[0].isin(a, b))
                    px = X._with(part.select(*X._keys, *[c.alias(f"f{k}") for k, c in enumerate(x)]), dense=False)._densify()
                    py = Y._with(part.select(PID, y[0].alias("f0")), dense=False)._densify()
                    self.models.append((a, b, fit(px, flag(py, a))))

    def getScores(self, testX: Frame) -> Frame:
        df = testX._densify()._df.select(PID)
        votes = {a: F.lit(0.0) for a in self.labels}
        for k, (a, b, m) in enumerate(self.models):
            got = m.apply(testX)._df.select(PID, F.col("f0").alias(f"m{k}"))
            df = df.join(got, PID)
            votes[a] = votes[a] + F.col(f"m{k}").cast("double")
            if b is not None:
                votes[b] = votes[b] + 1 - F.col(f"m{k}").cast("double")
        return testX._with(df.select(PID, *[votes[a].alias(f"f{i}") for i, a in enumerate(self.labels)]), list(map(str, self.labels)), rows=testX._rows)

    def apply(self, testX: Frame, arguments=None, scoreMode=None, **kwarguments) -> Frame:
        scores = self.getScores(testX)
        if scoreMode == "allScores":
            return scores
        cols = [F.col(c) for c in scores._cols]
        label = F.element_at(F.array(*map(F.lit, self.labels)), F.array_position(F.array(*cols), F.greatest(*cols)).cast("int"))
        return scores._with(scores._df.select(PID, label.alias("f0"), *([F.greatest(*cols).alias("f1")] if scoreMode else [])), ["label"] + (["score"] if scoreMode else []), rows=scores._rows)

    def test(self, performanceFunction, testX, testY=None, arguments=None, **kwarguments):
        return performanceFunction(testY, self.apply(testX))


# -- frontends -----------------------------------------------------------------------------------------------------------------


def _split_tunes(arguments: dict):
    from loomframe.learn.tuning import Tune

    return {k: v for k, v in arguments.items() if isinstance(v, Tune)}


def train(learnerName, trainX: Frame, trainY=None, arguments=None, multiClassStrategy=None, randomSeed=None, tuning=None, useLog=None, **kwarguments):
    """A trained learner; arguments that are Tune objects are chosen by the tuning first."""
    started = time.time()
    args = (arguments or {}) | kwarguments
    if isinstance(trainY, (str, int)):
        at = trainX._feature_index(trainY)
        trainX, trainY = trainX._select([i for i in range(len(trainX._names)) if i != at]), trainX._select([at])
    if _split_tunes(args):
        from loomframe.learn.tuning import Tuning

        tuning = tuning if isinstance(tuning, Tuning) else Tuning(performanceFunction=tuning)
        tuning.tune(learnerName, trainX, trainY, args, tuning.performanceFunction, randomSeed)
        args = tuning.bestArguments
    if multiClassStrategy in ("OneVsAll", "OneVsOne"):
        return TrainedLearners(learnerName, trainX, trainY, multiClassStrategy, args, randomSeed)
    name = learnerName if isinstance(learnerName, str) else f"custom.{learnerName.__name__}"
    if not isinstance(learnerName, str):
        find(learnerName)
    out = TrainedLearner(name, args, randomSeed, tuning)._fit(trainX, trainY, args)
    log.handleLogging(useLog, "run", {"function": "train", "learner": name, "arguments": str(args), "time": time.time() - started})
    return out


def trainAndApply(learnerName, trainX, trainY=None, testX=None, arguments=None, multiClassStrategy=None, randomSeed=None, tuning=None, scoreMode=None, useLog=None, **kwarguments):
    model = train(learnerName, trainX, trainY, arguments, multiClassStrategy, randomSeed, tuning, useLog, **kwarguments)
    return model.apply(testX if testX is not None else trainX, scoreMode=scoreMode)


def trainAndTest(learnerName, performanceFunction, trainX, trainY=None, testX=None, testY=None, arguments=None, multiClassStrategy=None, randomSeed=None, tuning=None, useLog=None, **kwarguments):
    model = train(learnerName, trainX, trainY, arguments, multiClassStrategy, randomSeed, tuning, useLog, **kwarguments)
    return model.test(performanceFunction, testX if testX is not None else trainX, testY if testY is not None else trainY)


def trainAndTestOnTrainingData(learnerName, performanceFunction, trainX, trainY, crossValidationFolds=None, arguments=None, multiClassStrategy=None, randomSeed=None, tuning=None, useLog=None, **kwarguments):
    if not crossValidationFolds:
        return trainAndTest(learnerName, performanceFunction, trainX, trainY, trainX, trainY, arguments, multiClassStrategy, randomSeed, tuning, useLog, **kwarguments)
    from loomframe.learn.tuning import KFold

    return KFold(learnerName, trainX, trainY, performanceFunction, randomSeed, crossValidationFolds).validate((arguments or {}) | kwarguments)


def normalizeData(learnerName, trainX, trainY=None, testX=None, arguments=None, randomSeed=None, **kwarguments):
    """Tables as a trained transformation gives them."""
    model = train(learnerName, trainX, trainY, arguments, randomSeed=randomSeed, **kwarguments)
    return model.apply(trainX) if testX is None else (model.apply(trainX), model.apply(testX))


def fillMatching(learnerName, matchingElements, trainX: Frame, arguments=None, points=None, features=None, **kwarguments) -> None:
    """Matched values become what an imputing learner makes of them; values that are missing but do not match stay so."""

    blank = trainX.copy()
    blank.features.fillMatching(None, matchingElements, features=features, points=points)
    filled = train(learnerName, blank, None, arguments, **kwarguments).apply(blank)
    flags = trainX.matchingElements(matchingElements)
    df, a, b = _beside(trainX, filled)
    both = trainX._with(df.select(*trainX._keys, *[x.alias(f"f{i}") for i, x in enumerate(a + b)]), [None] * (2 * len(a)), rows=trainX._rows)
    df, ab, m = _beside(both, flags)
    n = len(a)
    cols = trainX._feature_indices(features)
    trainX._rebind(trainX._with(df.select(*trainX._keys, *[(F.when(m[i], ab[n + i]).otherwise(ab[i]) if i in cols else ab[i]).alias(f"f{i}") for i in range(n)]), rows=trainX._rows))


