"""Normalisation, metrics, similarity, confidence intervals and linear algebra. Metrics of two tables are one aggregation over their points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.exceptions import InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions.statistics import *  # noqa: F403
from loomframe.functions.statistics import _values, is_numeric  # noqa: F401

# -- normalisation of vectors ------------------------------------------------------------------------------------------


def _vectors(values1, values2):
    a = np.array([np.nan if v is None else v for v in _values(values1)], float)
    b = None if values2 is None else np.array([np.nan if v is None else v for v in _values(values2)], float)
    return a, b


def _both(f, a, b):
    return f(a).tolist() if b is None else (f(a).tolist(), f(b).tolist())


def meanNormalize(values1, values2=None):
    a, b = _vectors(values1, values2)
    return _both(lambda x: x - np.nanmean(a), a, b)


def meanStandardDeviationNormalize(values1, values2=None):
    """Mean and population standard deviation of the first vector, used for both; a deviation of zero only centres."""
    a, b = _vectors(values1, values2)
    sd = np.nanstd(a)
    return _both(lambda x: (x - np.nanmean(a)) / (sd if sd else 1), a, b)


def rangeNormalize(values1, values2=None, start: float = 0, end: float = 1):
    a, b = _vectors(values1, values2)
    low, spread = np.nanmin(a), np.nanmax(a) - np.nanmin(a)
    return _both(lambda x: (x - low) * (end - start) / (spread if spread else 1) + start, a, b)


def range0to1Normalize(values1, values2=None):
    return rangeNormalize(values1, values2, 0, 1)


def percentileNormalize(values1, values2=None):
    """Place in order over the number of others, ties averaged; a second vector is interpolated on the first."""
    a, b = _vectors(values1, values2)
    known = np.sort(a[~np.isnan(a)])
    n = len(known)
    place = lambda v: (np.searchsorted(known, v, "left") + np.searchsorted(known, v, "right") - 1) / 2 / max(n - 1, 1)
    first = np.where(np.isnan(a), np.nan, place(a)) if n > 1 else np.where(np.isnan(a), np.nan, 0.5)
    if b is None:
        return first.tolist()
    distinct = np.unique(known)
    return first.tolist(), np.interp(b, distinct, place(distinct)).tolist()


# -- metrics -----------------------------------------------------------------------------------------------------------


def performanceFunction(optimal: str | None, best=None, predict=None, **_):
    """Marks a function as a metric whose best value is the greatest ('max') or the least ('min')."""
    if optimal not in ("max", "min", None):
        raise InvalidArgumentValue("optimal is 'max', 'min' or None")

    def mark(f):
        f.optimal, f.best, f.predict = optimal, best, predict
        return f

    return mark


def detectBestResult(functionToCheck) -> str:
    """'max' or 'min': what the metric is marked with, or what it says of a perfect and a wrong prediction."""
    mark = getattr(functionToCheck, "optimal", None)
    if mark:
        return mark
    known, wrong = [0, 1, 0, 1], [1, 0, 1, 0]
    good, bad = functionToCheck(known, known), functionToCheck(known, wrong)
    if good == bad:
        raise InvalidArgumentValue("the function does not tell a perfect prediction from a wrong one")
    return "max" if good > bad else "min"


def paired(known, predicted) -> tuple[DataFrame, list[Column], list[Column]]:
    """A plan of the points of both tables side by side (by place), with their columns."""
    from loomframe.plans.frame import PID, Frame
    from loomframe.sources.memory import data

    known, predicted = (x if isinstance(x, Frame) else data([[v] for v in x]) for x in (known, predicted))
    if known.shape != predicted.shape:
        raise InvalidArgumentValueCombination(f"shapes differ: {known.shape} and {predicted.shape}")
    if known._df is predicted._df and known._names == predicted._names:
        both = known._df
        return both, [F.col(c) for c in known._cols], [F.col(c) for c in predicted._cols]
    (df, k, _), (same, p, _) = known._rooted(), predicted._rooted()
    if same is df:
        return df, list(k), list(p)
    a, b = known._densify(), predicted._densify()
    both = a._df.select(PID, *[F.col(c).alias(f"k{i}") for i, c in enumerate(a._cols)]).join(b._df.select(PID, *[F.col(c).alias(f"p{i}") for i, c in enumerate(b._cols)]), PID)
    n = range(len(a._names))
    return both, [F.col(f"k{i}") for i in n], [F.col(f"p{i}") for i in n]


def _metric(optimal, best, build):
    """A metric of one column of each table from one aggregate expression."""

    def metric(knownValues, predictedValues):
        df, k, p = paired(knownValues, predictedValues)
        if len(k) != 1:
            raise InvalidArgumentValueCombination("the metric is of one feature")
        return df.agg(build(k[0], p[0])).first()[0]

    metric.expression = build
    return performanceFunction(optimal, best)(metric)


def _error(k, p):
    return k.cast("double") - p.cast("double")


rootMeanSquareError = _metric("min", 0, lambda k, p: F.sqrt(F.avg(_error(k, p) * _error(k, p))))
meanAbsoluteError = _metric("min", 0, lambda k, p: F.avg(F.abs(_error(k, p))))
fractionIncorrect = _metric("min", 0, lambda k, p: F.avg((~k.eqNullSafe(p)).cast("int")))
fractionCorrect = _metric("max", 1, lambda k, p: F.avg(k.eqNullSafe(p).cast("int")))
varianceFractionRemaining = _metric("min", 0, lambda k, p: F.avg(_error(k, p) * _error(k, p)) / F.var_pop(k))
rSquared = _metric("max", 1, lambda k, p: 1 - F.avg(_error(k, p) * _error(k, p)) / F.var_pop(k))
cosineSimilarity = _metric("max", 1, lambda k, p: F.sum(k * p) / (F.sqrt(F.sum(k * k)) * F.sqrt(F.sum(p * p))))
_true = lambda c: c.cast("double") == 1
_tp = lambda k, p: F.count_if(_true(k) & _true(p))
_tn = lambda k, p: F.count_if(~_true(k) & ~_true(p))
_fp = lambda k, p: F.count_if(~_true(k) & _true(p))
_fn = lambda k, p: F.count_if(_true(k) & ~_true(p))
_ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
_recall = lambda k, p: _ratio(_tp(k, p), _tp(k, p) + _fn(k, p))
_precision = lambda k, p: _ratio(_tp(k, p), _tp(k, p) + _fp(k, p))
_specificity = lambda k, p: _ratio(_tn(k, p), _tn(k, p) + _fp(k, p))
truePositive, trueNegative = _metric("max", None, _tp), _metric("max", None, _tn)
falsePositive, falseNegative = _metric("min", 0, _fp), _metric("min", 0, _fn)
recall, precision, specificity = _metric("max", 1, _recall), _metric("max", 1, _precision), _metric("max", 1, _specificity)
balancedAccuracy = _metric("max", 1, lambda k, p: (_recall(k, p) + _specificity(k, p)) / 2)
f1Score = _metric("max", 1, lambda k, p: _ratio(2 * _precision(k, p) * _recall(k, p), _precision(k, p) + _recall(k, p)))
for _n in ("rootMeanSquareError meanAbsoluteError fractionIncorrect fractionCorrect varianceFractionRemaining rSquared cosineSimilarity truePositive trueNegative falsePositive falseNegative recall precision specificity balancedAccuracy f1Score").split():
    globals()[_n].__name__ = _n


@performanceFunction("min", 0)
def meanFeaturewiseRootMeanSquareError(knownValues, predictedValues):
    """Mean over features of their root mean square errors."""
    df, k, p = paired(knownValues, predictedValues)
    row = df.agg(*[rootMeanSquareError.expression(a, b) for a, b in zip(k, p, strict=True)]).first()
    return math.fsum(row) / len(row)


def confusionMatrix(knownValues, predictedValues, labels=None, convertCountsToFractions: bool = False):
    """Counts by predicted label (points predicted_x) and known label (features known_x), labels sorted."""
    from loomframe.sources.memory import data

    df, k, p = paired(knownValues, predictedValues)
    counts = {(r["p"], r["k"]): r["count"] for r in df.groupBy(p[0].alias("p"), k[0].alias("k")).count().collect()}
    values = sorted({b for _, b in counts})
    names = {v: v for v in values} if labels is None else dict(labels) if isinstance(labels, dict) else dict(enumerate(labels))
    total = math.fsum(counts.values()) if convertCountsToFractions else 1
    keys = list(names)
    rows = [[counts.get((a, b), 0) / total if convertCountsToFractions else counts.get((a, b), 0) for b in keys] for a in keys]
    return data(rows, pointNames=[f"predicted_{names[v]}" for v in keys], featureNames=[f"known_{names[v]}" for v in keys])


# -- confidence intervals ------------------------------------------------------------------------------------------------


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on the incomplete beta function's continued fraction."""

    def beta(a: float, b: float, x: float) -> float:
        if x in (0, 1):
            return x
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d)
                c = 1 + num / c
                out *= c * d
        return front * out / a

    low, high = 0.0, 1e4
    for _ in range(200):
        t = (low + high) / 2
        if 1 - beta(df / 2, 0.5, df / (df + t * t)) / 2 < p:
            low = t
        else:
            high = t
    return (low + high) / 2


def _interval(known, predicted, confidence, value):
    df, k, p = paired(known, predicted)
    v = value(k[0], p[0])
    mean, sd, n = df.agg(F.avg(v), F.stddev_samp(v), F.count(v)).first()
    half = student_quantile(1 - (1 - confidence) / 2, n - 1) * sd / math.sqrt(n)
    return mean - half, mean + half


def rootMeanSquareErrorConfidenceInterval(known, predicted, confidence: float = 0.95):
    low, high = _interval(known, predicted, confidence, lambda k, p: _error(k, p) * _error(k, p))
    return math.sqrt(max(low, 0)), math.sqrt(high)


def meanAbsoluteErrorConfidenceInterval(known, predicted, confidence: float = 0.95):
    return _interval(known, predicted, confidence, lambda k, p: F.abs(_error(k, p)))


def fractionIncorrectConfidenceInterval(known, predicted, confidence: float = 0.95):
    df, k, p = paired(known, predicted)
    share, n = df.agg(F.avg((~k[0].eqNullSafe(p[0])).cast("int")), F.count("*")).first()
    half = student_quantile(1 - (1 - confidence) / 2, n - 1) * math.sqrt(share * (1 - share) / n)
    return share - half, share + half


# -- similarity and linear algebra ------------------------------------------------------------------------------------------


def correlation(X, X_T=None):
    """Pearson correlations between points, over the values that both have."""
    return X.points.similarities("correlation")


def covariance(X, X_T=None, sample: bool = True):
    return X.points.similarities("sample covariance" if sample else "population covariance")


def elementwiseMultiply(left, right):
    return left * right


def elementwisePower(left, right):
    return left**right


def _dense(a) -> np.ndarray:
    return np.array(a._rows_list(), float)


def _square(a) -> None:
    n, p = a.shape
    if n != p:
        raise InvalidArgumentValue("only a square table has an inverse")


def inverse(aObj):
    """Inverse of a square table that fits the driver (it has as many features as points)."""
    from loomframe.sources.memory import data

    _square(aObj)
    try:
        return data(np.linalg.inv(_dense(aObj)).tolist())
    except np.linalg.LinAlgError as e:
        raise InvalidArgumentValue("the table is singular") from e


def pseudoInverse(aObj):
    from loomframe.sources.memory import data

    return data(np.linalg.pinv(_dense(aObj)).tolist())


def solve(aObj, bObj):
    from loomframe.sources.memory import data

    _square(aObj)
    try:
        return data(np.linalg.solve(_dense(aObj), np.array(bObj._cells(), float)).reshape(-1, 1).tolist())
    except np.linalg.LinAlgError as e:
        raise InvalidArgumentValue("the table is singular") from e


def leastSquaresSolution(aObj, bObj):
    """Least squares by the normal equations: products of features are summed where the points are."""
    from loomframe.sources.memory import data

    g, r = gram(aObj, bObj)
    return data(np.linalg.lstsq(g, r, rcond=None)[0].reshape(-1, 1).tolist())


def gram(X, y, intercept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y in one aggregation, with a leading column of ones for an intercept."""
    df, cols, out = X._beside(y)
    x = ([F.lit(1.0)] if intercept else []) + [c.cast("double") for c in cols]
    n, m = len(x), len(out)
    sums = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(x[i] * o.cast("double")) for i in range(n) for o in out]
    row = [0.0 if v is None else v for v in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    g, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = row[at]
            at += 1
    return g, np.array(row[at:]).reshape(n, m) if m > 1 else np.array(row[at:])
