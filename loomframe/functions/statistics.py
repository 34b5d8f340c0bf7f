"""Statistics as aggregate expressions (name to Column builder), and as functions of vectors."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import InvalidArgumentValue
from loomframe.functions.match import missing, value_match

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
_NAN = float("nan")


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def _num(c: Column, t: T.DataType) -> Column:
    return c.cast("double") if isinstance(t, (T.BooleanType, T.DecimalType)) else c


def _guarded(build):
    return lambda c, t: build(_num(c, t)) if is_numeric(t) else F.lit(_NAN)


#: Aggregates that skip missing values; those of numbers are NaN over a column that is not numeric.
AGGREGATES = {
    "max": _guarded(F.max),
    "min": _guarded(F.min),
    "mean": _guarded(F.avg),
    "median": _guarded(F.median),
    "sum": _guarded(F.sum),
    "variance": _guarded(F.var_samp),
    "populationvariance": _guarded(F.var_pop),
    "standarddeviation": _guarded(F.stddev_samp),
    "populationstandarddeviation": _guarded(F.stddev_pop),
    "quartiles": lambda c, t: F.percentile(_num(c, t), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if is_numeric(t) else F.array(*[F.lit(_NAN)] * 3),
    "uniquecount": lambda c, t: F.count_distinct(c),
    "count": lambda c, t: F.count(c),
    "proportionmissing": lambda c, t: F.avg(c.isNull().cast("int")),
    "proportionzero": lambda c, t: F.avg(F.coalesce((_num(c, t) == 0).cast("int"), F.lit(0))) if is_numeric(t) else F.avg(F.lit(0)),
}
#: Those that take more than one pass.
TWO_PASS = {"mode", "medianabsolutedeviation"}
_ALIAS = {"std": "standarddeviation", "samplestd": "standarddeviation", "samplestandarddeviation": "standarddeviation", "populationstd": "populationstandarddeviation", "average": "mean", "minimum": "min", "maximum": "max"}


def canonical(name) -> str:
    """The registry's name of a statistic, given in any case and spacing, or as one of the functions below."""
    if callable(name):
        name = name.__name__
    key = re.sub(r"[\s_]+", "", name).lower()
    key = _ALIAS.get(key, key)
    if key not in AGGREGATES and key not in TWO_PASS:
        raise InvalidArgumentValue(f"no such statistic: {name!r}; there are {sorted([*AGGREGATES, *TWO_PASS])}")
    return key


# -- functions of a vector (a table of one row or column, or any sequence) ------------------------------------------


def _values(values) -> list:
    from loomframe.plans.frame import Frame

    if isinstance(values, Frame):
        return values._cells()
    return list(values)


def _numbers(values) -> np.ndarray | None:
    kept = [v for v in _values(values) if not missing(v)]
    return None if any(isinstance(v, str) or not isinstance(v, (int, float, np.number, bool)) for v in kept) else np.array(kept, float)


def _of_numbers(f, empty=_NAN):
    def statistic(values):
        from loomframe.plans.frame import Frame

        if isinstance(values, Frame) and values._is_column():  # stays an aggregate of the plan
            return values._scalar(f.__name__)
        x = _numbers(values)
        return _NAN if x is None else empty if not len(x) else f(x)

    statistic.__name__, statistic.__doc__ = f.__name__, f.__doc__
    return statistic


@_of_numbers
def minimum(x):
    """Least of the numbers, missing values apart."""
    return float(x.min())


@_of_numbers
def maximum(x):
    """Greatest of the numbers."""
    return float(x.max())


@_of_numbers
def mean(x):
    """Mean of the numbers."""
    return float(x.mean())


@_of_numbers
def median(x):
    """Median, the middle two averaged."""
    return float(np.median(x))


def variance(values, sample: bool = True):
    """Variance; divided by one less than the count unless sample is False."""
    x = _numbers(values)
    return _NAN if x is None or len(x) <= int(sample) else float(x.var(ddof=int(sample)))


def standardDeviation(values, sample: bool = True):
    """Square root of the variance."""
    return variance(values, sample) ** 0.5


def populationStandardDeviation(values):
    return standardDeviation(values, False)


def medianAbsoluteDeviation(values):
    """Median of the distances from the median."""
    x = _numbers(values)
    return _NAN if x is None or not len(x) else float(np.median(np.abs(x - np.median(x))))


def quartiles(values):
    """Lower quartile, median and upper quartile, interpolated linearly."""
    x = _numbers(values)
    return (_NAN,) * 3 if x is None or not len(x) else tuple(float(q) for q in np.percentile(x, [25, 50, 75]))


def mode(values):
    """The most frequent value; of several, the middle one in order, left of the centre where their number is even."""
    counts: dict = {}
    for v in _values(values):
        if not missing(v):
            counts[v] = counts.get(v, 0) + 1
    if not counts:
        raise InvalidArgumentValue("every value is missing, so there is no mode")
    best = sorted(v for v, n in counts.items() if n == max(counts.values()))
    return best[(len(best) - 1) // 2]


def uniqueCount(values):
    return len({v for v in _values(values) if not missing(v)})


def count(values):
    return sum(not missing(v) for v in _values(values))


def sum(values):  # noqa: A001
    """Sum of what is not missing."""
    x = [v for v in _values(values) if not missing(v)]
    return np.sum(x).item() if x else 0


def proportionMissing(values):
    x = _values(values)
    return np.mean([missing(v) for v in x]).item() if x else _NAN


def proportionZero(values):
    x = _values(values)
    return np.mean([value_match(0)(v) and not isinstance(v, str) for v in x]).item() if x else _NAN


def nonMissing(elem) -> bool:
    return not missing(elem)


def nonMissingNonZero(elem) -> bool:
    return not missing(elem) and elem != 0


def residuals(toPredict, controlVars):
    """What a linear regression with intercept on controlVars leaves of toPredict, as a table of the same shape."""
    return controlVars._residuals(toPredict)
