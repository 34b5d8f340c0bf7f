"""Plots: the figures are aggregated by Spark and bounded; matplotlib, if there, draws them. Each returns its figures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomframe.exceptions import PackageException
from loomframe.functions import statistics as S
from loomframe.functions.calculate import student_quantile
from loomframe.plans.frame import PID, ranked

CELLS_MOST = 250_000
#: Points whose moving averages one task takes, and values in a row that are added up once for all windows.
STRETCH, NODE = 200_000, 16


def _draw(kind: str, figures, outPath, show, **labels):
    if outPath is None and not show:
        return figures
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise PackageException("matplotlib is needed to draw; with show=False and no outPath the figures are returned") from e
    fig, ax = plt.subplots()
    if kind == "heat":
        ax.imshow(figures, aspect="auto")
    elif kind == "bar":
        ax.bar([str(k) for k, *_ in figures], [v for _, v, *_ in figures], yerr=[e[0] if e else 0 for _, _, *e in figures])
    else:
        ax.plot(*zip(*figures, strict=True), "." if kind == "scatter" else "-")
    if outPath:
        fig.savefig(outPath)
    if show:
        plt.show()
    return figures


def plotHeatMap(self, includeColorbar=False, outPath=None, show=True, title=True, xAxisLabel=True, yAxisLabel=True, **kwargs):
    """Cells of a table of CELLS_MOST cells at most."""
    n, p = self.shape
    f = self if n * p <= CELLS_MOST else self.points.copy(number=max(1, CELLS_MOST // p))
    return _draw("heat", f._rows_list(), outPath, show)


def plotFeatureDistribution(self, feature, outPath=None, show=True, figureID=None, title=True, xAxisLabel=True, yAxisLabel=True, xMin=None, xMax=None, bins: int = 20, **kwargs):
    """Counts in bins of equal width (of values, where they are not numbers)."""
    i = self._feature_index(feature)
    c = F.col(f"f{i}")
    if not S.is_numeric(self._types[i]):
        return _draw("bar", [tuple(r) for r in self._df.groupBy(c).count().orderBy(c).collect()], outPath, show)
    low, high = self._df.agg(F.min(c), F.max(c)).first()
    low, high = low if xMin is None else xMin, high if xMax is None else xMax
    width = (high - low) / bins or 1
    got = self._df.filter(c.between(low, high)).groupBy(F.least(F.floor((c - low) / width), F.lit(bins - 1)).alias("b")).count().orderBy("b").collect()
    return _draw("bar", [(low + r["b"] * width, r["count"]) for r in got], outPath, show)


def rolling_average(self, x, y, size: int = 20):
    """The plan of moving averages of both features in the order of the first, over full windows only. Stretches of the
    order are averaged one by one, each with the points before it that its first windows need."""
    i, j = self._feature_index(x), self._feature_index(y)
    place = ranked(self._df.select(PID, f"f{i}", *([f"f{j}"] if i != j else [])), [F.col(f"f{i}"), F.col(PID)], "place", self._count())
    place = place.select("place", F.col(f"f{i}").cast("double").alias("x"), F.col(f"f{j}").cast("double").alias("y"))
    before = -(-size // NODE) * NODE
    length = -(-max(STRETCH, before) // NODE) * NODE
    own, after = F.floor(F.col("place") / length), F.floor((F.col("place") + before) / length)
    dealt = place.withColumn("stretch", F.explode(F.array_distinct(F.array(own, after))))

    def averaged(part):
        part = part.sort_values("place", ignore_index=True)
        start = int(part["place"].iloc[0])
        first = max(size - 1, int(part["stretch"].iloc[0]) * length) - start
        return part.iloc[first:].assign(**{c: moving_averages(part[c].to_numpy(float), size)[first - size + 1 :] for c in ("x", "y")})[["x", "y"]] if 0 <= first < len(part) else part.iloc[:0][["x", "y"]]

    got = dealt.groupBy("stretch").applyInPandas(averaged, "x double, y double")
    return got.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])


def moving_averages(v: np.ndarray, size: int) -> np.ndarray:
    """Means of every `size` values in a row, missing (NaN) apart; NaN of none. A window is added up as a database does that
    keeps the sums of every NODE values: those before the first whole node, the nodes, those after. So means that are
    halfway between two rounded values round as there. The first value is that of a node."""
    known = ~np.isnan(v)
    n = len(v) - size + 1
    if n <= 0:
        return np.zeros(0)
    value = np.append(np.where(known, v, 0.0), np.zeros(NODE))
    nodes = np.zeros(len(value) // NODE)
    for k in range(NODE):
        nodes = nodes + value[k::NODE][: len(nodes)]
    begin = np.arange(n)
    end = begin + size
    whole, last = -(-begin // NODE), end // NODE
    total = np.zeros(n)

    def add(values, at, stop):
        here = at < stop
        total[here] += values[at[here]]

    for k in range(NODE):
        add(value, begin + k, np.minimum(whole * NODE, end))
    for k in range(size // NODE + 1):
        add(nodes, whole + k, last)
    for k in range(NODE):
        add(value, np.maximum(last, whole) * NODE + k, end)
    count = np.concatenate([[0], np.cumsum(known)])
    count = count[size:] - count[:-size]
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def plotFeatureAgainstFeatureRollingAverage(self, x, y, sampleSizeForAverage=20, groupByFeature=None, trend=None, outPath=None, show=True, **kwargs):
    return _draw("line", [tuple(r) for r in rolling_average(self, x, y, sampleSizeForAverage).limit(CELLS_MOST).collect()], outPath, show)


def plotFeatureAgainstFeature(self, x, y, groupByFeature=None, trend=None, outPath=None, show=True, **kwargs):
    i, j = self._feature_index(x), self._feature_index(y)
    points = [tuple(r) for r in self._df.select(f"f{i}", f"f{j}").limit(CELLS_MOST).collect()]
    if trend == "linear":
        slope, start = self._df.agg(F.regr_slope(f"f{j}", f"f{i}"), F.regr_intercept(f"f{j}", f"f{i}")).first()
        return _draw("scatter", points, outPath, show), (slope, start)
    return _draw("scatter", points, outPath, show)


def group_means(self, feature, groupFeature):
    i, g = self._feature_index(feature), self._feature_index(groupFeature)
    return self._df.groupBy(F.col(f"f{g}").alias("group")).agg(F.avg(f"f{i}").alias("mean"), F.stddev_samp(f"f{i}").alias("sd"), F.count(f"f{i}").alias("n")).orderBy("group")


def _half(sd, n) -> float:
    return student_quantile(0.975, n - 1) * sd / math.sqrt(n) if n > 1 and sd is not None else 0.0


def plotFeatureGroupMeans(self, feature, groupFeature, horizontal=False, outPath=None, show=True, **kwargs):
    """Means by group with intervals of 95 per cent."""
    return _draw("bar", [(r["group"], r["mean"], _half(r["sd"], r["n"])) for r in group_means(self, feature, groupFeature).collect()], outPath, show)


def plotFeatureGroupStatistics(self, statistic, feature, groupFeature, subgroupFeature=None, horizontal=False, outPath=None, show=True, **kwargs):
    i, keys = self._feature_index(feature), [f"f{self._feature_index(k)}" for k in (groupFeature, subgroupFeature) if k is not None]
    got = self._df.groupBy(*keys).agg(S.AGGREGATES[S.canonical(statistic)](F.col(f"f{i}"), self._types[i]).alias("v")).orderBy(*keys).collect()
    return _draw("bar", [(" / ".join(map(str, r[:-1])), r[-1]) for r in got], outPath, show)


def bars(f, statistic, identifiers=None, axis: str = "points", intervals: bool = False, horizontal=False, outPath=None, show=True, **kwargs):
    """A bar for each point or feature: its values, or a statistic of them."""
    part = f if identifiers is None else f[identifiers, :] if axis == "points" else f[:, identifiers]
    side = part.points if axis == "points" else part.features
    if statistic is None:
        return _draw("heat", part._rows_list(), outPath, show)
    values = side.statistics(statistic)._cells()
    names = side.getNames()
    errors = [0.0] * len(values)
    if intervals:
        sd, n = side.statistics("standard deviation")._cells(), side.statistics("count")._cells()
        errors = [_half(s, int(k)) for s, k in zip(sd, n, strict=True)]
    return _draw("bar", [(x if x is not None else i, v, e) for i, (x, v, e) in enumerate(zip(names, values, errors, strict=True))], outPath, show)


VERBS = {n: globals()[n] for n in ("plotHeatMap", "plotFeatureDistribution", "plotFeatureAgainstFeatureRollingAverage", "plotFeatureAgainstFeature", "plotFeatureGroupMeans", "plotFeatureGroupStatistics")}
