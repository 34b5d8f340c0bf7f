"""Verbs on features (columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions import calculate as C
from loomframe.functions import fill
from loomframe.functions import statistics as S
from loomframe.functions.match import missing
from loomframe.operators.points import _seed
from loomframe.plans.frame import PID, PNAME, Frame, Vector, _types_of, session
from loomframe.plans.predicates import QueryString
from loomframe.plans.quantiles import exact_quantiles


class Features:
    def __init__(self, frame: Frame):
        self._f = frame

    def __iter__(self):
        names = self._f.points.getNames() if self._f._named else None
        for c, n in zip(self._f._cols, self._f._names, strict=True):
            yield Vector([r[0] for r in self._f._ordered().select(c).collect()], names or [], n)

    def __getitem__(self, key) -> Frame:
        return self._f[:, key]

    def __len__(self) -> int:
        return len(self._f._names)

    # -- names ------------------------------------------------------------------------------------------------------

    def getNames(self) -> list:
        return list(self._f._names)

    def getName(self, index: int):
        return self._f._names[self._f._feature_index(index)]

    def getIndex(self, identifier) -> int:
        return self._f._feature_index(identifier)

    def getIndices(self, names) -> list[int]:
        return self._f._feature_indices(names)

    def hasName(self, name) -> bool:
        return name is not None and name in self._f._names

    def setNames(self, assignments, oldIdentifiers=None) -> None:
        f = self._f
        new = list(f._names)
        if assignments is None:
            new = [None] * len(new)
        elif isinstance(assignments, dict):
            for i, n in [(f._feature_index(k), v) for k, v in assignments.items()]:
                new[i] = n
        elif oldIdentifiers is not None:
            values = [assignments] if isinstance(assignments, str) else assignments
            for i, n in zip(f._feature_indices(oldIdentifiers), values, strict=True):
                new[i] = n
        else:
            new = list(assignments)
            if len(new) != len(f._names):
                raise InvalidArgumentValue("there must be a name for each feature")
        f._rebind(f._with(f._df, new, rows=f._rows))

    # -- targets ------------------------------------------------------------------------------------------------------

    def _flags(self, function, points=None) -> list[bool]:
        """Whether a predicate holds of each feature: one aggregation for matchers, the collected feature for other functions."""
        f = self._f
        part = f._pick(f._point_ids(points)) if points is not None else f
        if isinstance(function, QueryString):  # the value of a point, by its name or place
            key = function.identifier
            row = part._pick(part._point_ids(key if part.points.hasName(key) else int(key)))._rows_list()[0]
            q = QueryString(function.string[len(key) :].strip(), elementQuery=True)
            return [q(v) for v in row]
        if getattr(function, "__closure__", None) and function.__name__ == "check":
            match, every = (c.cell_contents for c in sorted(function.__closure__, key=lambda c: isinstance(c.cell_contents, bool)))
            flags = part._match_columns(match)
            row = part._df.select(*[m.alias(f"m{i}") for i, m in enumerate(flags)]).agg(*[(F.bool_and if every else F.bool_or)(f"m{i}") for i in range(len(flags))]).first()
            return [every if v is None else v for v in row]
        return [bool(function(v)) for v in part.features]

    def _target(self, target, start, end, number, randomize, points) -> list[int]:
        f = self._f
        if target is not None and (start is not None or end is not None):
            raise InvalidArgumentValueCombination("either a target or a range, not both")
        if isinstance(target, str) and target not in f._names:
            readings = QueryString.splits(target)
            if not readings:
                f._feature_index(target)
            good = [r for r in readings if f.points.hasName(r[0]) or r[0].lstrip("-").isdigit()]
            if len(good) != 1:
                raise InvalidArgumentValue(f"neither a feature nor a query of one point: {target!r}")
            target = QueryString.of(*good[0])
        if callable(target):
            out = [i for i, k in enumerate(self._flags(target, points)) if k]
        elif target is not None:
            out = f._feature_indices(target)
        elif start is not None or end is not None:
            out = f._feature_indices(slice(start, end))
        elif number is not None:
            out = list(range(len(f._names)))
        else:
            raise InvalidArgumentValueCombination("a target, a range or a number is needed")
        if number is not None and randomize:
            import random

            out = sorted(random.Random(_seed()).sample(out, min(number, len(out))))
        return out[:number] if number is not None else out

    def copy(self, toCopy=None, start=None, end=None, number=None, randomize=False, points=None) -> Frame:
        return self._f._select(self._target(toCopy, start, end, number, randomize, points))

    def extract(self, toExtract=None, start=None, end=None, number=None, randomize=False, points=None) -> Frame:
        at = self._target(toExtract, start, end, number, randomize, points)
        got = self._f._select(at)
        self._f._rebind(self._f._select([i for i in range(len(self)) if i not in at]))
        return got

    def delete(self, toDelete=None, start=None, end=None, number=None, randomize=False, points=None) -> None:
        self.extract(toDelete, start, end, number, randomize, points)

    def retain(self, toRetain=None, start=None, end=None, number=None, randomize=False, points=None) -> None:
        self._f._rebind(self.copy(toRetain, start, end, number, randomize, points))

    def count(self, condition, points=None) -> int:
        return len(self._target(condition, None, None, None, False, points))

    def sort(self, by=None, reverse: bool = False) -> None:
        """By names (None), by the values of points, or by a function of a feature."""
        f = self._f
        if by is None:
            keys = [n or "" for n in f._names]
        elif callable(by):
            keys = [by(v) for v in self]
        else:
            keys = [tuple(r) for r in zip(*f._pick(f._point_ids(by))._rows_list(), strict=True)]
        f._rebind(f._select(sorted(range(len(f._names)), key=lambda i: keys[i], reverse=reverse)))

    def permute(self, order=None) -> None:
        import random

        at = self._f._feature_indices(order) if order is not None else random.Random(_seed()).sample(range(len(self)), len(self))
        if len(at) != len(self):
            raise InvalidArgumentValue("an order must have every feature")
        self._f._rebind(self._f._select(at))

    # -- functions ------------------------------------------------------------------------------------------------

    def calculate(self, function, features=None) -> Frame:
        """One value, or a column of values, for each feature; a statistic stays an aggregate."""
        f = self._f if features is None else self._f._select(self._f._feature_indices(features))
        if isinstance(function, str) or getattr(function, "__module__", "") == S.__name__:
            try:
                return f.features.statistics(function)
            except InvalidArgumentValue:
                pass
        got = [function(v) for v in f.features]  # an opaque function needs the whole feature
        from loomframe.sources.memory import data

        rows = [got] if not any(isinstance(g, (list, tuple)) for g in got) else list(map(list, zip(*got, strict=True)))
        return data(rows, featureNames=f._names)

    def transform(self, function, features=None) -> None:
        f = self._f
        cols = f._feature_indices(features)
        new = {i: list(function(v)) for i, v in zip(cols, f._select(cols).features, strict=True)}
        if any(len(v) != f._count() for v in new.values()):
            raise InvalidArgumentValue("the function must give as many values as there are points")
        from loomframe.sources.memory import data

        self.replace(data(list(map(list, zip(*new.values(), strict=True))), featureNames=[f._names[i] for i in cols]), cols)

    def matching(self, function) -> Frame:
        from loomframe.sources.memory import data

        return data([self._flags(function)], featureNames=self._f._names)

    def insert(self, insertBefore, toInsert: Frame) -> None:
        f = self._f
        at = len(self) if insertBefore is None else f._feature_index(insertBefore)
        both, mine, theirs = f._beside(toInsert)
        cols = mine[:at] + theirs + mine[at:]
        names = f._names[:at] + toInsert._names + f._names[at:]
        f._rebind(f._with(both.select(*f._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), names, rows=f._rows))

    def append(self, toAppend: Frame) -> None:
        self.insert(None, toAppend)

    def replace(self, data, features=None, **dataKwds) -> None:
        f = self._f
        if not isinstance(data, Frame):
            from loomframe.sources.memory import data as make

            data = make(data, **dataKwds)
        at = f._feature_indices(features if features is not None else data._names)
        both, mine, theirs = f._beside(data)
        if len(at) != len(theirs):
            raise InvalidArgumentValue("there must be as many new features as places")
        names = list(f._names)
        for i, c, n in zip(at, theirs, data._names, strict=True):
            mine[i], names[i] = c, n if n is not None else names[i]
        f._rebind(f._with(both.select(*f._keys, *[c.alias(f"f{i}") for i, c in enumerate(mine)]), names, rows=f._rows))

    # -- fills and normalisation ------------------------------------------------------------------------------------

    def fillMatching(self, fillWith, matchingElements, features=None, points=None, **kwarguments) -> None:
        """Fills along each feature: a value, a statistic of what does not match, or in the order of points."""
        f = self._f
        cols = f._feature_indices(features)
        limit = F.lit(True) if points is None else F.col(PID).isin(*f._point_ids(points))
        if isinstance(matchingElements, Frame):
            both, mine, flags = f._beside(matchingElements)
            df = both.select(*f._keys, *[c.alias(f"f{i}") for i, c in enumerate(mine)], *[F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"__m{i}") for i, c in enumerate(flags)])
            hits = {i: F.col(f"__m{k}") & limit for k, i in enumerate(cols)}
        else:
            df, hits = f._df, {i: m & limit for i, m in zip(cols, f._match_columns(matchingElements, cols), strict=True)}
        name = fillWith if isinstance(fillWith, str) and fillWith in {*fill.STATISTICS, *fill.DIRECTIONAL} else getattr(fillWith, "__name__", None) if callable(fillWith) else None
        if name in fill.STATISTICS:
            values = df.agg(*[F.count_if(hits[i]).alias(f"h{i}") for i in cols], *[F.count_if(~hits[i]).alias(f"r{i}") for i in cols], *[S.AGGREGATES[name](F.when(~hits[i], F.col(f"f{i}")), f._types[i]).alias(f"v{i}") for i in cols if name not in ("mode", "median")]).first()
            new = {}
            numbers = [i for i in cols if name == "median" and S.is_numeric(f._types[i])]
            middle = dict(zip(numbers, exact_quantiles(df, [F.when(~hits[i], S._num(F.col(f"f{i}"), f._types[i])) for i in numbers], [0.5]), strict=True))
            for i in cols:
                if not values[f"h{i}"]:
                    continue
                if not values[f"r{i}"]:
                    raise InvalidArgumentValue(f"{name}: every value of feature {f._names[i]!r} matches")
                if name == "mode":
                    from loomframe.plans.frame import mode_plan

                    v = mode_plan(df.filter(~hits[i]), [], f"f{i}", f._types[i]).first()[0]
                else:
                    v = values[f"v{i}"] if name != "median" else middle[i][0] if i in middle else float("nan")
                    if v is None or v != v:
                        raise InvalidArgumentValue(f"{name}: the values of feature {f._names[i]!r} are not numbers")
                new[f"f{i}"] = F.when(hits[i], F.lit(v)).otherwise(F.col(f"f{i}"))
            return f._rebind(f._with(df.withColumns(new).select(*f._keys, *f._cols), rows=f._rows))
        if name in fill.DIRECTIONAL:
            f._densify()
            df = f._df if not isinstance(matchingElements, Frame) else df
            ends = df.agg(*[F.min_by(hits[i], PID).alias(f"a{i}") for i in cols], *[F.max_by(hits[i], PID).alias(f"z{i}") for i in cols]).first()
            for i in cols:
                if name == "forwardFill" and ends[f"a{i}"] or name == "backwardFill" and ends[f"z{i}"]:
                    raise InvalidArgumentValue(f"{name}: the {'first' if name == 'forwardFill' else 'last'} value of feature {f._names[i]!r} matches")
                df = fill.directional(df, PID, f"f{i}", hits[i], name, f._count())
            return f._rebind(f._with(df.select(*f._keys, *f._cols), dense=True, rows=f._rows))
        if callable(fillWith):
            return self.transform(fill.python_fill(fillWith, matchingElements, **kwarguments), cols)
        new = {f"f{i}": F.when(hits[i], F.lit(None) if missing(fillWith) else F.lit(fillWith)).otherwise(F.col(f"f{i}")) for i in cols}
        return f._rebind(f._with(df.withColumns(new).select(*f._keys, *f._cols), rows=f._rows))

    def normalize(self, function, applyResultTo: Frame | None = None, features=None) -> None:
        """By mean, mean and deviation, range or percentile: constants of this table, for it and for another."""
        f = self._f
        cols = f._feature_indices(features)
        name = function if isinstance(function, str) else function.__name__
        key = name.replace(" ", "").lower()
        if "percentile" in key:
            new = percentile_plan(f, cols)
            if applyResultTo is not None:
                applyResultTo._rebind(interpolated(f, new, cols, applyResultTo))
            return f._rebind(f._with(new[0].select(*f._keys, *[new[1].get(i, F.col(f"f{i}")).alias(f"f{i}") for i in range(len(f._names))]), rows=f._rows))
        aggs = [g(F.col(f"f{i}").cast("double")) for i in cols for g in (F.avg, F.stddev_pop, F.min, F.max)]
        row = f._df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()

        def apply(other: Frame) -> None:
            new = {}
            for k, i in enumerate(cols):
                mean, sd, low, high = row[4 * k : 4 * k + 4]
                x = F.col(f"f{i}").cast("double")
                if "standarddeviation" in key:
                    new[f"f{i}"] = (x - mean) / (sd or 1)
                elif "range" in key:
                    new[f"f{i}"] = (x - low) / ((high - low) or 1)
                elif "mean" in key:
                    new[f"f{i}"] = x - mean
                else:
                    raise InvalidArgumentValue(f"no such normalisation: {name!r}")
            other._rebind(other._with(other._df.withColumns(new), rows=other._rows))

        if key not in ("meannormalize", "meanstandarddeviationnormalize", "range0to1normalize", "rangenormalize"):
            if not callable(function):
                raise InvalidArgumentValue(f"no such normalisation: {name!r}")
            return self.transform(function, cols)
        apply(f)
        if applyResultTo is not None:
            apply(applyResultTo)

    # -- reshaping ----------------------------------------------------------------------------------------------------

    def splitByParsing(self, feature, rule, resultingNames) -> None:
        """One feature becomes several: by a separator, by places, by a list of these, or by a function."""
        f = self._f
        at, k = f._feature_index(feature), len(resultingNames)
        text = F.col(f"f{at}").cast("string")
        if callable(rule):
            parts = f._value_udf(lambda v: [str(x) for x in rule(v)], T.ArrayType(T.StringType()), F.col(f"f{at}"))
        elif isinstance(rule, str):
            import re

            parts = F.split(text, re.escape(rule))
        elif isinstance(rule, int):
            parts = F.array(F.substring(text, 1, rule), F.substring(text, rule + 1, 2**31 - 1))
        else:
            pieces, rest = [], text
            taken = 0
            for r in rule:
                if isinstance(r, int):
                    pieces.append(F.substring(rest, 1, r - taken))
                    rest, taken = F.substring(rest, r - taken + 1, 2**31 - 1), r
                else:
                    where = F.instr(rest, r)
                    pieces.append(F.when(where > 0, F.left(rest, where - 1)))
                    rest = F.when(where > 0, F.substring(rest, where + len(r), F.lit(2**31 - 1)))
            parts = F.array(*pieces, rest)
        df = f._df.withColumn("__parts", parts)
        bad = df.filter((F.size("__parts") != k) | F.exists("__parts", lambda p: p.isNull())).limit(1)
        if not bad.isEmpty():
            raise InvalidArgumentValue(f"a value of the feature does not give {k} parts")
        cols = [F.col(f"f{i}") for i in range(at)] + [F.element_at("__parts", j + 1) for j in range(k)] + [F.col(f"f{i}") for i in range(at + 1, len(f._names))]
        names = f._names[:at] + list(resultingNames) + f._names[at + 1 :]
        f._rebind(f._with(df.select(*f._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), names, rows=f._rows))

    def repeat(self, totalCopies: int, copyFeatureByFeature: bool) -> Frame:
        n = len(self)
        order = [(i, c) for i in range(n) for c in range(totalCopies)] if copyFeatureByFeature else [(i, c) for c in range(totalCopies) for i in range(n)]
        f = self._f
        df = f._df.select(*f._keys, *[F.col(f"f{i}").alias(f"f{k}") for k, (i, _) in enumerate(order)])
        return f._with(df, [None if f._names[i] is None else f"{f._names[i]}_{c + 1}" for i, c in order], rows=f._rows)

    def unique(self) -> Frame:
        """The first of equal features: by digests of their content, in one aggregation, then an exact comparison."""
        f = self._f
        cell = [F.xxhash64(F.col(PID), F.col(c).cast("double" if S.is_numeric(t) else "string")) for c, t in zip(f._cols, f._types, strict=True)]
        row = f._df.agg(*[F.bit_xor(h).alias(f"d{i}") for i, h in enumerate(cell)]).first()
        keep: list[int] = []
        for i, d in enumerate(row):
            same = [j for j in keep if row[j] == d]
            if not any(f._df.filter(~F.col(f"f{i}").eqNullSafe(F.col(f"f{j}"))).isEmpty() for j in same):
                keep.append(i)
        return f._select(keep)

    # -- statistics ---------------------------------------------------------------------------------------------------

    def statistics(self, statisticsFunction, groupByFeature=None):
        f = self._f
        if groupByFeature is not None:
            return f.groupByFeature(groupByFeature, statisticsFunction)
        from loomframe.sources.memory import data

        key = S.canonical(statisticsFunction)
        row = list(f.feature_statistics(key).first())
        names = {"uniquecount": "uniqueCount", "standarddeviation": "standardDeviation", "populationstandarddeviation": "populationStandardDeviation", "proportionmissing": "proportionMissing", "proportionzero": "proportionZero", "medianabsolutedeviation": "medianAbsoluteDeviation"}
        if key == "quartiles":
            return data(list(map(list, zip(*row, strict=True))), pointNames=["quartile1", "median", "quartile3"], featureNames=f._names)
        return data([row], pointNames=[names.get(key, key)], featureNames=f._names)

    def similarities(self, similarityFunction) -> Frame:
        """Correlation, covariance or dot products of all pairs of features, over points that have both, in one aggregation."""
        f = self._f
        key = similarityFunction.replace(" ", "").lower()
        pair = {"correlation": F.corr, "covariance": F.covar_samp, "samplecovariance": F.covar_samp, "populationcovariance": F.covar_pop, "dotproduct": lambda a, b: F.sum(a * b)}
        if key not in pair:
            raise InvalidArgumentValue(f"no such similarity: {similarityFunction!r}")
        x = [F.col(c).cast("double") for c in f._cols]
        n = len(x)
        row = f._df.agg(*[pair[key](x[i], x[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
        from loomframe.sources.memory import data

        return data([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], pointNames=f._names if None not in f._names else None, featureNames=f._names)

    def report(self, basicStatistics: bool = True, extraStatisticFunctions=(), dtypes: bool = False) -> Frame:
        """A point for each feature: its statistics, from one aggregation, one for each mode and the passes of the quartiles."""
        f = self._f
        from loomframe.sources.memory import data

        names = ["mean", "mode", "minimum", "Q1", "median", "Q3", "maximum", "uniqueCount", "count", "standardDeviation"] if basicStatistics else []
        rows = []
        get = lambda s: list(f.feature_statistics(s).first())
        if basicStatistics:
            keys = ["mean", "min", "max", "uniquecount", "count", "standarddeviation"]
            row = f._df.agg(*[S.AGGREGATES[k](F.col(c), t).alias(f"{k}_{c}") for k in keys for c, t in zip(f._cols, f._types, strict=True)]).first()
            modes, quarters = get("mode"), f._quantiles([0.25, 0.5, 0.75])
            for i, c in enumerate(f._cols):
                q = quarters[i]
                number = S.is_numeric(f._types[i])
                rows.append([row[f"mean_{c}"], modes[i] if number else None, row[f"min_{c}"], *q, row[f"max_{c}"], row[f"uniquecount_{c}"], row[f"count_{c}"], row[f"standarddeviation_{c}"]])
        else:
            rows = [[] for _ in f._cols]
        for s in extraStatisticFunctions:
            names.append(s if isinstance(s, str) else s.__name__)
            for r, v in zip(rows, get(s), strict=True):
                r.append(v)
        return data(rows, pointNames=f._names if None not in f._names else None, featureNames=names)

    def plot(self, features=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, None, features, axis="features", **kwargs)

    def plotMeans(self, features=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, "mean", features, axis="features", intervals=True, **kwargs)

    def plotStatistics(self, statistic, features=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, statistic, features, axis="features", **kwargs)


def percentile_plan(f: Frame, cols: list[int]) -> tuple[DataFrame, dict]:
    """The plan with a percentile beside each feature: places of distinct values are sums of counts, joined back by value, so no window spans the points."""
    df, new = f._df, {}
    for i in cols:
        c = F.col(f"f{i}").cast("double")
        counts = df.filter(c.isNotNull()).groupBy(c.alias("__v")).count()
        total = df.agg(F.count(c)).first()[0]
        distinct = counts.count()
        if distinct <= 2_000_000:
            before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1))
            place = counts.select("__v", ((F.coalesce(before, F.lit(0)) + (F.col("count") - 1) / 2) / max(total - 1, 1)).alias(f"__p{i}"))
        else:
            from loomframe.plans.frame import ranked

            at = ranked(df.filter(c.isNotNull()).select(c.alias("__v"), PID), [F.col("__v"), F.col(PID)], "__r", total)
            place = at.groupBy("__v").agg((F.avg("__r") / max(total - 1, 1)).alias(f"__p{i}"))
        if total == 1:
            place = place.withColumn(f"__p{i}", F.lit(0.5))
        df = df.join(place, c == F.col("__v"), "left").drop("__v")
        new[i] = F.col(f"__p{i}")
    return df, new


def interpolated(f: Frame, plan: tuple[DataFrame, dict], cols: list[int], other: Frame) -> Frame:
    """Percentiles of another table's values, on the line between the values of the first that enclose them."""
    df = other._df
    for i in cols:
        known = plan[0].filter(F.col(f"f{i}").isNotNull()).select(F.col(f"f{i}").cast("double").alias("v"), plan[1][i].alias("p")).distinct()
        both = df.select(PID, F.col(f"f{i}").cast("double").alias("v"), F.lit(None).cast("double").alias("p")).filter("v is not null").unionByName(known.select(F.lit(None).cast("long").alias(PID), "v", "p"))
        pair = F.when(F.col("p").isNotNull(), F.struct("v", "p"))
        w = Window.partitionBy(F.lit(0)).orderBy("v", F.col("p").isNull())
        both = both.withColumn("lo", F.last(pair, ignorenulls=True).over(w)).withColumn("hi", F.first(pair, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        value = F.when(F.col("lo").isNull(), 0.0).when(F.col("hi").isNull(), 1.0).when(F.col("lo.v") == F.col("v"), F.col("lo.p")).otherwise(F.col("lo.p") + (F.col("hi.p") - F.col("lo.p")) * (F.col("v") - F.col("lo.v")) / (F.col("hi.v") - F.col("lo.v")))
        got = both.filter(F.col(PID).isNotNull()).select(PID, value.alias("__q"))
        df = df.join(got, PID, "left").withColumn(f"f{i}", F.col("__q")).drop("__q")
    return other._with(df, rows=other._rows)


def _statistic_verb(name: str):
    def verb(self, groupByFeature=None):
        return self.statistics(name, groupByFeature)

    verb.__doc__ = f"{name} of each feature, or by group."
    return verb


for _n, _s in {"max": "max", "mean": "mean", "median": "median", "min": "min", "uniqueCount": "unique count", "proportionMissing": "proportion missing", "proportionZero": "proportion zero", "standardDeviation": "standard deviation", "populationStandardDeviation": "population standard deviation", "mode": "mode", "sum": "sum", "variance": "variance", "medianAbsoluteDeviation": "median absolute deviation", "quartiles": "quartiles"}.items():
    setattr(Features, _n, _statistic_verb(_s))
