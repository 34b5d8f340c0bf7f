"""Verbs on points (rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import ImproperObjectAction, InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions import statistics as S
from loomframe.plans.frame import PID, PNAME, Frame, Vector, _types_of, ranked, session
from loomframe.plans.predicates import QueryString


def align(self: Frame, other: Frame) -> DataFrame:
    """other's plan with its features in the order of self's, by name where both have all names, and of types that both can have."""
    if len(self._names) != len(other._names):
        raise InvalidArgumentValue("tables differ in their number of features")
    at = list(range(len(self._names)))
    if None not in self._names and None not in other._names:
        if set(self._names) != set(other._names):
            raise InvalidArgumentValue(f"feature names differ: {set(self._names) ^ set(other._names)}")
        at = [other._names.index(n) for n in self._names]
    return other._df.select(*other._keys, *[F.col(f"f{i}").alias(f"f{k}") for k, i in enumerate(at)])


def stacked(self: Frame, parts: list[DataFrame]) -> DataFrame:
    """Union by place of plans with the same features; a point has a name if any part names points."""
    named = any(PNAME in p.columns for p in parts)
    types = []
    for c in self._cols:
        kinds = {p.schema[c].dataType for p in parts}
        types.append(next(iter(kinds)) if len(kinds) == 1 else T.DoubleType() if all(map(S.is_numeric, kinds)) else T.StringType())
    out = None
    for p in parts:
        name = [F.col(PNAME) if PNAME in p.columns else F.lit(None).cast("string").alias(PNAME)] if named else []
        q = p.select(PID, *name, *[F.col(c).cast(t).alias(c) for c, t in zip(self._cols, types, strict=True)])
        out = q if out is None else out.unionByName(q)
    return out


class Points:
    def __init__(self, frame: Frame):
        self._f = frame

    def __iter__(self):
        names = self.getNames() if self._f._named else None
        for i, r in enumerate(self._f._ordered().select(*self._f._cols).toLocalIterator()):
            yield Vector(r, self._f._names, names[i] if names else None)

    def __getitem__(self, key) -> Frame:
        return self._f[key, :]

    def __len__(self) -> int:
        return self._f._count()

    # -- names ------------------------------------------------------------------------------------------------------

    def getNames(self) -> list:
        if not self._f._named:
            return [None] * len(self)
        return [r[0] for r in self._f._ordered().select(PNAME).collect()]

    def getName(self, index: int):
        return self._f._pick(self._f._point_ids(index)).points.getNames()[0]

    def getIndex(self, identifier) -> int:
        return self._f._point_ids(identifier)[0]

    def getIndices(self, names) -> list[int]:
        return self._f._point_ids(names)

    def hasName(self, name) -> bool:
        return self._f._named and not self._f._df.filter(F.col(PNAME) == name).isEmpty()

    def setNames(self, assignments, oldIdentifiers=None) -> None:
        """A list of all names, a dictionary of old to new, None for no names, or new names of the points given."""
        f = self._f._densify()
        if assignments is None:
            return f._rebind(f._with(f._df.drop(PNAME), rows=f._rows))
        if isinstance(assignments, dict):
            pairs = list(zip(f._point_ids(list(assignments)), assignments.values(), strict=True))
        elif oldIdentifiers is not None:
            new = [assignments] if isinstance(assignments, str) else assignments
            old = [oldIdentifiers] if isinstance(oldIdentifiers, (str, int)) else oldIdentifiers
            pairs = list(zip(f._point_ids(old), new, strict=True))
        else:
            pairs = list(enumerate(assignments))
            if len(pairs) != len(self):
                raise InvalidArgumentValue("there must be a name for each point")
        given = [n for _, n in pairs if n is not None]
        if len(set(given)) != len(given):
            raise InvalidArgumentValue("point names must be unique")
        new = session().createDataFrame(pairs, f"{PID} long, __name string")
        old = F.col(PNAME) if f._named else F.lit(None).cast("string")
        df = f._df.join(new.withColumn("__set", F.lit(True)), PID, "left").select(PID, F.when(F.col("__set"), F.col("__name")).otherwise(old).alias(PNAME), *f._cols)
        f._rebind(f._with(df, dense=True, rows=f._rows))

    # -- targets ------------------------------------------------------------------------------------------------------

    def _flag(self, function, features=None) -> Column:
        """A boolean Column of a predicate on points: a query, a quantified matcher, or a Python function of a Vector."""
        f = self._f
        if isinstance(function, QueryString):
            i = f._feature_index(function.identifier)
            return function.element(F.col(f"f{i}"), f._types[i])
        cols = f._feature_indices(features)
        if getattr(function, "__closure__", None) and function.__name__ == "check":
            match, every = (c.cell_contents for c in sorted(function.__closure__, key=lambda c: isinstance(c.cell_contents, bool)))
            flags = f._match_columns(match, cols)
            return (f._all if every else f._any)(flags)
        names = [f._names[i] for i in cols]
        return f._value_udf(lambda *v: bool(function(Vector(v, names))), T.BooleanType(), *[F.col(f"f{i}") for i in cols])

    def _query(self, text: str) -> QueryString:
        readings = [s for s in QueryString.splits(text) if s[0] in self._f._names]
        if len(readings) > 1:
            raise InvalidArgumentValue(f"several readings, so the query is ambiguous: {text!r}")
        if readings:
            return QueryString.of(*readings[0])
        names = [n for n in self._f._names if n is not None]
        raise InvalidArgumentValue(f"neither a point nor a query of a feature: {text!r}; the features are {names}")

    def _target(self, target, start, end, number, randomize, features) -> tuple[Frame, Frame]:
        """The points meant, in the order asked for, and the others."""
        f = self._f
        if target is not None and (start is not None or end is not None):
            raise InvalidArgumentValueCombination("either a target or a range, not both")
        if target is None and start is None and end is None and number is None:
            raise InvalidArgumentValueCombination("a target, a range or a number is needed")
        if features is not None and not (callable(target) or isinstance(target, str)):
            raise InvalidArgumentValueCombination("features go with a function only")
        if isinstance(target, str):
            if self.hasName(target):
                target = [target]
            else:
                target = self._query(target)
        chosen = None
        if callable(target):
            hit = self._flag(target, features)
        elif target is not None:
            ids = f._point_ids(target)
            chosen = ids
            if number is None:
                got = f._pick(ids)
                rest = f._df.join(F.broadcast(session().createDataFrame([(i,) for i in ids], f"{PID} long")), PID, "left_anti") if ids else f._df
                return got, f._with(rest, dense=False)
            hit = F.col(PID).isin(*ids)
        elif start is not None or end is not None:
            f._densify()
            low = f._point_ids(start)[0] if start is not None else 0
            high = f._point_ids(end)[0] if end is not None else f._count() - 1
            if low > high:
                raise InvalidArgumentValueCombination("the range ends before it starts")
            hit = F.col(PID).between(low, high)
        else:
            hit = F.lit(True)
        if number is None:
            rest = f._with(f._df.filter(~hit), dense=False)
            if isinstance(target, QueryString) and f._source is not None:  # the filter goes below the ids, to the scan
                i = f._feature_index(target.identifier)
                return Frame._over(f._source.filter(target.filter(F.col(f"f{i}"), f._types[i])), f._names, f.name, f.absolutePath), rest
            return f._with(f._df.filter(hit), dense=False), rest
        matched = f._df.filter(hit)
        keep = matched.orderBy(F.rand(_seed())) if randomize else matched.orderBy(PID)
        ids = keep.limit(number).select(PID)
        if randomize:  # a random order is drawn once
            ids = session().createDataFrame(ids.collect(), f"{PID} long")
        elif chosen is None and not randomize:
            taken = matched.orderBy(PID).limit(number)
            return f._with(taken, dense=False), f._with(f._df.join(taken.select(PID), PID, "left_anti"), dense=False)
        return f._with(f._df.join(ids, PID, "left_semi"), dense=False), f._with(f._df.join(ids, PID, "left_anti"), dense=False)

    def copy(self, toCopy=None, start=None, end=None, number=None, randomize=False, features=None) -> Frame:
        """Points by name, place, query, function, range (both ends included) or number."""
        return self._target(toCopy, start, end, number, randomize, features)[0]

    def extract(self, toExtract=None, start=None, end=None, number=None, randomize=False, features=None) -> Frame:
        got, rest = self._target(toExtract, start, end, number, randomize, features)
        self._f._rebind(rest)
        return got

    def delete(self, toDelete=None, start=None, end=None, number=None, randomize=False, features=None) -> None:
        self._f._rebind(self._target(toDelete, start, end, number, randomize, features)[1])

    def retain(self, toRetain=None, start=None, end=None, number=None, randomize=False, features=None) -> None:
        self._f._rebind(self._target(toRetain, start, end, number, randomize, features)[0])

    def count(self, condition, features=None) -> int:
        return self._target(condition, None, None, None, False, features)[0]._count()

    # -- order ----------------------------------------------------------------------------------------------------

    def sort(self, by=None, reverse: bool = False) -> None:
        """By names (None), by features, or by a function of a point; stable, missing values last."""
        f = self._f
        if by is None:
            keys = [F.col(PNAME)]
        elif callable(by):
            names = f._names  # the function goes to the workers, the frame cannot
            key = lambda *v: by(Vector(v, names))
            keys = [f._value_udf(key, f._kind_of(f._df, key, *map(F.col, f._cols)), *map(F.col, f._cols))]
        else:
            keys = [F.col(f"f{i}") for i in f._feature_indices(by)]
        null_last = [x for k in keys for x in ((k.isNull() if not reverse else k.isNotNull()), k)]
        tie = -F.col(PID) if reverse else F.col(PID)
        df = ranked(f._df, [*null_last, tie], "__new", f._count(), reverse).drop(PID).withColumnRenamed("__new", PID)
        f._rebind(f._with(df.select(*f._keys, *f._cols), dense=True, rows=f._rows))

    def permute(self, order=None) -> None:
        f = self._f
        if order is not None:
            ids = f._point_ids(order)
            if len(ids) != f._count():
                raise InvalidArgumentValue("an order must have every point")
            return f._rebind(f._pick(ids))
        key = F.xxhash64(F.lit(_seed()), PID)
        df = ranked(f._df, [key, F.col(PID)], "__new", f._count()).drop(PID).withColumnRenamed("__new", PID)
        f._rebind(f._with(df.select(*f._keys, *f._cols), dense=True, rows=f._rows))

    # -- functions ------------------------------------------------------------------------------------------------

    def calculate(self, function, points=None) -> Frame:
        """One value, or a row of values, for each point; a statistic by name or of this library stays an expression."""
        f = self._f
        part = f._pick(f._point_ids(points)) if points is not None else f
        try:
            return part.points.statistics(function)
        except (InvalidArgumentValue, TypeError, AttributeError):
            pass
        sample = part._df.select(*part._cols).limit(1).collect()
        got = function(Vector(sample[0], f._names)) if sample else 0.0
        wide = isinstance(got, (list, tuple, Vector)) or hasattr(got, "tolist") and getattr(got, "ndim", 0)
        names, cols = part._names, [F.col(c) for c in part._cols]
        if not wide:
            kind = part._kind_of(part._df, lambda *v: function(Vector(v, names)), *cols)
            kind = T.DoubleType() if isinstance(kind, T.LongType) else kind
            df = part._df.select(*part._keys, part._value_udf(lambda *v: function(Vector(v, names)), kind, *cols).alias("f0"))
            return part._with(df, [getattr(function, "__name__", None)], rows=part._rows)
        types = _types_of([x.item() if hasattr(x, "item") else x for x in got])
        one = types[0] if len({type(t) for t in types}) == 1 and not isinstance(types[0], T.LongType) else T.DoubleType() if all(map(S.is_numeric, types)) else T.StringType()
        rows = part._df.select(*part._keys, part._value_udf(lambda *v: [x.item() if hasattr(x, "item") else x for x in function(Vector(v, names))], T.ArrayType(one), *cols).alias("__r"))
        return part._with(rows.select(*part._keys, *[F.element_at("__r", k + 1).alias(f"f{k}") for k in range(len(types))]), [None] * len(types) if len(types) != len(names) else names, rows=part._rows)

    def transform(self, function, points=None) -> None:
        """Replaces each point by a function of it, of the same length."""
        f = self._f
        part = f.points.calculate(function)
        if len(part._names) != len(f._names):
            raise InvalidArgumentValue("the function must give as many values as there are features")
        if points is None:
            return f._rebind(f._with(part._df, rows=f._rows, dense=f._dense))
        hit = F.col(PID).isin(*f._point_ids(points))
        both = f._df.join(part._df.select(PID, *[F.col(c).alias(f"n_{c}") for c in f._cols]), PID)
        f._rebind(f._with(both.select(*f._keys, *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in f._cols]), rows=f._rows))

    def matching(self, function) -> Frame:
        f = self._f
        flag = self._flag(self._query(function) if isinstance(function, str) else function)
        return f._with(f._df.select(*f._keys, flag.alias("f0")), [getattr(function, "__name__", str(function))], rows=f._rows)

    def mapReduce(self, mapper, reducer) -> Frame:
        """Pairs that mapper makes of each point, grouped by key (a shuffle), and what reducer makes of a key and its values; None is dropped."""
        f = self._f
        names, cols = f._names, f._cols
        item = lambda v: v.item() if hasattr(v, "item") else v

        def emit(batches):
            import pandas as pd

            for b in batches:
                got = [(p, *kv) for p, r in zip(b[PID], b[cols].itertuples(index=False), strict=True) for kv in mapper(Vector([None if v is None or v != v else item(v) for v in r], names))]
                yield pd.DataFrame(got, columns=["pid", "k", "v"], dtype=object)

        def reduced_to(pdf):
            pdf = pdf.sort_values("pid", kind="stable")
            return pdf.pid.iloc[0], reducer(item(pdf.k.iloc[0]), [item(v) for v in pdf.v])

        def fold(pdf):
            import pandas as pd

            pid, got = reduced_to(pdf)
            return pd.DataFrame([] if got is None else [(pid, *got)], columns=[PID, "f0", "f1"])

        def kinds_of(pairs):
            """The types that occur, each once."""
            import pandas as pd

            found = {(at, _types_of([item(v)])[0].simpleString()) for pair in pairs for at, v in enumerate(pair) if v is not None and v == v}
            return pd.DataFrame(sorted(found), columns=["at", "kind"])

        def agreed(df):
            """Types of key and value that hold all of df's; None without rows."""
            found = [set(), set()]
            for r in df.distinct().collect():
                found[r["at"]].add(r["kind"])
            if not any(found):
                return None
            numbers = {"bigint", "double", "boolean"}
            mixed = [k for k in found if len(k) > 1 and not k <= numbers]
            if mixed:
                raise InvalidArgumentValue(f"keys, and values, must be of one type: {sorted(mixed[0])}")
            return [T.DoubleType() if len(k) != 1 else T.DataType.fromDDL(next(iter(k))) for k in found]

        none = f._with(f._df.limit(0).select(PID, F.lit(None).cast("double").alias("f0"), F.lit(None).cast("double").alias("f1")), [None, None])
        # types are those of all pairs, wherever they are
        types = agreed(f._df.select(PID, *cols).mapInPandas(lambda batches: (kinds_of(b[["k", "v"]].itertuples(index=False)) for b in emit(batches)), "at int, kind string"))
        if types is None:
            return none
        kt, vt = types
        schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("k", kt), T.StructField("v", vt)])
        mapped = f._df.select(PID, *cols).mapInPandas(emit, schema)
        types = agreed(mapped.groupBy("k").applyInPandas(lambda pdf: kinds_of([got] if (got := reduced_to(pdf)[1]) is not None else []), "at int, kind string"))
        if types is None:
            return none
        result = T.StructType([T.StructField(PID, T.LongType()), T.StructField("f0", types[0]), T.StructField("f1", types[1])])
        reduced = mapped.groupBy("k").applyInPandas(fold, result)
        # keys of one first point have one place; they are told apart by the key
        n = reduced.count()
        df = ranked(reduced.withColumnRenamed(PID, "__at"), [F.col("__at"), F.col("f0")], PID, n)
        return f._with(df.select(PID, "f0", "f1"), [None, None], dense=True, rows=n)

    def fillMatching(self, fillWith, matchingElements, points=None, **kwarguments) -> None:
        """Fills along each point: a value, or a fill function of the point."""
        f = self._f
        if not callable(fillWith):
            return f.features.fillMatching(fillWith, matchingElements, points=points)
        from loomframe.functions import fill

        part = fill.python_fill(fillWith, matchingElements, **kwarguments)
        self.transform(part, points)

    # -- insertion --------------------------------------------------------------------------------------------------

    def append(self, toAppend: Frame) -> None:
        self.insert(None, toAppend)

    def insert(self, insertBefore, toInsert: Frame) -> None:
        """Points of another table before a point (None: at the end); features are matched by name."""
        f = self._f._densify()
        n, m = f._count(), toInsert._densify()._count()
        at = n if insertBefore is None else f._point_ids(insertBefore)[0]
        if f._named and toInsert._named and not f._df.select(PNAME).join(toInsert._df.select(PNAME), PNAME).isEmpty():
            raise InvalidArgumentValue("both tables have a point of the same name")
        mine = f._df.withColumn(PID, F.when(F.col(PID) >= at, F.col(PID) + m).otherwise(F.col(PID)))
        theirs = align(f, toInsert).withColumn(PID, F.col(PID) + at)
        f._rebind(f._with(stacked(f, [mine, theirs]), dense=True, rows=n + m))

    def replace(self, data, points=None, **dataKwds) -> None:
        """Points, by place or name (by the names of the new ones if none are given), become those of another table."""
        f = self._f._densify()
        if not isinstance(data, Frame):
            from loomframe.sources.memory import data as make

            data = make(data, **dataKwds)
        ids = f._point_ids(points if points is not None else data.points.getNames())
        data._densify()
        if len(ids) != data._count():
            raise InvalidArgumentValue("there must be as many new points as places")
        where = session().createDataFrame(list(enumerate(ids)), f"{PID} long, __to long")
        new = align(f, data).join(F.broadcast(where), PID).drop(PID).withColumnRenamed("__to", PID)
        kept = f._df.join(F.broadcast(where.select(F.col("__to").alias(PID))), PID, "left_anti")
        f._rebind(f._with(stacked(f, [kept, new]), dense=True, rows=f._rows))

    # -- reshaping ----------------------------------------------------------------------------------------------------

    def splitByCollapsingFeatures(self, featuresToCollapse, featureForNames, featureForValues) -> None:
        """Melt: one point for each pair of a point and a collapsed feature."""
        f = self._f._densify()
        melt = f._feature_indices(featuresToCollapse)
        stay = [i for i in range(len(f._names)) if i not in melt]
        types = {type(f._types[i]) for i in melt}
        kind = f._types[melt[0]] if len(types) == 1 else T.DoubleType() if all(S.is_numeric(f._types[i]) for i in melt) else T.StringType()
        cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(f._names[i]).alias("n"), F.col(f"f{i}").cast(kind).alias("v")) for j, i in enumerate(melt)])
        k = len(melt)
        name = [F.concat_ws("_", PNAME, F.col("c.j").cast("string")).alias(PNAME)] if f._named else []
        df = f._df.withColumn("c", F.explode(cells)).select((F.col(PID) * k + F.col("c.j")).alias(PID), *name, *[F.col(f"f{i}").alias(f"f{x}") for x, i in enumerate(stay)], F.col("c.n").alias(f"f{len(stay)}"), F.col("c.v").alias(f"f{len(stay) + 1}"))
        f._rebind(f._with(df, [f._names[i] for i in stay] + [featureForNames, featureForValues], dense=True, rows=None if f._rows is None else f._rows * k))

    def combineByExpandingFeatures(self, featureWithFeatureNames, featuresWithValues, modifyDuplicateFeatureNames: bool = False) -> None:
        """Pivot: points alike in all other features become one, with a feature for each name (in order of appearance)."""
        f = self._f
        n = f._feature_index(featureWithFeatureNames)
        several = isinstance(featuresWithValues, (list, tuple))
        values = f._feature_indices(featuresWithValues)
        stay = [i for i in range(len(f._names)) if i != n and i not in values]
        found = [r[0] for r in f._df.groupBy(F.col(f"f{n}").cast("string").alias("n")).agg(F.min(PID).alias("p")).orderBy("p").select("n").collect()]
        keys = [F.col(f"f{i}") for i in stay]
        at = F.col(f"f{n}").cast("string")
        aggs, names = [F.min(PID).alias(PID)], []
        for name in found:
            for v in values:
                full = name if not several else f"{name}_{f._names[v]}"
                if full in [f._names[i] for i in stay] + names:
                    if not modifyDuplicateFeatureNames:
                        raise InvalidArgumentValue(f"there would be two features {full!r}")
                    full = f"{full}_2"
                names.append(full)
                aggs.append(F.max(F.when(at.eqNullSafe(F.lit(name)), F.col(f"f{v}"))).alias(f"f{len(stay) + len(names) - 1}"))
        doubled = f._df.groupBy(*keys, at.alias("__n")).count().filter("count > 1")
        if not doubled.isEmpty():
            raise ImproperObjectAction("two points are alike in all but the values")
        if f._named:
            aggs.append(F.min_by(PNAME, PID).alias(PNAME))
        df = f._df.groupBy(*[k.alias(f"k{x}") for x, k in enumerate(keys)]).agg(*aggs).select(*f._keys, *[F.col(f"k{x}").alias(f"f{x}") for x in range(len(stay))], *[f"f{len(stay) + x}" for x in range(len(names))])
        f._rebind(f._with(df, [f._names[i] for i in stay] + names, dense=False))

    def repeat(self, totalCopies: int, copyPointByPoint: bool) -> Frame:
        f = self._f._densify()
        n = f._count()
        copies = f._df.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(totalCopies - 1))))
        place = F.col(PID) * totalCopies + F.col("__c") if copyPointByPoint else F.col("__c") * n + F.col(PID)
        name = [F.concat_ws("_", PNAME, (F.col("__c") + 1).cast("string")).alias(PNAME)] if f._named else []
        return f._with(copies.select(place.cast("long").alias(PID), *name, *f._cols), dense=True, rows=n * totalCopies)

    def unique(self) -> Frame:
        """The first of equal points."""
        f = self._f
        first = [F.min_by(PNAME, PID).alias(PNAME)] if f._named else []
        return f._with(f._df.groupBy(*f._cols).agg(F.min(PID).alias(PID), *first).select(*f._keys, *f._cols), dense=False)

    # -- statistics ---------------------------------------------------------------------------------------------------

    def statistics(self, statisticsFunction) -> Frame:
        """A statistic of each point, from the array of its values."""
        f = self._f
        key = S.canonical(statisticsFunction)
        value = row_statistic(key, [F.col(c) for c in f._cols], f._types)
        names = {"uniquecount": "uniqueCount", "standarddeviation": "standardDeviation"}.get(key, key)
        cols = [value.alias("f0")] if key != "quartiles" else [F.element_at(value, i + 1).alias(f"f{i}") for i in range(3)]
        return f._with(f._df.select(*f._keys, *cols), [names] if key != "quartiles" else ["quartile1", "median", "quartile3"], rows=f._rows)

    def similarities(self, similarityFunction) -> Frame:
        return self._f.T.features.similarities(similarityFunction)

    def plot(self, points=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, None, points, **kwargs)

    def plotMeans(self, points=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, "mean", points, intervals=True, **kwargs)

    def plotStatistics(self, statistic, points=None, **kwargs):
        from loomframe.operators import plotting

        return plotting.bars(self._f, statistic, points, **kwargs)


def row_statistic(key: str, cols: list[Column], types: list[T.DataType]) -> Column:
    """A statistic over the columns of a row, by functions of arrays."""
    numeric = all(map(S.is_numeric, types))
    if key in ("proportionmissing", "proportionzero"):
        total = F.lit(0)
        for c, t in zip(cols, types, strict=True):
            total = total + (c.isNull() if key == "proportionmissing" else F.coalesce(c.cast("double") == 0, F.lit(False)) if S.is_numeric(t) else F.lit(False)).cast("int")
        return total / len(cols)
    kind = "double" if numeric else "string"
    x = F.filter(F.array(*[c.cast(kind) for c in cols]), lambda v: v.isNotNull())
    n = F.size(x)
    if key == "uniquecount":
        return F.size(F.array_distinct(x))
    if key == "count":
        return n
    if key == "mode":
        counts = F.transform(F.array_distinct(x), lambda v: F.struct(F.size(F.filter(x, lambda w: w == v)).alias("n"), v.alias("v")))
        most = F.array_max(F.transform(counts, lambda s: s["n"]))
        best = F.array_sort(F.transform(F.filter(counts, lambda s: s["n"] == most), lambda s: s["v"]))
        return F.element_at(best, (F.floor((F.size(best) - 1) / 2) + 1).cast("int"))
    if not numeric:
        return F.array(*[F.lit(float("nan"))] * 3) if key == "quartiles" else F.lit(float("nan"))
    zero = F.lit(0.0)
    total = F.aggregate(x, zero, lambda a, v: a + v)
    mean = F.when(n > 0, total / n)

    def quantile(arr: Column, q: float) -> Column:
        s = F.array_sort(arr)
        at = (F.size(arr) - 1) * q
        low = F.get(s, F.floor(at).cast("int"))
        return F.when(F.size(arr) > 0, low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at)))

    def spread(less: int) -> Column:
        return F.when(n > less, F.aggregate(x, zero, lambda a, v: a + (v - mean) * (v - mean)) / (n - less))

    if key == "medianabsolutedeviation":
        middle = quantile(x, 0.5)
        return quantile(F.transform(x, lambda v: F.abs(v - middle)), 0.5)
    return {
        "max": lambda: F.array_max(x), "min": lambda: F.array_min(x), "sum": lambda: total, "mean": lambda: mean, "median": lambda: quantile(x, 0.5),
        "variance": lambda: spread(1), "populationvariance": lambda: spread(0), "standarddeviation": lambda: F.sqrt(spread(1)), "populationstandarddeviation": lambda: F.sqrt(spread(0)),
        "quartiles": lambda: F.array(*[quantile(x, q) for q in (0.25, 0.5, 0.75)]),
    }[key]()


def _seed() -> int:
    from loomframe import random

    return random.generateSubsidiarySeed()


def _statistic_verb(name: str):
    def verb(self):
        return self.statistics(name)

    verb.__doc__ = f"{name} of each point."
    return verb


for _n, _s in {"max": "max", "mean": "mean", "median": "median", "min": "min", "uniqueCount": "unique count", "proportionMissing": "proportion missing", "proportionZero": "proportion zero", "standardDeviation": "standard deviation", "populationStandardDeviation": "population standard deviation", "mode": "mode", "sum": "sum", "variance": "variance", "medianAbsoluteDeviation": "median absolute deviation", "quartiles": "quartiles"}.items():
    setattr(Points, _n, _statistic_verb(_s))
