"""Verbs on whole tables: merge, reshaping, encoding, arithmetic, linear algebra, splitting, display."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import ImproperObjectAction, InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions import calculate as C
from loomframe.functions import statistics as S
from loomframe.plans.frame import PID, PNAME, Frame, ranked, session

# -- side by side --------------------------------------------------------------------------------------------------------


def _beside(self: Frame, other: Frame) -> tuple[DataFrame, list[Column], list[Column]]:
    """Points of both tables joined by place, with the columns of each; without a join if both are columns of one plan.
    Only then are the ids those that self had before: those of a table joined by place are places."""
    if other._df is self._df:
        return self._df, [F.col(c) for c in self._cols], [F.col(c) for c in other._cols]
    (df, x, _), (same, y, _) = self._rooted(), other._rooted()
    if same is df:
        return df, list(x), list(y)
    a, b = self._densify(), other._densify()
    if a._count() != b._count():
        raise InvalidArgumentValue("tables differ in their number of points")
    right = b._df.select(PID, *[F.col(c).alias(f"o{i}") for i, c in enumerate(b._cols)])
    return a._df.join(right, PID), [F.col(c) for c in a._cols], [F.col(f"o{i}") for i in range(len(b._names))]


# -- merge -----------------------------------------------------------------------------------------------------------------


def merge(self: Frame, other: Frame, point: str = "strict", feature: str = "union", onFeature=None, force: bool = False) -> None:
    """Joins with another table on one feature, or on the names of points. Features of both are taken from whichever
    has a value; two different values are an error. A key that is missing matches nothing."""
    for v in (point, feature):
        if v not in ("strict", "union", "intersection", "left"):
            raise InvalidArgumentValue(f"no such mode: {v!r}")
    if point == feature == "strict":
        raise InvalidArgumentValueCombination("points and features cannot both be strict")
    merged = merged_plan(self, other, point, feature, onFeature, force)
    self._rebind(merged)


def merged_plan(left: Frame, right: Frame, point: str, feature: str, onFeature, force: bool) -> Frame:
    if onFeature is not None:
        i, j = left._feature_index(onFeature), right._feature_index(onFeature)
        lk, rk = F.col(f"f{i}"), F.col(f"f{j}")
    else:
        i = j = None
        if not (left._named and right._named):
            if not force or point not in ("strict", "union"):
                raise InvalidArgumentValueCombination("points need names, or force")
            left, right = left._densify(), right._densify()
            lk = rk = F.col(PID).cast("string") if point == "strict" else None
            if point == "union":  # no name is shared
                lk, rk = F.concat(F.lit("l"), F.col(PID)), F.concat(F.lit("r"), F.col(PID))
        else:
            lk, rk = F.col(PNAME), F.col(PNAME)
    if feature == "strict" and (len(left._names) != len(right._names) or not force and set(left._names) != set(right._names)):
        raise InvalidArgumentValue("features must be the same")
    at = {n: k for k, n in enumerate(right._names) if n is not None} if not (feature == "strict" and force) else dict(zip(left._names, range(len(right._names)), strict=True))
    shared = [n for n in left._names if n is not None and n in at and n != (left._names[i] if i is not None else None)]
    l = left._df.select(lk.alias("__k"), F.col(PID).alias("__l"), *([F.col(PNAME).alias("__ln")] if left._named else []), *[F.col(c).alias(f"l{k}") for k, c in enumerate(left._cols)])  # noqa: E741
    r = right._df.select(rk.alias("__rk"), F.col(PID).alias("__r"), *([F.col(PNAME).alias("__rn")] if right._named else []), *[F.col(c).alias(f"r{k}") for k, c in enumerate(right._cols)])
    twice = [d.filter(F.col(k).isNotNull()).groupBy(k).count().filter("count > 1") for d, k in ((l, "__k"), (r, "__rk"))]
    many = [not t.isEmpty() for t in twice]
    if all(many) or point == "strict" and any(many):
        raise InvalidArgumentValue("the key must be unique on one side at least (on both where points are strict)")
    how = {"strict": "inner", "intersection": "inner", "left": "left", "union": "full"}[point]
    both = l.join(r, F.col("__k") == F.col("__rk"), how)
    if point == "strict":
        n = [left._count(), right._count(), both.count()]
        if len(set(n)) > 1:
            raise InvalidArgumentValue("points must be the same")
    if shared:
        clash = F.lit(False)
        for n in shared:
            clash = clash | (F.col(f"l{left._names.index(n)}") != F.col(f"r{at[n]}"))
        if not both.filter(clash).isEmpty():
            raise InvalidArgumentValue("the tables have different values for the same feature of a point")
    cols, names = [], []
    for k, n in enumerate(left._names):
        c = F.col(f"l{k}")
        if i is not None and k == i:
            c = F.coalesce("__k", "__rk")
        elif n in shared:
            c = F.coalesce(c, F.col(f"r{at[n]}"))
        elif feature == "intersection":
            continue
        cols.append(c)
        names.append(n)
    if feature == "union":
        for k, n in enumerate(right._names):
            if n not in shared and k != j:
                cols.append(F.col(f"r{k}"))
                names.append(n)
    key = F.coalesce("__k", "__rk")
    name = [F.coalesce(*[c for c, has in (("__ln", left._named), ("__rn", right._named)) if has]).alias(PNAME)] if onFeature is None and (left._named or right._named) else []
    order = [key.isNull(), key, F.coalesce("__l", F.lit(2**62)), F.coalesce("__r", F.lit(2**62))] if point == "union" and onFeature is not None else [F.coalesce("__l", F.lit(2**62)), F.coalesce("__r", F.lit(2**62))]
    out = both.select(F.struct(*order).alias("__o"), *name, *[c.alias(f"f{k}") for k, c in enumerate(cols)])
    df = ranked(out, [F.col("__o")], PID, max(1, left._count() + right._count()))
    return left._with(df.select(PID, *([PNAME] if name else []), *[f"f{k}" for k in range(len(cols))]), names, dense=True)


# -- reshaping ----------------------------------------------------------------------------------------------------------------

#: Points that may become features: a plan of that many columns is the limit, as in Spark's own transpose.
TRANSPOSE_MOST = 5000


def transpose(self: Frame) -> None:
    self._rebind(self.T)


def _t(self: Frame) -> Frame:
    self._densify()
    n, p = self.shape
    if n > TRANSPOSE_MOST:
        raise ImproperObjectAction(f"{n} points cannot become features; the limit is {TRANSPOSE_MOST}")
    long = self._long(list(range(p)))
    kind = long.schema["value"].dataType
    if all(isinstance(t, (T.LongType, T.IntegerType)) for t in self._types):
        kind = T.LongType()
    wide = long.groupBy("feature").agg(*[F.max(F.when(F.col(PID) == i, F.col("value"))).cast(kind).alias(f"f{i}") for i in range(n)])
    names = self.points.getNames()
    pname = []
    if any(x is not None for x in self._names):
        labels = F.array(*[F.lit(x) for x in self._names])
        pname = [F.element_at(labels, F.col("feature") + 1).alias(PNAME)]
    return Frame(wide.select(F.col("feature").cast("long").alias(PID), *pname, *[f"f{i}" for i in range(n)]), names, True, self.name, self.absolutePath, p)


def flatten(self: Frame, order: str = "point") -> None:
    """All values in one point, named `point | feature` where both axes have names."""
    from loomframe.sources.memory import data

    n, p = self.shape
    dims = list(self.dimensions)
    rows, names = self._rows_list(), self.points.getNames()
    at = [(i, j) for i in range(n) for j in range(p)] if order == "point" else [(i, j) for j in range(p) for i in range(n)]
    both = all(x is not None for x in names) and all(x is not None for x in self._names) and n and p
    out = data([[rows[i][j] for i, j in at]], featureNames=[f"{names[i]} | {self._names[j]}" for i, j in at] if both else None, pointNames=["Flattened"])
    self._rebind(out)
    self._flat = dims


def unflatten(self: Frame, dataDimensions, order: str = "point") -> None:
    from loomframe.sources.memory import data

    n, p = dataDimensions
    if 1 not in self.shape or self.shape[0] * self.shape[1] != n * p:
        raise ImproperObjectAction("only one point or one feature, of as many values as the dimensions have, can be unflattened")
    cells = self._cells()
    rows = [cells[i * p : (i + 1) * p] for i in range(n)] if order == "point" else [[cells[j * n + i] for j in range(p)] for i in range(n)]
    names = [x.split(" | ") for x in self._names if x and " | " in x]
    pts = list(dict.fromkeys(x[0] for x in names)) if len(names) == n * p else None
    fts = list(dict.fromkeys(x[1] for x in names)) if len(names) == n * p else None
    self._rebind(data(rows, pointNames=pts, featureNames=fts))


def replaceRectangle(self: Frame, replaceWith, pointStart, featureStart, pointEnd=None, featureEnd=None) -> None:
    """A constant, or another table, in a rectangle that includes its ends."""
    self._densify()
    a, c = self._point_ids(pointStart)[0], self._feature_index(featureStart)
    if isinstance(replaceWith, Frame):
        n, p = replaceWith._densify().shape
        b, d = a + n - 1, c + p - 1
        right = replaceWith._df.select((F.col(PID) + a).alias(PID), *[F.col(x).alias(f"o{i}") for i, x in enumerate(replaceWith._cols)], F.lit(True).alias("__in"))
        both = self._df.join(right, PID, "left")
        new = {f"f{c + i}": F.when(F.col("__in"), F.col(f"o{i}")).otherwise(F.col(f"f{c + i}")) for i in range(p)}
        return self._rebind(self._with(both.withColumns(new).select(*self._keys, *self._cols), rows=self._rows))
    b = self._point_ids(pointEnd)[0] if pointEnd is not None else self._count() - 1
    d = self._feature_index(featureEnd) if featureEnd is not None else len(self._names) - 1
    new = {f"f{i}": F.when(F.col(PID).between(a, b), F.lit(replaceWith)).otherwise(F.col(f"f{i}")) for i in range(c, d + 1)}
    self._rebind(self._with(self._df.withColumns(new), rows=self._rows))


# -- encoding -------------------------------------------------------------------------------------------------------------------


def replaceFeatureWithBinaryFeatures(self: Frame, featureToReplace) -> list[str]:
    """One feature of zeros and ones for each value, in its place; returns their names."""
    at = self._feature_index(featureToReplace)
    c = F.col(f"f{at}")
    values = [r[0] for r in self._df.filter(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v").collect()]
    show = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    names = [f"{self._names[at] if self._names[at] is not None else featureToReplace}={show(v)}" for v in values]
    new = [F.coalesce((c == F.lit(v)).cast("long"), F.lit(0)) for v in values]
    cols = [F.col(f"f{i}") for i in range(at)] + new + [F.col(f"f{i}") for i in range(at + 1, len(self._names))]
    self._rebind(self._with(self._df.select(*self._keys, *[x.alias(f"f{i}") for i, x in enumerate(cols)]), self._names[:at] + names + self._names[at + 1 :], rows=self._rows))
    return names


def integer_codes(df: DataFrame, column: str, numeric: bool) -> DataFrame:
    """value and code of each value, by first appearance; zero has code 0."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(PID).alias("p"))
    zero = F.when(F.col("value") == 0, 0).otherwise(1) if numeric else F.lit(1)
    return ranked(first, [zero, F.col("p")], "code", first.count()).select("value", "code")


def transformFeatureToIntegers(self: Frame, featureToConvert) -> dict:
    """Each value becomes an integer, by first appearance; returns the values by integer."""
    at = self._feature_index(featureToConvert)
    codes = integer_codes(self._df, f"f{at}", S.is_numeric(self._types[at]))
    joined = self._df.join(codes, self._df[f"f{at}"].eqNullSafe(codes["value"]))
    self._rebind(self._with(joined.select(*self._keys, *[F.col("code").alias(c) if c == f"f{at}" else F.col(c) for c in self._cols]), rows=self._rows))
    return {r["code"]: r["value"] for r in codes.collect()}


# -- splitting ------------------------------------------------------------------------------------------------------------------


def trainAndTestSets(self: Frame, testFraction: float, labels=None, randomOrder: bool = True) -> tuple:
    """Training and testing tables of exact sizes; with labels: trainX, trainY, testX, testY."""
    n = self._count()
    test = int(round(testFraction * n))
    source = self.copy()
    if randomOrder:
        source.points.permute()
    source._densify()
    parts = [source._with(source._df.filter(F.col(PID) < n - test), rows=n - test), source._with(source._df.filter(F.col(PID) >= n - test), dense=False, rows=test)]
    if labels is None:
        return tuple(parts)
    if isinstance(labels, Frame):
        raise InvalidArgumentValue("labels are features of this table here; append them first")
    at = self._feature_indices(labels)
    rest = [i for i in range(len(self._names)) if i not in at]
    return parts[0]._select(rest), parts[0]._select(at), parts[1]._select(rest), parts[1]._select(at)


# -- arithmetic -------------------------------------------------------------------------------------------------------------------


def _floor(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def _whole(*types) -> bool:
    return all(isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)) for t in types)


OPERATIONS = {
    "add": lambda a, b, w: a + b,
    "sub": lambda a, b, w: a - b,
    "mul": lambda a, b, w: a * b,
    "truediv": lambda a, b, w: a.cast("double") / b.cast("double"),
    "floordiv": lambda a, b, w: _floor(a, b) if w else _floor(a, b).cast("double"),
    "mod": lambda a, b, w: a - b * _floor(a, b),
    "pow": lambda a, b, w: F.pow(a.cast("double"), b.cast("double")),
}
LOGICAL = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}
DIVIDING = {"truediv", "floordiv", "mod"}


def _numeric_only(f: Frame) -> None:
    if not all(map(S.is_numeric, f._types)):
        raise ImproperObjectAction("arithmetic needs numbers in every feature")


def _as_number(c: Column, t: T.DataType) -> Column:
    return c.cast("long") if isinstance(t, T.BooleanType) else c


def apply_columns(op: str, left: list[tuple[Column, T.DataType]], right: list[tuple[Column, T.DataType]]) -> list[Column]:
    return [OPERATIONS[op](_as_number(a, s), _as_number(b, t), _whole(s, t)) for (a, s), (b, t) in zip(left, right, strict=True)]


def binary(self: Frame, op: str, other, swapped: bool = False):
    """Elementwise with a table of the same shape, or with a number; a divisor of zero is an error."""
    from loomframe.operators.stretch import Stretch

    if isinstance(other, Stretch):
        return NotImplemented
    _numeric_only(self)
    df, mine, weight = self._rooted()
    mine = list(zip(mine, self._types, strict=True))
    if isinstance(other, Frame):
        _numeric_only(other)
        if self.shape != other.shape:
            raise InvalidArgumentValue(f"shapes differ: {self.shape} and {other.shape}")
        if None not in self._names and None not in other._names and self._names != other._names:
            if set(self._names) != set(other._names):
                if not (self._named and other._named):
                    raise InvalidArgumentValueCombination("names must agree on one axis at least")
            else:
                other = other._select([other._names.index(n) for n in self._names])
        if op in DIVIDING and other.containsZero():
            raise ZeroDivisionError("the divisor has a zero")
        weight += other._rooted()[2]
        df, a, b = _beside(self, other)
        cols = apply_columns(op, list(zip(a, self._types, strict=True)), list(zip(b, other._types, strict=True)))
    elif isinstance(other, (int, float, np.number)):
        value = other.item() if hasattr(other, "item") else other
        if op in DIVIDING and (self.containsZero() if swapped else value == 0):
            raise ZeroDivisionError("the divisor has a zero")
        kind = T.DoubleType() if isinstance(value, float) else T.LongType()
        scalar = [(F.lit(value), kind)] * len(mine)
        cols = apply_columns(op, scalar, mine) if swapped else apply_columns(op, mine, scalar)
    else:
        return NotImplemented
    return self._derived(df, cols, weight, rows=self._rows)


def logical(self: Frame, op: str, other: Frame) -> Frame:
    """Elementwise on tables of true and false (or 1 and 0)."""
    for f in (self, other):
        if not all(map(S.is_numeric, f._types)) or not f._df.filter(f._any([~F.col(c).cast("double").isin(0.0, 1.0) for c in f._cols])).isEmpty():
            raise ImproperObjectAction("logic needs true and false, or 1 and 0")
    df, a, b = _beside(self, other)
    cols = [LOGICAL[op](x.cast("boolean"), y.cast("boolean")) for x, y in zip(a, b, strict=True)]
    return self._with(df.select(*self._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), rows=self._rows)


def _invert(self: Frame) -> Frame:
    return self._with(self._df.select(*self._keys, *[(~F.col(c).cast("boolean")).alias(c) for c in self._cols]), rows=self._rows)


def _unary(f):
    def verb(self: Frame) -> Frame:
        _numeric_only(self)
        df, cols, weight = self._rooted()
        return self._derived(df, [f(c) for c in cols], weight, rows=self._rows)

    return verb


def install_operators() -> None:
    for op in OPERATIONS:
        setattr(Frame, f"__{op}__", lambda self, other, op=op: binary(self, op, other))
        setattr(Frame, f"__r{op}__", lambda self, other, op=op: binary(self, op, other, True))

        def inplace(self, other, op=op):
            got = binary(self, op, other)
            if got is NotImplemented:
                return got
            self._rebind(got)
            return self

        setattr(Frame, f"__i{op}__", inplace)
    for op in LOGICAL:
        setattr(Frame, f"__{op}__", lambda self, other, op=op: logical(self, op, other))
    Frame.__invert__ = _invert
    Frame.__pos__ = lambda self: self.copy()
    Frame.__neg__ = _unary(lambda c: -c)
    Frame.__abs__ = _unary(F.abs)
    Frame.__matmul__ = matrixMultiply
    Frame.__rmatmul__ = lambda self, other: matrixMultiply(other, self)

    def imatmul(self, other):
        self._rebind(matrixMultiply(self, other))
        return self

    Frame.__imatmul__ = imatmul
    Frame.T = property(_t)
    Frame.__str__ = lambda self: toString(self)
    Frame.__repr__ = lambda self: f"<Frame {self.name or ''} {self.shape[0]}pt x {self.shape[1]}ft>\n{toString(self)}"
    from loomframe.operators.stretch import Stretch

    Frame.stretch = property(Stretch)


def matrixMultiply(self: Frame, other: Frame) -> Frame:
    """Product with a table: its points, one for each feature here, are bounded by this table's columns, so they become constants of the plan."""
    n, p = self.shape[1], other.shape[1]
    if other.shape[0] != n:
        raise InvalidArgumentValue(f"shapes do not fit: {self.shape} and {other.shape}")
    _numeric_only(self)
    _numeric_only(other)
    m = np.array(other._rows_list(), float).reshape(n, p)
    whole = _whole(*self._types, *other._types)
    cols = []
    for j in range(p):
        total = F.lit(0.0)
        for i in range(n):
            if m[i, j]:
                total = total + F.col(f"f{i}") * F.lit(float(m[i, j]))
        cols.append(total.cast("long") if whole else total)
    return self._with(self._df.select(*self._keys, *[c.alias(f"f{j}") for j, c in enumerate(cols)]), other._names, rows=self._rows)


def matrixPower(self: Frame, power: int) -> Frame:
    n, p = self.shape
    if n != p:
        raise InvalidArgumentValue("only a square table has powers")
    from loomframe.sources.memory import data

    return data(np.linalg.matrix_power(C._dense(self), power).tolist(), pointNames=None, featureNames=self._names)


def inverse(self: Frame, pseudoInverse: bool = False) -> Frame:
    return C.pseudoInverse(self) if pseudoInverse else C.inverse(self)


def solveLinearSystem(self: Frame, b: Frame, solveFunction: str = "solve") -> Frame:
    if solveFunction not in ("solve", "least squares"):
        raise InvalidArgumentValue("solveFunction is 'solve' or 'least squares'")
    return C.solve(self, b) if solveFunction == "solve" else C.leastSquaresSolution(self, b)


def _residuals(self: Frame, toPredict: Frame) -> Frame:
    """What a linear regression with intercept on this table's features leaves of each feature of another."""
    g, r = C.gram(self, toPredict, intercept=True)
    beta = np.linalg.lstsq(g, r.reshape(len(g), -1), rcond=None)[0]
    df, x, y = _beside(self, toPredict)
    out = []
    for k, c in enumerate(y):
        fit = F.lit(float(beta[0, k]))
        for i, v in enumerate(x):
            fit = fit + v * F.lit(float(beta[i + 1, k]))
        out.append(c - fit)
    got = toPredict._with(df.select(PID, *[c.alias(f"f{k}") for k, c in enumerate(out)]), rows=self._rows)
    got._root = (df, out, len(y) * (len(x) + 1))
    return got


# -- display and sinks -----------------------------------------------------------------------------------------------------------


def toString(self: Frame, points=None, features=None, lineLimit: int = 30, lineWidthLimit: int = 79, sigDigits: int = 3, columnWidthLimit: int = 19, includePointNames: bool = True, includeFeatureNames: bool = True, indent: str = "", quoteNames: bool = False) -> str:
    """A text table of the first and last points; only those are collected."""
    f = self if features is None else self._select(self._feature_indices(features))
    if points is not None:
        f = f._pick(f._point_ids(points))
    n = f._count()
    keep = max(1, lineLimit - 2) if n > lineLimit else n
    order = [PNAME] if f._named and includePointNames else []
    head = f._df.orderBy(PID).limit(-(-keep // 2) if n > keep else n).select(*order, *f._cols).collect()
    tail = f._df.orderBy(F.desc(PID)).limit(keep // 2).select(*order, *f._cols).collect()[::-1] if n > keep else []

    def show(v) -> str:
        text = "" if v is None else f"{v:.{sigDigits}f}" if isinstance(v, float) else str(v)
        return text if len(text) <= columnWidthLimit else text[: columnWidthLimit - 3] + "..."

    names = ([""] if order else []) + [show(x) for x in f._names]
    rows = ([names] if includeFeatureNames else []) + [[show(v) for v in r] for r in head] + ([["..."] * len(names)] if tail else []) + [[show(v) for v in r] for r in tail]
    if not rows:
        return f"{indent}(empty)"
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = [indent + " ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in rows]
    return "\n".join(x if len(x) <= lineWidthLimit else x[: lineWidthLimit - 3] + "..." for x in lines)


def show(self: Frame, description: str | None = None, points=None, features=None, lineLimit="automatic", lineWidthLimit="automatic", sigDigits: int = 3, columnWidthLimit="automatic", includePointNames: bool = True, includeFeatureNames: bool = True, includeObjectName: bool = True) -> None:
    if description:
        print(description)
    if includeObjectName and self.name:
        print(f"{self.name}: ", end="")
    print("{}pt x {}ft".format(*self.shape))
    print(self.toString(points, features, 30 if lineLimit == "automatic" else lineLimit, 79 if lineWidthLimit == "automatic" else lineWidthLimit, sigDigits, 19 if columnWidthLimit == "automatic" else columnWidthLimit, includePointNames, includeFeatureNames))


def save(self: Frame, outPath: str, fileFormat: str | None = None, includeNames: bool = True) -> None:
    from loomframe.sources import files

    files.save(self, outPath, fileFormat, includeNames)
