"""Frame: a labelled, ordered table as a plan over a Spark DataFrame.

The plan has the columns `__pid` (order of the points), `__pname` if points have names, and f0, f1, ... for the
features, whose names stand beside it. A missing value is NULL; NaN becomes NULL where data comes in. Verbs build
plans and rebind the frame; only results that are Python values are collected. `__pid` is unique and ordered,
dense only when a verb needs positions: then rows are ranked within ranges of the order, never in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import ImproperObjectAction, InvalidArgumentType, InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions import match as M
from loomframe.functions import statistics as S
from loomframe.plans.quantiles import exact_quantiles

PID, PNAME = "__pid", "__pname"
#: Rows that one task ranks.
RANK_ROWS = 500_000
#: Columns that expressions over a root may name; sums of sums would double them without end.
ROOT_MOST = 2_000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Vector(Sequence):
    """A point (or feature) as Python functions see it: by place or by name."""

    def __init__(self, values, names, name=None):
        self._values, self._names, self.name = list(values), names, name

    def __getitem__(self, key):
        if isinstance(key, str):
            return self._values[self._names.index(key)]
        return self._values[key]

    def __len__(self):
        return len(self._values)


def ranked(df: DataFrame, order: list[Column], out: str, rows: int, reverse: bool = False) -> DataFrame:
    """df with `out`, the place of each row in the order (least first; greatest first where reversed), from 0. The order must have no ties."""
    key = F.struct(*order) if len(order) > 1 else order[0]
    by = [F.desc_nulls_last(F.col("__key")) if reverse else F.col("__key")]
    keyed = df.withColumn("__key", key)
    parts = -(-rows // RANK_ROWS)
    if parts <= 1:
        return keyed.withColumn(out, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)) - 1).cast("long")).drop("__key")
    # ranges of the order between sampled keys; their sizes give each range its first place
    edges = keyed.select("__key").sample(min(1.0, 40.0 * parts / rows), seed=3).orderBy("__key").collect()
    edges = edges[:: max(1, len(edges) // parts)][1:]
    cuts = session().createDataFrame([(i + 1, e["__key"]) for i, e in enumerate(edges)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("k", keyed.schema["__key"].dataType)]))
    ends = cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda s: s["k"]).alias("__ends"))  # one row of a bounded array
    keyed = keyed.crossJoin(F.broadcast(ends)).withColumn("__range", _bisected(F.col("__ends"), F.col("__key"), len(edges))).drop("__ends")
    counts = dict(map(tuple, keyed.groupBy("__range").count().collect()))
    first, total = [], 0
    for r in sorted(counts, reverse=reverse):
        first.append((r, total))
        total += counts[r]
    placed = keyed.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1)
    starts = session().createDataFrame(first, "__range int, __start long")  # one row of two numbers for each task
    return placed.join(F.broadcast(starts), "__range").withColumn(out, F.col("__in") + F.col("__start")).drop("__key", "__range", "__in", "__start")


def _bisected(cuts: Column, key: Column, n: int) -> Column:
    """How many of n sorted cuts are not above the key (none, for a missing key), in the logarithm of n comparisons."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= n) & (F.get(cuts, low + s - 1) <= key), low + s).otherwise(low))


def no_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    floats = [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


class Frame:
    def __init__(self, df: DataFrame, names: list[str | None], dense: bool = False, name: str | None = None, path: str | None = None, rows: int | None = None, dims: list[int] | None = None, read_only: bool = False):
        self._df, self._names, self._dense, self.name, self.absolutePath = df, list(names), dense, name, path
        self._rows, self._dims, self._read_only = rows, dims, read_only
        self._source: DataFrame | None = None
        self._root: tuple[DataFrame, list[Column], int] | None = None
        known = [n for n in names if n is not None]
        if len(set(known)) != len(known):
            raise InvalidArgumentValue("feature names must be unique")

    # -- making ---------------------------------------------------------------------------------------------------

    @classmethod
    def from_spark(cls, df: DataFrame, order: list[str] | None = None, pointNames: str | None = None, name: str | None = None, path: str | None = None) -> Frame:
        """A frame over all columns of df (but the one with point names), in the order of the columns given or of the scan."""
        features = [c for c in df.columns if c != pointNames]
        q = lambda c: F.col("`" + c.replace("`", "``") + "`")
        cols = [q(c).alias(f"f{i}") for i, c in enumerate(features)]
        names = [q(pointNames).cast("string").alias(PNAME)] if pointNames else []
        out = cls._over(df.select(*names, *cols), features, name, path)
        if order:
            out.points.sort(order)
        return out

    @classmethod
    def _over(cls, source: DataFrame, names: list[str | None], name: str | None = None, path: str | None = None) -> Frame:
        """A frame over a source with physical columns. The source stays known until a verb changes the frame, so that
        queries filter it before ids are given, which no filter passes."""
        plan = source.select(F.monotonically_increasing_id().alias(PID), *source.columns)
        out = cls(no_nan(plan, [c for c in source.columns if c != PNAME]), names, name=name, path=path)
        out._source = source
        return out

    def to_spark(self, pid: bool = False) -> DataFrame:
        """The features as a DataFrame by their names (unnamed: _c and their place); point names as column `pointNames`."""
        names = [PID] if pid else []
        return self._df.select(*names, *([F.col(PNAME).alias("pointNames")] if self._named else []), *[F.col(f"f{i}").alias(n if n is not None else f"_c{i}") for i, n in enumerate(self._names)])

    def _with(self, df: DataFrame, names=None, dense=None, rows=None, **more) -> Frame:
        out = Frame(df, self._names if names is None else names, self._dense if dense is None else dense, more.get("name", self.name), self.absolutePath, rows)
        if df is self._df:
            out._root = self._root
        return out

    def _rebind(self, other: Frame) -> None:
        if self._read_only:
            raise ImproperObjectAction("a view cannot be changed")
        self._df, self._names, self._dense, self._rows = other._df, other._names, other._dense, other._rows
        self._dims, self._source, self._root = None, other._source, other._root

    @property
    def _named(self) -> bool:
        return PNAME in self._df.columns

    @property
    def _keys(self) -> list[str]:
        return [PID, PNAME] if self._named else [PID]

    @property
    def _cols(self) -> list[str]:
        return [f"f{i}" for i in range(len(self._names))]

    @property
    def _types(self) -> list[T.DataType]:
        return [self._df.schema[c].dataType for c in self._cols]

    def _count(self) -> int:
        if self._rows is None:
            self._rows = self._df.count()
        return self._rows

    def _rooted(self) -> tuple[DataFrame, list[Column], int]:
        """A plan that this one only computes columns of, the columns, and how many of the plan's they name: tables of one root are side by side without a join."""
        return self._root or (self._df, [F.col(c) for c in self._cols], len(self._names))

    def _derived(self, df: DataFrame, cols: list[Column], weight: int, names=None, rows=None) -> Frame:
        """The frame of columns over a root of this frame."""
        out = self._with(df.select(*self._keys, *[c.alias(f"f{k}") for k, c in enumerate(cols)]), names, rows=rows)
        if weight <= ROOT_MOST:
            out._root = (df, cols, weight)
        return out

    def _densify(self) -> Frame:
        """Gives points their places as ids; once, if nothing moves them."""
        if not self._dense:
            n = self._count()
            self._df = ranked(self._df.withColumnRenamed(PID, "__old"), [F.col("__old")], PID, n).drop("__old").select(*self._keys_of(PNAME in self._df.columns), *self._cols)
            self._dense, self._source, self._root = True, None, None
        return self

    @staticmethod
    def _keys_of(named: bool) -> list[str]:
        return [PID, PNAME] if named else [PID]

    def _only2d(self) -> None:
        if self._dims and len(self._dims) > 2:
            raise ImproperObjectAction("only for tables of two dimensions")

    # -- facts ----------------------------------------------------------------------------------------------------

    @property
    def points(self):
        from loomframe.operators.points import Points

        return Points(self)

    @property
    def features(self):
        from loomframe.operators.features import Features

        return Features(self)

    @property
    def shape(self) -> tuple[int, int]:
        return self._count(), len(self._names)

    @property
    def dimensions(self) -> tuple[int, ...]:
        return tuple(self._dims) if self._dims else self.shape

    @property
    def path(self) -> str | None:
        return self.absolutePath

    @property
    def relativePath(self) -> str | None:
        import os

        return os.path.relpath(self.absolutePath) if self.absolutePath else None

    def getTypeString(self) -> str:
        return "Frame"

    def __len__(self) -> int:
        n, p = self.shape
        if 1 not in (n, p) and n and p:
            raise ImproperObjectAction("only a table of one point or one feature has a length")
        return n * p

    def __bool__(self) -> bool:
        return bool(self._names) and not self._df.isEmpty()

    def __iter__(self) -> Iterator:
        len(self)
        return iter(self._cells())

    def _is_column(self) -> bool:
        return len(self._names) == 1

    def _ordered(self) -> DataFrame:
        return self._df.orderBy(PID)

    def _rows_list(self) -> list[list]:
        return [list(r) for r in self._ordered().select(*self._cols).collect()]

    def _cells(self) -> list:
        return [v for r in self._rows_list() for v in r]

    def iterateElements(self, order: str = "point", only=None) -> Iterator:
        """Elements point by point, or feature by feature; `only` is a matcher."""
        keep = M.value_match(only) if only is not None else lambda v: True
        if order == "point":
            return (v for r in self._ordered().select(*self._cols).toLocalIterator() for v in r if keep(v))
        return (r[0] for c in self._cols for r in self._ordered().select(c).toLocalIterator() if keep(r[0]))

    def containsZero(self) -> bool:
        return self._quantified(M.zero, False)

    def _quantified(self, match, every: bool) -> bool:
        flags = self._match_columns(match)
        if not flags:
            return every
        hit = self._df.select(*flags).filter(~self._all(list(flags)) if every else self._any(list(flags)))
        return hit.isEmpty() if every else not hit.isEmpty()

    @staticmethod
    def _any(cols: list[Column]) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | c
        return out

    @staticmethod
    def _all(cols: list[Column]) -> Column:
        out = F.lit(True)
        for c in cols:
            out = out & c
        return out

    def _match_columns(self, match, features: list[int] | None = None) -> list[Column]:
        """For each feature, the Column that holds where its values match; a Python function becomes an Arrow function."""
        out = []
        for i in range(len(self._names)) if features is None else features:
            c, t = F.col(f"f{i}"), self._types[i]
            col = M.column_match(match, c, t)
            out.append(col if col is not None else self._value_udf(lambda v, m=match: bool(m(v)), T.BooleanType(), c))
        return out

    @staticmethod
    def _value_udf(f: Callable, kind: T.DataType, *cols: Column) -> Column:
        made = {T.StringType: str, T.LongType: int, T.DoubleType: float}.get(type(kind), lambda v: v)  # results of several types become the one that holds all

        def run(*series):
            import pandas as pd

            none = lambda v: None if v is None or v != v or v is pd.NaT else v.item() if hasattr(v, "item") else v
            got = (f(*(none(v) for v in row)) for row in zip(*series, strict=True))
            return pd.Series([None if v is None else made(v) for v in got], dtype=object)

        return F.pandas_udf(run, kind)(*cols)

    # -- identifiers ----------------------------------------------------------------------------------------------

    def _feature_index(self, key) -> int:
        if isinstance(key, str):
            if key not in self._names:
                import difflib

                near = difflib.get_close_matches(key, [n for n in self._names if n is not None], 3)
                raise KeyError(f"no feature {key!r}" + (f"; did you mean {near}?" if near else ""))
            return self._names.index(key)
        if isinstance(key, float) and key.is_integer():
            key = int(key)
        if not isinstance(key, (int, np.integer)) or isinstance(key, bool):
            raise InvalidArgumentType(f"not a feature: {key!r}")
        n = len(self._names)
        if not -n <= key < n:
            raise IndexError(f"there are {n} features, none at {key}")
        return int(key) % n

    def _feature_indices(self, keys) -> list[int]:
        """Of a key, a list, an inclusive slice, or a mask."""
        if keys is None:
            return list(range(len(self._names)))
        if isinstance(keys, slice):
            a = self._feature_index(keys.start) if keys.start is not None else 0
            b = self._feature_index(keys.stop) if keys.stop is not None else len(self._names) - 1
            return list(range(a, b + 1, keys.step or 1))
        if isinstance(keys, (str, int, float, np.integer)):
            return [self._feature_index(keys)]
        keys = list(keys)
        if keys and all(isinstance(k, (bool, np.bool_)) for k in keys):
            if len(keys) != len(self._names):
                raise KeyError("a mask must have one value for each feature")
            return [i for i, k in enumerate(keys) if k]
        out = [self._feature_index(k) for k in keys]
        if len(set(out)) != len(out):
            raise InvalidArgumentValue("a feature is named twice")
        return out

    def _select(self, indices: list[int]) -> Frame:
        df, cols, weight = self._rooted()
        out = self._derived(df, [cols[i] for i in indices], weight, [self._names[i] for i in indices], self._rows)
        if self._source is not None:
            names = [PNAME] if PNAME in self._source.columns else []
            out._source = self._source.select(*names, *[F.col(f"f{i}").alias(f"f{k}") for k, i in enumerate(indices)])
        return out

    def _point_ids(self, keys) -> list[int]:
        """Places of points given by name or place; names take one query."""
        keys = [keys] if isinstance(keys, (str, int, float, np.integer)) else list(keys)
        if keys and all(isinstance(k, (bool, np.bool_)) for k in keys):
            if len(keys) != self._count():
                raise KeyError("a mask must have one value for each point")
            self._densify()
            return [i for i, k in enumerate(keys) if k]
        self._densify()
        names = {k for k in keys if isinstance(k, str)}
        found = {r[PNAME]: r[PID] for r in self._df.filter(F.col(PNAME).isin(*names)).select(PNAME, PID).collect()} if names and self._named else {}
        n, out = self._count(), []
        for k in keys:
            if isinstance(k, str):
                if k not in found:
                    raise KeyError(f"no point {k!r}")
                out.append(found[k])
            else:
                if float(k) != int(k) or not -n <= k < n:
                    raise IndexError(f"there are {n} points, none at {k}")
                out.append(int(k) % n)
        if len(set(out)) != len(out):
            raise InvalidArgumentValue("a point is named twice")
        return out

    def _pick(self, ids: list[int]) -> Frame:
        """Points by place, in the order asked for."""
        self._densify()
        order = session().createDataFrame([(i, k) for k, i in enumerate(ids)], f"{PID} long, __new long") if ids else None
        if order is None:
            return self._with(self._df.limit(0), dense=True, rows=0)
        df = self._df.join(F.broadcast(order), PID) if len(ids) < 100_000 else self._df.join(order, PID)
        return self._with(df.drop(PID).withColumnRenamed("__new", PID).select(*self._keys, *self._cols), dense=True, rows=len(ids))

    def __getitem__(self, key):
        """Part of the table; slices include both ends; one point and one feature give a value."""
        self._only2d()
        if not isinstance(key, tuple):
            n, p = self.shape
            if n == 1:
                key = (0, key)
            elif p == 1:
                key = (key, 0)
            else:
                key = (key, slice(None))
        x, y = key
        single = isinstance(x, (str, int, float, np.integer)) and isinstance(y, (str, int, float, np.integer))
        part = self._select(self._feature_indices(None if y is Ellipsis or isinstance(y, slice) and y == slice(None) else y))
        if not (x is Ellipsis or isinstance(x, slice) and x == slice(None)):
            if isinstance(x, slice):
                a, b = x.start, x.stop
                part._densify()
                low = part._point_ids(a)[0] if a is not None else 0
                high = part._point_ids(b)[0] if b is not None else part._count() - 1
                keep = F.col(PID).between(low, high)
                if (x.step or 1) != 1:
                    keep = keep & ((F.col(PID) - low) % x.step == 0)
                part = part._with(part._df.filter(keep), dense=False)
            else:
                part = part._pick(part._point_ids(x))
        return part._cells()[0] if single else part

    def __setitem__(self, key, value) -> None:
        x, y = key if isinstance(key, tuple) else (key, slice(None))
        ids, cols = (self._point_ids(x) if not isinstance(x, slice) else None), self._feature_indices(None if isinstance(y, slice) and y == slice(None) else y)
        self._densify()
        hit = F.lit(True) if ids is None else F.col(PID).isin(*ids)
        self._rebind(self._with(self._df.withColumns({f"f{i}": F.when(hit, F.lit(value)).otherwise(F.col(f"f{i}")) for i in cols}), rows=self._rows))

    def pointView(self, identifier) -> Frame:
        out = self._pick(self._point_ids(identifier))
        out._read_only = True
        return out

    def featureView(self, identifier) -> Frame:
        out = self._select([self._feature_index(identifier)])
        out._read_only = True
        return out

    def view(self, pointStart=None, pointEnd=None, featureStart=None, featureEnd=None) -> Frame:
        out = self[slice(pointStart, pointEnd), slice(featureStart, featureEnd)]
        out._read_only = True
        return out

    # -- copies and comparison ------------------------------------------------------------------------------------

    def copy(self, to: str | None = None, rowsArePoints: bool = True, outputAs1D: bool = False):
        """Another frame on the same plan, or the data as python list, numpy array, pandas frame, list of dict, dict of list, or Spark frame."""
        kind = (to or "frame").lower().replace(" ", "")
        if kind in ("frame", "list", "matrix", "sparse", "dataframe"):
            out = self._with(self._df, rows=self._rows)
            out._dims = self._dims
            return out if rowsArePoints else out.T
        if kind == "spark":
            return self.to_spark()
        rows = self._rows_list()
        if not rowsArePoints:
            rows = [list(c) for c in zip(*rows, strict=True)]
        if outputAs1D:
            rows = [v for r in rows for v in r]
        names = [n if n is not None else f"_c{i}" for i, n in enumerate(self._names)]
        if kind in ("pythonlist",):
            return rows
        if kind in ("numpyarray", "numpymatrix"):
            return np.array(rows)
        if kind in ("pandasdataframe",):
            import pandas as pd

            return pd.DataFrame(rows, columns=names if rowsArePoints else None)
        if kind == "listofdict":
            return [dict(zip(names, r, strict=True)) for r in rows]
        if kind == "dictoflist":
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}
        raise InvalidArgumentValue(f"cannot copy to {to!r}")

    __copy__ = copy

    def __deepcopy__(self, memo):
        return self.copy()

    def isIdentical(self, other) -> bool:
        """Same shape, names and values, missing equal to missing."""
        if not isinstance(other, Frame) or self._names != other._names or self.shape != other.shape:
            return False
        if self._named != other._named or [S.is_numeric(t) for t in self._types] != [S.is_numeric(t) for t in other._types]:
            return False
        a, b = self._densify()._df, other._densify()._df
        kind = lambda f: [F.col(k) for k in self._keys] + [F.col(c).cast("double") if S.is_numeric(t) else F.col(c) for c, t in zip(f._cols, f._types, strict=True)]
        a, b = a.select(*kind(self)), b.select(*kind(other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __eq__(self, other) -> bool:
        return self.isIdentical(other)

    def __ne__(self, other) -> bool:
        return not self.isIdentical(other)

    __hash__ = None

    def hashCode(self) -> int:
        """A whole number from 0 and below 10**9 that frames of equal content share."""
        return round(1_000_000_000 * self._fingerprint()) % 1_000_000_000

    def _fingerprint(self) -> float:
        """The mean over cells of the value times a wave of its place; sums in other orders differ beyond the digits kept."""
        self._densify()
        n, p = self.shape
        if not n or not p:
            return 0
        cells = [F.coalesce(((F.sin(F.col(PID).cast("double")) + math.cos(i)) / 2 * (F.col(c).cast("double") if S.is_numeric(t) else F.crc32(F.col(c).cast("string").cast("binary")) / 1e9)), F.lit(0.0)) for i, (c, t) in enumerate(zip(self._cols, self._types, strict=True))]
        total = F.lit(0.0)
        for c in cells:
            total = total + c
        return round(self._df.agg(F.sum(total)).first()[0] / (n * p), 6)

    def isApproximatelyEqual(self, other) -> bool:
        return self.shape == other.shape and abs(self._fingerprint() - other._fingerprint()) < 1e-4

    def checkInvariants(self, level: int = 2) -> None:
        assert set(self._df.columns) >= {PID, *self._cols} and len(set(self._names) - {None}) == len([n for n in self._names if n is not None])
        if level > 1:
            r = self._df.agg(F.count("*"), F.count_distinct(PID)).first()
            assert r[0] == r[1]

    # -- elements -------------------------------------------------------------------------------------------------

    def _limits(self, points, features) -> tuple[Column, list[int]]:
        hit = F.lit(True)
        if points is not None:
            ids = self._point_ids(points)
            hit = F.col(PID).isin(*ids)
        return hit, self._feature_indices(features)

    def _element_columns(self, function, cols: list[int], preserveZeros: bool, skipNone: bool) -> dict[str, Column]:
        out = {}
        for i in cols:
            c, t = F.col(f"f{i}"), self._types[i]
            if isinstance(function, dict):
                keys = {k: v for k, v in function.items() if v is not None or not skipNone}
                fit = {k: v for k, v in keys.items() if isinstance(k, str) == isinstance(t, T.StringType)}
                new = c
                kinds = {type(v) for v in fit.values() if v is not None}
                text = str in kinds and not isinstance(t, T.StringType)
                for k, v in fit.items():
                    new = F.when(M.equal(c, t, k), F.lit(v)).otherwise(new.cast("string") if text else new)
            elif function in (abs,) and S.is_numeric(t):
                new = F.abs(c)
            elif isinstance(function, type) and function in (int, float, str, bool):
                new = c.cast({int: "long", float: "double", str: "string", bool: "boolean"}[function])
            else:
                kind = self._result_type(function, i)
                new = self._value_udf(function, kind, c)
                if skipNone:
                    new = F.coalesce(new, c.cast(kind))
            if preserveZeros and S.is_numeric(t):
                new = F.when(c == 0, c).otherwise(new)
            out[f"f{i}"] = new
        return out

    def _result_type(self, function, i: int) -> T.DataType:
        """The type that holds all of a function's results on a feature's values."""
        values = self._df.filter(F.col(f"f{i}").isNotNull())
        return self._kind_of(values, function, F.col(f"f{i}"))

    @staticmethod
    def _kind_of(df: DataFrame, function: Callable, *cols: Column) -> T.DataType:
        """The type that holds all results of a function of columns, each of which is looked at: no sample can miss one."""
        kinds = {bool: "boolean", int: "bigint", float: "double"}

        def kind(*values):
            got = function(*values)
            got = got.item() if hasattr(got, "item") else got
            return None if got is None or got != got else kinds.get(type(got), "string")

        found = {r[0] for r in df.select(Frame._value_udf(kind, T.StringType(), *cols).alias("kind")).distinct().collect()} - {None}
        if found <= {"boolean"}:
            return T.BooleanType() if found else T.DoubleType()
        if found <= {"bigint", "boolean"}:
            return T.LongType()
        return T.DoubleType() if "string" not in found else T.StringType()

    def transformElements(self, toTransform, points=None, features=None, preserveZeros: bool = False, skipNoneReturnValues: bool = False) -> None:
        """Replaces elements by a function of them or by a dictionary."""
        hit, cols = self._limits(points, features)
        new = self._element_columns(toTransform, cols, preserveZeros, skipNoneReturnValues)
        if points is not None:
            new = {c: F.when(hit, n).otherwise(F.col(c)) for c, n in new.items()}
        self._rebind(self._with(self._df.withColumns(new), rows=self._rows))

    def calculateOnElements(self, toCalculate, points=None, features=None, preserveZeros: bool = False, skipNoneReturnValues: bool = False, outputType=None) -> Frame:
        hit, cols = self._limits(points, features)
        new = self._element_columns(toCalculate, cols, preserveZeros, skipNoneReturnValues)
        return self._with(self._df.filter(hit).withColumns(new), dense=False)._select(cols)

    def matchingElements(self, toMatch, points=None, features=None) -> Frame:
        """True where elements match; never missing."""
        hit, cols = self._limits(points, features)
        flags = self._match_columns(toMatch, cols)
        df = self._df.filter(hit).select(*self._keys, *[m.alias(f"f{k}") for k, m in enumerate(flags)])
        return self._with(df, [self._names[i] for i in cols], dense=points is None and self._dense)

    def countElements(self, condition) -> int:
        flags = self._match_columns(condition)
        if not flags:
            return 0
        total = F.lit(0)
        for m in flags:
            total = total + F.count_if(m)
        return self._df.agg(total).first()[0]

    def _long(self, cols: list[int], more: list[Column] = ()) -> DataFrame:
        """One row for each cell: feature and value, of the type that all share (text where they share none)."""
        types = [self._types[i] for i in cols]
        kind = "double" if all(map(S.is_numeric, types)) else "string"
        cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"f{i}").cast(kind).alias("value")) for i in cols])
        return self._df.select(PID, *more, F.explode(cells).alias("cell")).select(PID, *more, "cell.feature", "cell.value")

    def countUniqueElements(self, points=None, features=None) -> dict:
        hit, cols = self._limits(points, features)
        part = self._with(self._df.filter(hit))
        return {r["value"]: r["count"] for r in part._long(cols).groupBy("value").count().collect()}

    # -- groups ---------------------------------------------------------------------------------------------------

    def _group_key(self, v, has_nan_text: bool):
        if v is None:
            return "numpy.nan" if has_nan_text else "NaN"
        return int(v) if isinstance(v, float) and v.is_integer() else v

    def groupByFeature(self, by, calculate=None, countUniqueValueOnly: bool = False) -> dict:
        """Groups by one or more features: a dictionary of tables, of tables of one statistic, or of counts, in order of first appearance."""
        keys = self._feature_indices(by)
        names = [f"f{i}" for i in keys]
        seen = self._df.groupBy(*names).agg(F.min(PID).alias("__first"), F.count("*").alias("__n")).orderBy("__first").collect()
        text = [any(r[c] == "NaN" for r in seen) for c in names]
        single = not isinstance(by, (list, tuple))
        label = lambda r: self._group_key(r[names[0]], text[0]) if single else tuple(self._group_key(r[c], t) for c, t in zip(names, text, strict=True))
        if countUniqueValueOnly:
            return {label(r): r["__n"] for r in seen}
        rest = [i for i in range(len(self._names)) if i not in keys]
        if calculate is None:
            out = {}
            for r in seen:
                same = self._all([F.col(c).eqNullSafe(F.lit(r[c])) for c in names])
                out[label(r)] = self._with(self._df.filter(same), dense=False)._select(rest)
            return out
        stats = [calculate] if isinstance(calculate, str) or callable(calculate) else list(calculate)
        table = {tuple(r[c] for c in names): r for r in self.group_statistics(names, stats[0]).collect()}
        made = {}
        for r in seen:
            values = table[tuple(r[c] for c in names)]
            cells = [values[f"f{i}"] for i in rest]
            df = session().createDataFrame([(0, *cells)], T.StructType([T.StructField(PID, T.LongType()), *[T.StructField(f"f{k}", table_type) for k, table_type in enumerate(_types_of(cells))]]))
            made[label(r)] = self._with(df, [self._names[i] for i in rest], dense=True, rows=1)
        return made

    def group_statistics(self, keys: list[str], statistic) -> DataFrame:
        """The plan of a statistic of every other feature by group, with the key columns: one aggregation, two for statistics of two passes."""
        key = S.canonical(statistic)
        rest = [c for c in self._cols if c not in keys]
        types = dict(zip(self._cols, self._types, strict=True))
        if key == "medianabsolutedeviation":
            mid = self._df.groupBy(*keys).agg(*[F.median(F.col(c).cast("double")).alias(f"m_{c}") for c in rest if S.is_numeric(types[c])])
            mid = mid.withColumnsRenamed({k: f"__{k}" for k in keys})
            joined = self._df.join(mid, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            return joined.groupBy(*keys).agg(*[F.median(F.abs(F.col(c).cast("double") - F.col(f"m_{c}"))).alias(c) if S.is_numeric(types[c]) else F.lit(float("nan")).alias(c) for c in rest])
        if key == "mode":
            out = None
            for c in rest:
                one = mode_plan(self._df, keys, c, types[c])
                same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
                out = one if out is None else out.join(one.withColumnsRenamed({k: f"__{k}" for k in keys}), same).drop(*[f"__{k}" for k in keys])
            return out
        return self._df.groupBy(*keys).agg(*[S.AGGREGATES[key](F.col(c), types[c]).alias(c) for c in rest])

    def feature_statistics(self, statistic) -> DataFrame:
        """The plan of one row with a statistic of every feature."""
        key = S.canonical(statistic)
        if key == "mode":
            out = None
            for c, t in zip(self._cols, self._types, strict=True):
                one = mode_plan(self._df, [], c, t)
                out = one if out is None else out.crossJoin(one)  # one row each
            return out
        if key == "medianabsolutedeviation":
            mid = self._quantiles([0.5])
            numbers = [i for i, t in enumerate(self._types) if S.is_numeric(t)]
            gaps = [F.abs(F.col(f"f{i}").cast("double") - F.lit(mid[i][0])) for i in numbers]
            far = dict(zip(numbers, exact_quantiles(self._df, gaps, [0.5]), strict=True))
            return session().range(1).select(*[F.lit(far[i][0] if i in far else float("nan")).cast("double").alias(c) for i, c in enumerate(self._cols)])
        if key in ("median", "quartiles"):
            rows = self._quantiles([0.5] if key == "median" else [0.25, 0.5, 0.75])
            cell = lambda v: F.lit(v).cast("double")
            return session().range(1).select(*[(cell(r[0]) if key == "median" else F.array(*map(cell, r)) if r[0] is not None else F.lit(None).cast("array<double>")).alias(c) for c, r in zip(self._cols, rows, strict=True)])
        return self._df.agg(*[S.AGGREGATES[key](F.col(c), t).alias(c) for c, t in zip(self._cols, self._types, strict=True)])

    def _quantiles(self, wanted: list[float]) -> list[list[float | None]]:
        """Quantiles of every feature, NaN of those that are not numbers; no task holds a feature's values."""
        numbers = [i for i, t in enumerate(self._types) if S.is_numeric(t)]
        got = dict(zip(numbers, exact_quantiles(self._df, [S._num(F.col(f"f{i}"), self._types[i]) for i in numbers], wanted), strict=True))
        return [got.get(i, [float("nan")] * len(wanted)) for i in range(len(self._names))]

    def _scalar(self, statistic):
        return self.feature_statistics(statistic).first()[0]

    # -- statistics of the whole object --------------------------------------------------------------------------

    def _whole(self, statistic):
        if not all(map(S.is_numeric, self._types)):
            return float("nan")
        key = S.canonical(statistic)
        cells = self._long(list(range(len(self._names))))
        if key == "medianabsolutedeviation":
            mid = exact_quantiles(cells, [F.col("value")], [0.5])[0][0]
            return exact_quantiles(cells, [F.abs(F.col("value") - F.lit(mid))], [0.5])[0][0]
        if key in ("median", "quartiles"):
            got = exact_quantiles(cells, [F.col("value")], [0.5] if key == "median" else [0.25, 0.5, 0.75])[0]
            return got[0] if key == "median" or got[0] is None else got
        out = cells.agg(S.AGGREGATES[key](F.col("value"), T.DoubleType())).first()[0]
        return out

    def max(self):
        return self._whole("max")

    def mean(self):
        return self._whole("mean")

    def median(self):
        return self._whole("median")

    def min(self):
        return self._whole("min")

    def uniqueCount(self):
        return self._whole("unique count")

    def sum(self):
        return self._whole("sum")

    def variance(self):
        return self._whole("variance")

    def medianAbsoluteDeviation(self):
        return self._whole("median absolute deviation")

    def quartiles(self):
        return self._whole("quartiles")

    def mode(self):
        cells = self._long(list(range(len(self._names))))
        return mode_plan(cells, [], "value", cells.schema["value"].dataType).first()[0]

    def proportionMissing(self):
        row = self.feature_statistics("proportion missing").first()
        return round(sum(row) / len(row), 3)

    def proportionZero(self):
        row = self.feature_statistics("proportion zero").first()
        return round(sum(row) / len(row), 3)

    def report(self) -> Frame:
        """One point: values, points, features, and the mean proportions of zero and of missing values."""
        n, p = self.shape
        from loomframe.sources.memory import data

        return data([[n * p, n, p, self.proportionZero(), self.proportionMissing()]], featureNames=["Values", "Points", "Features", "proportionZero", "proportionMissing"])

    # -- verbs that live in operators ------------------------------------------------------------------------------

    def __getattr__(self, name):
        from loomframe.operators import VERBS

        if name in VERBS:
            return VERBS[name].__get__(self)
        raise AttributeError(f"a Frame has no attribute {name!r}")


def _types_of(values: list) -> list[T.DataType]:
    kinds = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType(), list: T.ArrayType(T.DoubleType())}
    return [kinds.get(type(v), T.DoubleType()) for v in values]


def mode_plan(df: DataFrame, keys: list[str], c: str, t: T.DataType) -> DataFrame:
    """The mode of column c by group: the most frequent value; of several the middle in order, left of the centre."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).count()
    most = counts.groupBy(*keys).agg(F.max("count").alias("__most"))
    if keys:
        most = most.withColumnsRenamed({k: f"__{k}" for k in keys})
        best = counts.join(most, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).filter("count = __most").select(*keys, c)
    else:
        best = counts.crossJoin(F.broadcast(most)).filter("count = __most")
    if S.is_numeric(t) and not isinstance(t, T.BooleanType):
        middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast(t)
    else:
        values = F.sort_array(F.collect_list(c))
        middle = F.element_at(values, ((F.size(values) - 1) / 2).cast("int") + 1)
    return best.groupBy(*keys).agg(middle.alias(c))
