"""Tables from memory and from files: data(), ones(), zeros(), identity()."""

from __future__ import annotations

import datetime
import numbers

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.exceptions import FileFormatException, InvalidArgumentType, InvalidArgumentValue
from loomframe.plans.frame import PID, PNAME, Frame, session

#: What counts as missing where data comes in.
DEFAULT_MISSING = (float("nan"), None, "", "None", "nan", "NULL", "NA")


def _cell(v, missing, replacement):
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if v is None or v != v or any(v == m and isinstance(v, str) == isinstance(m, str) for m in missing if m is not None):
        return replacement
    if isinstance(v, complex) or not isinstance(v, (numbers.Number, str, bool, datetime.datetime, datetime.date)):
        raise InvalidArgumentType(f"a cell cannot be {type(v).__name__}")
    return v


def _column_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.DoubleType()
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int} and all(-(2**63) <= v < 2**63 for v in values if v is not None):
        return T.LongType()
    if kinds <= {int, float, bool}:
        return T.DoubleType()
    if kinds <= {datetime.datetime}:
        return T.TimestampType()
    if kinds <= {datetime.date}:
        return T.DateType()
    return T.StringType()


def _looks_like_names(first: list, second: list | None) -> bool:
    """The first row names features if it is all unique strings and the second has a number."""
    return bool(first) and all(isinstance(v, str) for v in first) and len(set(first)) == len(first) and second is not None and any(isinstance(v, numbers.Number) and not isinstance(v, bool) for v in second)


def _cast(value, kind):
    if value is None:
        return None
    name = kind if isinstance(kind, str) else getattr(kind, "__name__", str(kind))
    if "datetime" in name:
        return datetime.datetime.fromisoformat(str(value))
    make = {"int": int, "int64": int, "float": float, "float64": float, "str": str, "object": lambda v: v, "bool": bool}.get(name)
    if not make:
        raise InvalidArgumentValue(f"cannot convert to {kind!r}")
    try:
        return make(float(value)) if make is int and isinstance(value, str) else make(value)
    except ValueError as e:
        raise InvalidArgumentValue(f"{value!r} is not {name}") from e


def data(source, pointNames="automatic", featureNames="automatic", returnType=None, name=None, convertToType=None, keepPoints="all", keepFeatures="all", treatAsMissing=DEFAULT_MISSING, replaceMissingWith=None, rowsArePoints: bool = True, ignoreNonNumericalFeatures: bool = False, inputSeparator="automatic", copyData: bool = True, useLog=None) -> Frame:
    """A table from lists, dictionaries, arrays, frames of pandas or Spark, another table, or a path.

    Missing values become NULL (or replaceMissingWith). returnType is a tag: there is one kind of table.
    """
    if isinstance(source, str) or hasattr(source, "__fspath__"):
        from loomframe.sources import files

        return files.read(str(source), pointNames, featureNames, name, convertToType, keepPoints, keepFeatures, treatAsMissing, replaceMissingWith, rowsArePoints, ignoreNonNumericalFeatures, inputSeparator)
    if isinstance(source, Frame):
        return source.copy()
    if isinstance(source, DataFrame):
        return Frame.from_spark(source, pointNames=pointNames if pointNames not in ("automatic", None, False, True) else None, name=name)
    names = None
    if hasattr(source, "toarray"):
        source = source.toarray()
    if type(source).__module__.startswith("pandas"):
        names = [str(c) for c in source.columns] if hasattr(source, "columns") and not all(isinstance(c, int) for c in source.columns) else None
        source = source.to_numpy(dtype=object).tolist()
    if isinstance(source, np.ndarray):
        if source.dtype.names:
            names, source = list(source.dtype.names), source.tolist()
        else:
            source = source.tolist()
    if isinstance(source, dict):
        names, cols = list(map(str, source)), list(source.values())
        source = list(map(list, zip(*cols, strict=True)))
    rows = [list(r.values()) if isinstance(r, dict) else r for r in (source if isinstance(source, list) else list(source))]
    if rows and isinstance(source, list) and isinstance(source[0], dict):
        names = list(map(str, source[0]))
        rows = [[r.get(k) for k in source[0]] for r in source]
    if rows and not isinstance(rows[0], (list, tuple, np.ndarray)):
        rows = [rows]  # one dimension is one point
    dims = None
    if rows and rows[0] and isinstance(rows[0][0], (list, tuple)):  # more than two dimensions: flat, with the shape beside it
        shape, r = [len(rows)], rows[0]
        while isinstance(r, (list, tuple)):
            shape.append(len(r))
            r = r[0]
        flat = lambda x: [v for y in x for v in flat(y)] if isinstance(x, (list, tuple)) else [x]
        rows, dims = [flat(r) for r in rows], shape
    rows = [list(r) for r in rows]
    if len({len(r) for r in rows}) > 1:
        raise FileFormatException("points differ in their number of features")
    if not rowsArePoints:
        rows = list(map(list, zip(*rows, strict=True)))
    pts = None
    first_column = pointNames is True
    if featureNames is True or featureNames == "automatic" and names is None and len(rows) > 1 and _looks_like_names(rows[0], rows[1]):
        names, rows = [str(v) for v in rows[0]], rows[1:]
        first_column = first_column or pointNames == "automatic" and names and names[0] == "pointNames"
    if isinstance(featureNames, (list, tuple)):
        names = list(featureNames)
    elif isinstance(featureNames, dict):
        names = [n for n, _ in sorted(featureNames.items(), key=lambda kv: kv[1])]
    if featureNames in (None, False):
        names = None
    if first_column:
        pts, rows = [str(r[0]) for r in rows], [r[1:] for r in rows]
        names = names[1:] if names and len(names) > len(rows[0]) else names
    if isinstance(pointNames, (list, tuple)):
        pts = list(pointNames)
    width = len(rows[0]) if rows else len(names or [])
    names = list(names) if names else [None] * width
    if len(names) != width or pts is not None and len(pts) != len(rows):
        raise InvalidArgumentValue("there must be a name for each feature and point")
    rows = [[_cell(v, treatAsMissing, replaceMissingWith) for v in r] for r in rows]
    if convertToType is not None:
        kinds = convertToType if isinstance(convertToType, (list, dict)) else [convertToType] * width
        by = {(names.index(k) if isinstance(k, str) else k): v for k, v in kinds.items()} if isinstance(kinds, dict) else dict(enumerate(kinds))
        rows = [[_cast(v, by[i]) if by.get(i) is not None else v for i, v in enumerate(r)] for r in rows]
    out = _frame(rows, names, pts, name)
    out._dims = dims
    if ignoreNonNumericalFeatures:
        from loomframe.functions.statistics import is_numeric

        out = out._select([i for i, t in enumerate(out._types) if is_numeric(t)])
    if keepFeatures != "all":
        out = out._select(out._feature_indices(keepFeatures))
    if keepPoints != "all":
        out = out._pick(out._point_ids(keepPoints))
    return out


def _frame(rows: list[list], names: list, pts: list | None, name: str | None) -> Frame:
    width = len(names)
    types = [_column_type([r[i] for r in rows]) for i in range(width)]
    make = {T.StringType: lambda v: v if isinstance(v, str) else str(v), T.DoubleType: float}
    fix = lambda v, t: None if v is None else make.get(type(t), lambda x: x)(v)
    rows = [[fix(v, t) for v, t in zip(r, types, strict=True)] for r in rows]
    schema = T.StructType([T.StructField(PID, T.LongType()), *([T.StructField(PNAME, T.StringType())] if pts else []), *[T.StructField(f"f{i}", t) for i, t in enumerate(types)]])
    given = [n for n in pts or [] if n is not None]
    if len(set(given)) != len(given):
        raise InvalidArgumentValue("point names must be unique")
    df = session().createDataFrame([(i, *([pts[i]] if pts else []), *r) for i, r in enumerate(rows)], schema)
    return Frame(df, names, True, name, rows=len(rows))


def _constant(value: float, n: int, p: int, pointNames, featureNames, name) -> Frame:
    if n < 0 or p < 0 or not n and not p:
        raise InvalidArgumentValue("a table needs points or features")
    df = session().range(n).select(F.col("id").alias(PID), *[F.lit(value).alias(f"f{i}") for i in range(p)])
    out = Frame(df, [None] * p if featureNames == "automatic" or featureNames is None else list(featureNames), True, name, rows=n)
    if pointNames not in ("automatic", None):
        out.points.setNames(pointNames)
    return out


def ones(numPoints, numFeatures, pointNames="automatic", featureNames="automatic", returnType="Matrix", name=None) -> Frame:
    return _constant(1.0, numPoints, numFeatures, pointNames, featureNames, name)


def zeros(numPoints, numFeatures, pointNames="automatic", featureNames="automatic", returnType="Matrix", name=None) -> Frame:
    return _constant(0.0, numPoints, numFeatures, pointNames, featureNames, name)


def identity(size, pointNames="automatic", featureNames="automatic", returnType="Matrix", name=None) -> Frame:
    out = _constant(0.0, size, size, pointNames, featureNames, name)
    return out._with(out._df.withColumns({f"f{i}": (F.col(PID) == i).cast("double") for i in range(size)}), rows=size)


