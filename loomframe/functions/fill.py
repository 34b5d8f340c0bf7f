"""Fills of matched values: as plans over ordered columns, and as functions of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.exceptions import InvalidArgumentValue
from loomframe.functions import statistics as S
from loomframe.functions.match import value_match


def _flags(vector, match):
    values = S._values(vector)
    hit = value_match(match)
    return values, [bool(hit(v)) for v in values]


def constant(vector, match, constantValue):
    """Matched values become the constant."""
    values, flags = _flags(vector, match)
    return [constantValue if f else v for v, f in zip(values, flags, strict=True)]


def _of_rest(name: str, statistic):
    def fill(vector, match):
        values, flags = _flags(vector, match)
        if not any(flags):
            return values
        rest = [v for v, f in zip(values, flags, strict=True) if not f]
        if not rest:
            raise InvalidArgumentValue(f"{name}: every value matches, so there is nothing to fill from")
        value = statistic(rest)
        if isinstance(value, float) and np.isnan(value):
            raise InvalidArgumentValue(f"{name}: the values are not numbers")
        return [value if f else v for v, f in zip(values, flags, strict=True)]

    fill.__name__, fill.__doc__ = name, f"Matched values become the {name} of the others."
    return fill


mean = _of_rest("mean", S.mean)
median = _of_rest("median", S.median)
mode = _of_rest("mode", S.mode)


def forwardFill(vector, match):
    """Matched values become the last that does not match."""
    values, flags = _flags(vector, match)
    if flags and flags[0]:
        raise InvalidArgumentValue("forwardFill: the first value matches")
    out = []
    for v, f in zip(values, flags, strict=True):
        out.append(out[-1] if f else v)
    return out


def backwardFill(vector, match):
    """Matched values become the next that does not match."""
    values, flags = _flags(vector, match)
    if flags and flags[-1]:
        raise InvalidArgumentValue("backwardFill: the last value matches")
    out = []
    for v, f in zip(values[::-1], flags[::-1], strict=True):
        out.append(out[-1] if f else v)
    return out[::-1]


def interpolate(vector, match, **kwarguments):
    """Matched values lie on the line between their neighbours that do not match; ends repeat the nearest."""
    values, flags = _flags(vector, match)
    if not any(flags):
        return values
    at = [i for i, f in enumerate(flags) if not f]
    if not at:
        raise InvalidArgumentValue("interpolate: every value matches")
    filled = np.interp([i for i, f in enumerate(flags) if f], kwarguments.get("xp", at), kwarguments.get("fp", [values[i] for i in at]))
    filled = iter(filled.tolist())
    return [next(filled) if f else v for v, f in zip(values, flags, strict=True)]


def python_fill(function, match, **kwarguments):
    return lambda vector: function(vector, match, **kwarguments)


# -- plans -----------------------------------------------------------------------------------------------------------

STATISTICS = {"mean": "mean", "median": "median", "mode": "mode"}
DIRECTIONAL = {"forwardFill", "backwardFill", "interpolate"}


def directional(df: DataFrame, pid: str, column: str, hit: Column, kind: str, rows: int, lot: int = 500_000) -> DataFrame:
    """df with the column filled along the order of pid (dense). Windows run within lots of pid; what a lot needs from
    before and after it is the last and first unmatched value of other lots, a table of one row for each lot."""
    base = df.withColumn("__hit", hit).withColumn("__lot", F.floor(F.col(pid) / lot).cast("long"))
    known = F.when(~F.col("__hit"), F.struct(F.col(pid).alias("p"), F.col(column).cast("double" if kind == "interpolate" else df.schema[column].dataType).alias("v")))
    # looking ahead is looking back in the reversed order: a frame that grows is kept, one that shrinks is read anew for each row
    ahead, back = Window.partitionBy("__lot").orderBy(F.desc(pid)), Window.partitionBy("__lot").orderBy(pid)
    base = base.withColumn("__prev", F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("__next", F.last(known, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    if rows > lot:
        lots = base.groupBy("__lot").agg(F.max(known).alias("last"), F.min(known).alias("first"))
        up, down = (Window.partitionBy(F.lit(0)).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__lot"), F.desc("__lot")))
        edges = lots.select("__lot", F.last("last", ignorenulls=True).over(up).alias("__before"), F.last("first", ignorenulls=True).over(down).alias("__after"))
        base = base.join(edges, "__lot").withColumn("__prev", F.coalesce("__prev", "__before")).withColumn("__next", F.coalesce("__next", "__after")).drop("__before", "__after")
    prev, nxt = F.col("__prev"), F.col("__next")
    if kind == "forwardFill":
        new = prev["v"]
    elif kind == "backwardFill":
        new = nxt["v"]
    else:
        line = prev["v"] + (nxt["v"] - prev["v"]) * (F.col(pid) - prev["p"]) / (nxt["p"] - prev["p"])
        new = F.when(prev.isNull(), nxt["v"]).when(nxt.isNull(), prev["v"]).otherwise(line)
    return base.withColumn(column, F.when(F.col("__hit"), new).otherwise(F.col(column))).drop("__hit", "__lot", "__prev", "__next")
