"""Exact quantiles that no task holds the values of: brackets around them narrow until what is within is few."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a bracket is cut in, how exact the sketch is that cuts it, and how many values are counted one by one.
GRID, ACCURACY, FEW = 200, 1000, 5000


class _Rank:
    """The value of a rank (from 0) of a column lies between two values, both apart (None: no bound); `below` values come before those between, of which there are `size`."""

    def __init__(self, column: str, rank: int, size: int, grid: list[float]):
        self.column, self.rank, self.below, self.size, self.grid = column, rank, 0, size, grid
        self.low, self.high, self.margin, self.known, self.value = None, None, 2, False, None

    def between(self, low, high) -> Column:
        c = F.col(self.column)
        hit = c.isNotNull() if low is None else c > F.lit(low)
        return hit if high is None else hit & (c < F.lit(high))

    def next(self) -> tuple:
        """Cuts around the place that the rank has in the bracket."""
        at = (self.rank - self.below) / self.size * GRID
        i, j = math.floor(at) - self.margin, math.floor(at) + 1 + self.margin
        return (self.grid[i] if i >= 0 else self.low, self.grid[j] if j <= GRID else self.high)

    def asked(self) -> tuple[tuple, list[Column]]:
        """What a pass counts for the next bounds, of the values of this bracket: those below, at the lower, between, at the upper, and cuts of those between."""
        (low, high), here, c = self.next(), self.between(self.low, self.high), F.col(self.column)
        inner, none = here & self.between(low, high), F.lit(False)
        count = lambda hit: F.count_if(hit)
        ends = [here & (c < F.lit(low)), here & (c == F.lit(low))] if low is not None else [none, none]
        top = here & (c == F.lit(high)) if high is not None and high != low else none
        return (self.column, self.low, self.high, low, high), [*map(count, ends), count(inner), count(top), sketch(F.when(inner, c))]

    def take(self, low_high: tuple, below: int, at_low: int, inner: int, at_high: int, grid) -> None:
        """Takes the next bounds if the rank is within; else the next are wider."""
        (low, high), place = low_high, self.rank - self.below - below
        if place < 0 or place >= at_low + inner + at_high:
            self.margin *= 4
        elif place < at_low or place >= at_low + inner:
            self.known, self.value = True, low if place < at_low else high
        else:
            self.low, self.high, self.below, self.size, self.grid, self.margin = low, high, self.below + below + at_low, inner, grid, 2


def sketch(c: Column) -> Column:
    return F.percentile_approx(c, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)


def exact_quantiles(df: DataFrame, columns: list[Column], wanted: list[float]) -> list[list[float | None]]:
    """The quantiles wanted of each column, between two values interpolated linearly; None of a column without values. A pass
    counts the values at and between the next bounds of each rank and cuts those between in GRID parts by a sketch. The
    sketch only proposes bounds, the counts decide. The last pass counts the values that are left. So a task sends sketches
    of bounded size, and of each rank at most FEW values, however long the columns are."""
    if not columns:
        return []
    names = [f"v{i}" for i in range(len(columns))]
    df = df.select(*[c.cast("double").alias(v) for c, v in zip(columns, names, strict=True)])
    row = df.agg(*[F.count(v).alias(f"n{v}") for v in names], *[sketch(F.col(v)).alias(f"g{v}") for v in names]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    sizes = {v: row[f"n{v}"] for v in names}
    for v in names:
        for p in wanted if sizes[v] else []:
            for r in _ends(sizes[v], p)[1:]:
                ranks.setdefault((v, r), _Rank(v, r, sizes[v], row[f"g{v}"]))
    while open_ := [r for r in ranks.values() if not r.known and r.size > FEW]:
        some, ask = F.lit(False), {}
        for r in open_:
            key, what = r.asked()
            if key not in ask:
                ask[key] = what
                some = some | r.between(r.low, r.high)
        at = {key: k for k, key in enumerate(ask)}
        row = df.filter(some).agg(*[c.alias(f"c{k}_{i}") for k, what in enumerate(ask.values()) for i, c in enumerate(what)]).first()
        for r in open_:
            key = (r.column, r.low, r.high, *r.next())
            r.take(key[3:], *[row[f"c{at[key]}_{i}"] for i in range(5)])
    left = {(r.column, r.low, r.high): r for r in ranks.values() if not r.known}
    if left:
        some, cells = F.lit(False), []
        for k, r in enumerate(left.values()):
            hit = r.between(r.low, r.high)
            some = some | hit
            cells.append(F.when(hit, F.struct(F.lit(k).alias("k"), F.col(r.column).alias("v"))))
        counted: list[list[tuple[float, int]]] = [[] for _ in left]
        for k, v, n in df.filter(some).select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell.k", "cell.v").count().collect():
            counted[k].append((v, n))
        place = {key: sorted(counted[k], key=lambda x: (x[0] != x[0], x[0])) for k, key in enumerate(left)}
        for r in ranks.values():
            if not r.known:
                r.value = _nth(place[r.column, r.low, r.high], r.rank - r.below)
    return [[_interpolated(ranks, v, *_ends(sizes[v], p)) if sizes[v] else None for p in wanted] for v in names]


def _ends(n: int, p: float) -> tuple[float, int, int]:
    """The place of a quantile among n values, and the ranks on both sides of it."""
    position = (n - 1) * p
    return position, math.floor(position), math.ceil(position)


def _nth(counted: list[tuple[float, int]], rank: int) -> float:
    for v, n in counted:
        rank -= n
        if rank < 0:
            return v
    raise RuntimeError("the table changed between two passes")


def _interpolated(ranks: dict, column: str, position: float, low: int, high: int) -> float:
    first, second = ranks[column, low].value, ranks[column, high].value
    return first if low == high or first == second else (high - position) * first + (position - low) * second
