"""Random state of the library, and tables of random contents."""

from __future__ import annotations

import contextlib
import random as _random

from pyspark.sql import functions as F

_state = _random.Random(42)


def setSeed(seed: int | None) -> None:
    _state.seed(seed)


def generateSubsidiarySeed() -> int:
    return _state.randrange(2**31)


@contextlib.contextmanager
def alternateControl(seed: int | None = None):
    """Another random state inside the block."""
    kept = _state.getstate()
    _state.seed(seed)
    try:
        yield
    finally:
        _state.setstate(kept)


def data(numPoints: int, numFeatures: int, sparsity: float, pointNames="automatic", featureNames="automatic", elementType: str = "float", returnType=None, name=None, randomSeed: int | None = None):
    """A table with the given share of zeros (exactly, to the nearest cell), other cells normal or integers from 1 to 100."""
    from loomframe.plans.frame import PID, Frame, session

    seed = generateSubsidiarySeed() if randomSeed is None else randomSeed
    cells = numPoints * numFeatures
    zeros = round(cells * sparsity)
    # cells whose hashes are among the `zeros` least are zero: a cut, found on the driver for small tables, by quantile beyond
    ids = session().range(cells).select("id", F.xxhash64(F.lit(seed), "id").alias("h"))
    cut = ids.orderBy("h").limit(zeros).agg(F.max("h")).first()[0] if 0 < zeros < cells else None
    base = session().range(numPoints).withColumnRenamed("id", PID)
    cols = []
    for i in range(numFeatures):
        h = F.xxhash64(F.lit(seed), F.col(PID) * numFeatures + i)
        value = F.randn(seed + i) if elementType == "float" else (F.floor(F.rand(seed + i) * 100) + 1).cast("long")
        cols.append((F.when(h <= F.lit(cut), F.lit(0).cast("double" if elementType == "float" else "long")).otherwise(value) if cut is not None else (value if not zeros else F.lit(0.0))).alias(f"f{i}"))
    out = Frame(base.select(PID, *cols), [None] * numFeatures if featureNames == "automatic" else list(featureNames), True, name, rows=numPoints)
    if pointNames not in ("automatic", None, False):
        out.points.setNames(pointNames)
    return out
