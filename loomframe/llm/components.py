"""Connected components of a graph whose edges are a table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.shared import Shared


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # follow pointers to the end
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        nodes, roots = local_roots(a, b)
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])


def components(edges: DataFrame, store: Shared, rounds: int = 50) -> DataFrame:
    """node, root of each node of the edges (a, b): the root is the least node that it is connected with.

    Each batch of edges is first contracted to stars where it lies; then large and small stars alternate, each a
    minimum by key (combined before the shuffle) joined back to the edges, until every node points to a root.
    """
    e = store.cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(rounds):
        state = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        heads = e.select(F.col("b").alias("a")).distinct()
        open_ = state.filter("n > 1").select("a").unionByName(state.join(heads, "a", "left_semi").select("a"))
        if open_.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store.cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = store.cut(small.mapInArrow(_contract, "a long, b long").distinct())
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    pointed = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pointed.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
