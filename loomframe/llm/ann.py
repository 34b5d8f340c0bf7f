"""Operator 5: approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Equal vectors are drawn together first: a distinct vector keeps its KEEP smallest ids, all that a result of k
rows can show of them. Distinct vectors go to the cell of the nearest of some centroids (spherical k-means on a
sample of CENTROID_SAMPLE vectors; every vector is indexed), so that a shard has about SHARD_ROWS of them. In a
shard, every point is inserted by a greedy search from the medoid whose visited points are pruned to DEGREE
diverse edges (a candidate goes when a chosen edge is nearer to it by the factor ALPHA than the point is), and
edges are made mutual and pruned again. A query goes to the PROBES nearest cells and to every other cell that can
hold one of its k nearest: the k-th best similarity among the sample is a bound from below, and a cell whose
farthest vector's angle to the centroid leaves all of it below that bound is passed by, so no neighbour is lost
by the choice of cells. It runs a beam search of width BEAM in each; what it finds is scored exactly in double
precision, and the k best over its shards are its result. Points of a step are searched together, so the work is
in array products.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or a non-finite
component take no part, neither as queries nor as candidates; ties go to the smaller id; rows of one id are
distinct vectors of the same id, and a query never finds its own id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.shared import Shared

SHARD_ROWS = 4096
#: No shard holds more; a larger cell is split by hash and searched in all its parts.
SHARD_MOST = 65_536
CENTROID_SAMPLE, CENTROIDS_MOST = 8192, 1024
PROBES = 8
DEGREE, BEAM, BUILD_BEAM, ALPHA = 24, 64, 48, 1.2
STEP = 512
#: Added to angles against rounding.
SLACK = 1e-6


# -- graph -------------------------------------------------------------------------------------------------------


class Graph:
    """Directed edges among unit vectors, built by batched insertion."""

    def __init__(self, unit: np.ndarray, seed: int = 11):
        self.x = unit.astype(np.float32)
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.room = DEGREE + DEGREE // 2
        self.edges = np.full((n, self.room), -1, np.int32)
        if n <= 1:
            self.start = 0
            return
        k = min(DEGREE, n - 1)
        pick = rng.integers(0, n - 1, (n, k))
        self.edges[:, :k] = pick + (pick >= np.arange(n)[:, None])
        self.start = int(np.argmax(self.x @ self.x.mean(0)))
        for alpha in (1.0, ALPHA):
            order = rng.permutation(n)
            for b in range(0, n, STEP):
                self._insert(order[b : b + STEP], alpha)

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.x[points], BUILD_BEAM)
        near = np.concatenate([found, self.edges[points]], 1)
        self.edges[points] = -1
        self.edges[points, :DEGREE] = chosen = self._prune(points, near, alpha)
        source = np.repeat(points, DEGREE)
        target = chosen.ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), count)
        extra[row, np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([self.edges[nodes], extra], 1)
        both = np.where(both < 0, np.iinfo(np.int64).max, both)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = np.iinfo(np.int64).max
        both.sort(1)
        over = (both < len(self.x)).sum(1) > self.room
        lists = np.where(both < len(self.x), both, -1)
        fits = lists[~over][:, : self.room]
        wide = np.full((len(fits), self.room), -1, np.int32)
        wide[:, : fits.shape[1]] = fits
        self.edges[nodes[~over]] = wide
        rest = np.flatnonzero(over)
        for b in range(0, len(rest), STEP):
            some = rest[b : b + STEP]
            self.edges[nodes[some]] = -1
            self.edges[nodes[some], :DEGREE] = self._prune(nodes[some], lists[some], alpha)

    def _prune(self, points: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
        """Of each point's candidates (-1: none) the nearest, then the nearest that no chosen one covers, and so on."""
        near = np.where(near == points[:, None], -1, near)
        away = np.where(near >= 0, 2 - 2 * np.einsum("bd,bcd->bc", self.x[points], self.x[near]), np.inf)
        order = np.argsort(away, 1, kind="stable")
        near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
        v = self.x[near]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(away)
        out = np.full((len(points), DEGREE), -1, np.int64)
        rows = np.arange(len(points))
        for e in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            p = alive.argmax(1)
            out[some, e] = near[rows, p][some]
            covered = alpha * alpha * between[rows, p] <= away
            alive &= ~covered & (near != near[rows, p][:, None])
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest points found for each query, nearest first, and their similarities."""
        n, b = len(self.x), len(queries)
        beam = min(beam, n)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int64)
        score = np.full((b, beam), -np.inf, np.float32)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        ids[:, 0], score[:, 0] = self.start, queries @ self.x[self.start]
        seen[:, self.start] = True
        while True:
            open_ = ~done & (ids >= 0)
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                return ids, score
            at = open_[live].argmax(1)
            done[live, at] = True
            near = self.edges[ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
            s = np.where(fresh, np.einsum("bd,bcd->bc", queries[live], self.x[near]), -np.inf)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_score = np.concatenate([score[live], s], 1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
            order = np.argsort(-all_score, 1, kind="stable")[:, :beam]
            ids[live], score[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_score, all_done))


# -- tables ------------------------------------------------------------------------------------------------------


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) if len(col) else np.zeros((0, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    unit = _unit(sample)
    if cells <= 1 or len(unit) <= cells:
        return unit[:cells]
    c = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        of = (unit @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row of df where is_query holds (a condition on vec_id), the k nearest of all other rows."""
    spark = df.sparkSession
    store = Shared(spark, "ann")
    keep = k + 1
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.filter(v.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    dim = sizes[0]["dim"]
    rows = rows.filter(F.size("v") == dim)

    def draw_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten(), dtype=np.float32).reshape(-1, dim) + np.float32(0)  # minus zero as zero
            ids: dict[bytes, list[int]] = {}
            for i, r in zip(batch.column(0).to_pylist(), x, strict=True):
                ids.setdefault(r.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array([sorted(x)[:keep] for x in ids.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    distinct = store.cut(rows.mapInArrow(draw_together, "vec binary, ids array<long>").groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")))
    total = distinct.count()
    cells = max(1, min(CENTROIDS_MOST, -(-total // SHARD_ROWS)))
    sample = distinct.orderBy(F.xxhash64("vec"), "vec").limit(CENTROID_SAMPLE).toArrow()
    centre = spark.sparkContext.broadcast(centroids(_matrix(sample["vec"], dim), cells).astype(np.float32))
    # the sample's vectors with the id of those that have one alone
    sole = np.array([i[0] if len(i) == 1 else -1 for i in sample["ids"].to_pylist()], np.int64), np.array([len(i) == 1 for i in sample["ids"].to_pylist()], bool)
    known = spark.sparkContext.broadcast((_matrix(sample["vec"], dim).astype(np.float32), *sole))

    def angles(unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ _unit(centre.value.astype(np.float64)).T, -1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), dim))
            for b in range(0, len(unit), STEP):
                away = angles(unit[b : b + STEP])
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, STEP), batch.column(1).slice(b, STEP), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["vec", "ids", "cell", "away"])

    placed = store.cut(distinct.mapInArrow(place, "vec binary, ids array<long>, cell int, away double"))
    # CENTROIDS_MOST rows at most; a cell without vectors is in reach of none
    reach = np.full(cells, -np.inf)
    for r in placed.groupBy("cell").agg(F.max("away").alias("away")).collect():
        reach[r["cell"]] = r["away"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, owner, alone = known.value
        vectors = _unit(vectors.astype(np.float64))
        for batch in batches:
            unit, name = _unit(_matrix(batch.column(0), dim)), np.array([i[0] for i in batch.column(1).to_pylist()], np.int64)
            for b in range(0, len(unit), STEP):
                q = unit[b : b + STEP]
                away = angles(q)
                go = np.isfinite(reach)[None] & (np.argsort(np.argsort(away, 1, kind="stable"), 1, kind="stable") < PROBES)
                if len(vectors) > keep:
                    s = q @ vectors.T
                    s[(s > 1 - SLACK) | alone & (owner == name[b : b + STEP, None])] = -1  # itself, or of its own id
                    bound = np.arccos(np.clip(np.partition(s, -k, 1)[:, -k], -1, 1))
                    go |= away - reach <= bound[:, None] + SLACK
                else:
                    go |= np.isfinite(reach)[None]
                row, cell = np.nonzero(go)
                for c in range(0, len(row), SHARD_ROWS):
                    pick = pa.array(b + row[c : c + SHARD_ROWS])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(cell[c : c + SHARD_ROWS].astype(np.int32))], ["vec", "ids", "cell"])

    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("parts"))
    # every id that is a query, with its vector: a hot vector brings each of its ids, a row each
    asked = rows.filter(is_query).select(F.transform("v", lambda e: e + F.lit(0).cast("float")).alias("v"), "vec_id")

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([[i] for i in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["vec", "ids"])

    asked = asked.mapInArrow(to_bytes, "vec binary, ids array<long>").mapInArrow(route, "vec binary, ids array<long>, cell int")
    points = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int").alias("part"), "vec", "ids", F.lit(False).alias("query"))
    asks = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec", "ids", F.lit(True).alias("query"))

    def shard(table: pa.Table) -> pa.Table:
        query = np.asarray(table["query"])
        pick = lambda mask: table.filter(pa.array(mask))
        mine, asks = pick(~query), pick(query)
        order = np.argsort(np.array([i[0] for i in mine["ids"].to_pylist()], np.int64), kind="stable")  # the same graph whatever the order of arrival
        mine = mine.take(pa.array(order))
        x, q = _matrix(mine["vec"], dim), _matrix(asks["vec"], dim)
        result: list[tuple[int, int, float]] = []
        if len(x) and len(q):
            graph, ids = Graph(_unit(x)), mine["ids"].to_pylist()
            names = [i[0] for i in asks["ids"].to_pylist()]
            unit, norm = _unit(q).astype(np.float32), np.linalg.norm(x, axis=1)
            for b in range(0, len(q), STEP):
                found, _ = graph.search(unit[b : b + STEP], BEAM)
                for j, near in enumerate(found[:, : 2 * keep]):
                    near = near[near >= 0]
                    vector = q[b + j]
                    exact = x[near] @ vector / (norm[near] * np.linalg.norm(vector))
                    best = sorted((-s, i) for s, p in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[p] if i != names[b + j])[:k]
                    result += [(names[b + j], i, -s) for s, i in best]
        cols = list(zip(*result, strict=True)) if result else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = points.unionByName(asks).groupBy("cell", "part").applyInArrow(shard, "query_id long, vec_id long, score double")
    # at most k rows of each part of each cell that a query went to meet here
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("away"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
