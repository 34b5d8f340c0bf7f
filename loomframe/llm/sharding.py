"""Operator 7: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Each row gets its block, a group of scan partitions; blocks are counted.
2. The driver draws how many rows each block sends to each shard: the margins are the block counts and the
   shard sizes, the law is multivariate hypergeometric, block by block. There are MAX_BLOCKS blocks at most,
   so the matrix is bounded however large the input is.
3. Rows are permuted within their block (a random rank), and ranks are cut at the matrix row: that is the shard.
4. Rows are exchanged by shard and permuted again. A shard is ranked in lots of about LOT_ROWS rows drawn by
   a second hash, whose counts give each lot its first slot, so no task sorts a whole shard.

Only DataFrame functions run on executors. Random keys hash a row number that belongs to the scan, so a
partition that is computed again gives the same rows the same places.

Defined results: a null text has size 1 and the checksum of no bytes; repeated rows and ties of any kind are
distinct rows; an empty table gives no rows; other columns are read only if named in `keep`, and results
replace kept columns of the same name.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.shared import Shared

MAX_BLOCKS = 4096
LOT_ROWS = 100_000
#: Constants of the ratio-of-uniforms sampler H2PE's simpler sibling HRUA (Stadlober 1990).
HAT_WIDTH, HAT_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items, taken without replacement from good + bad, are good."""
    total = good + bad
    if not good or not drawn:
        return 0
    if not bad or drawn == total:
        return min(good, drawn)
    few = min(drawn, total - drawn)
    if few <= 16:  # draw them
        left, hits = good, 0
        for i in range(few):
            if rng.random() * (total - i) < left:
                left, hits = left - 1, hits + 1
        return hits if few == drawn else good - hits
    low, high = min(good, bad), max(good, bad)
    share = low / total
    centre = few * share + 0.5
    spread = math.sqrt((total - few) * few * share * (1 - share) / (total - 1) + 0.5)
    width = HAT_WIDTH * spread + HAT_SHIFT
    mode = (few + 1) * (low + 1) // (total + 2)

    def weight(z: int) -> float:
        return math.lgamma(z + 1) + math.lgamma(low - z + 1) + math.lgamma(few - z + 1) + math.lgamma(high - few + z + 1)

    most, at_mode = min(min(few, low) + 1, int(centre + 16 * spread)), weight(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        w = centre + width * (v - 0.5) / u
        if not max(0, few - high) <= w < most:
            continue
        z = int(w)
        if 2 * math.log(u) <= at_mode - weight(z):
            break
    hits = z if good <= bad else few - z
    return hits if few == drawn else good - hits


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with these margins, as a uniform permutation would give it."""
    rng, left = random.Random(seed), list(columns)
    out = []
    for n in rows:
        line, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            k = hypergeometric(rng, room, rest, n)
            line.append(k)
            n -= k
            left[s] -= k
        out.append(line)
    return out


def shard_rows(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 20_240, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row, with the columns named in keep."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    kept: list[Column] = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    store = Shared(spark, "sharding")
    rows = store.cut(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            (F.spark_partition_id() % MAX_BLOCKS).alias("block"),
            F.monotonically_increasing_id().alias("row"),
            *kept,
        )
    )
    blocks = [(r["block"], r["count"]) for r in rows.groupBy("block").count().orderBy("block").collect()]
    total = sum(n for _, n in blocks)
    want = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    edges = []
    for (block, _), line in zip(blocks, communication_matrix([n for _, n in blocks], want, seed), strict=True):
        ends, at = [], 0
        for k in line[:-1]:
            ends.append(at := at + k)
        edges.append({"block": block, "edges": ends})
    matrix = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(edges)), "array<struct<block: int, edges: array<bigint>>>")))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "row"), "row"))
    lots = max(8, -(-total // (shards * LOT_ROWS)))
    dealt = (
        rows.withColumn("rank", rank)
        .join(F.broadcast(matrix), "block")  # MAX_BLOCKS rows at most
        .withColumn("shard", F.size(F.filter("edges", lambda e: e < F.col("rank"))))
        .withColumn("lot", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(lots)).cast("int"))
        .drop("edges", "rank", "block")
    )
    dealt = store.cut(dealt)
    order = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "lot").count().select("shard", "lot", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "lot").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row"))
    placed = dealt.withColumn("within", within).join(first, ["shard", "lot"]).withColumn("slot", F.col("first") + F.col("within") - 1)
    results = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep) if c not in results])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
