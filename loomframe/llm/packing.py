"""Operator 2: best-fit packing by hierarchical residuals.

Each partition tokenizes its documents, cuts those longer than a sequence into full pieces, and packs its
pieces best-fit decreasing. Bins with at most NEARLY_FULL free places are emitted; the rest go up as items,
their totals as sizes, to the next round, which merges the underfull bins of several partitions and packs
them best-fit again, until one task has seen all that is left. A round gives a task at most ROUND_ITEMS
items; where even the last rounds leave more, they are spread over as many tasks as that takes, so no task
grows with the corpus. Members travel as descriptions (document, piece, start, length, checksum); with
keep_ids their ids travel too.

Defined results: a null or empty text is one piece that holds the end id alone; a very long text is encoded piece
by piece and cut into full sequences; items of one size are packed in the order that they come in; rows with the
same id, or none, are packed each on its own; an empty table gives no rows; columns other than the id and the
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.arrowtext import slices, string_buffers
from loomframe.llm.bpe import SLICE_BYTES, default_path, word_bpe
from loomframe.llm.shared import Shared

#: A bin with no more free places than this is emitted.
NEARLY_FULL = 2
#: Items that one task packs at a time.
ROUND_ITEMS = 100_000
#: Partitions whose underfull bins meet in one task of the next round.
FAN_IN = 16


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item and its offset there. Free places are a bit set, so a fit is the lowest bit from the size on."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - free
        left = free - s
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return where, offset


def _member_type(keep_ids: bool) -> pa.DataType:
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
    return pa.struct(fields + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))


def _schema(keep_ids: bool) -> str:
    ids = ", ids: array<int>" if keep_ids else ""
    return f"total long, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint{ids}>>"


def merge_bins(items: pa.Table, capacity: int) -> pa.RecordBatch:
    """Packs items (total, members) into bins of the same form."""
    total = np.asarray(items.column("total"), dtype=np.int64)
    members = items.column("members").combine_chunks()
    if isinstance(members, pa.ChunkedArray):
        members = pa.concat_arrays(members.chunks) if members.num_chunks else pa.array([], items.schema.field("members").type)
    where, shift = best_fit(total, capacity)
    order = np.lexsort((shift, where))
    members = members.take(pa.array(order))
    flat = members.flatten()
    each = np.diff(np.asarray(members.offsets))
    moved = np.asarray(flat.field("offset")) + np.repeat(shift[order], each)
    flat = pa.StructArray.from_arrays([flat.field(i) if f.name != "offset" else pa.array(moved) for i, f in enumerate(flat.type)], fields=list(flat.type))
    per_bin = np.bincount(where[order], weights=each).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)), flat)
    sums = np.bincount(where, weights=total).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sums), lists], ["total", "members"])


def _pack_partition(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROUND_ITEMS:
                yield merge_bins(pa.Table.from_batches(held), capacity)
                held, n = [], 0
        if n:
            yield merge_bins(pa.Table.from_batches(held), capacity)

    return run


def token_pieces(batch: pa.RecordBatch, path: str, capacity: int, end_id: int, keep_ids: bool) -> pa.RecordBatch:
    """Each piece of the batch's documents as an item with one member."""
    bpe = word_bpe(path)
    if batch.num_rows == 1 and batch.nbytes > 2 * SLICE_BYTES:
        ids = np.concatenate(list(bpe.encode_pieces(string_buffers(batch.column(1))[0])))
        off = np.array([0, len(ids)])
    else:
        ids, off = bpe.encode(batch.column(1).to_pylist())
    ids = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4")
    off = off + np.arange(len(off))
    length = np.diff(off)
    pieces = -(-length // capacity)
    row = np.repeat(np.arange(len(length)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    size = np.minimum(capacity, length[row] - start)
    begin = off[row] + start
    raw = memoryview(ids).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), size.tolist(), strict=True)]
    cols = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.zeros(len(row), np.int64))]
    if keep_ids:
        cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, off[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
    members = pa.StructArray.from_arrays(cols, fields=list(_member_type(keep_ids)))
    return pa.RecordBatch.from_arrays([pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32)), members)], ["total", "members"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids)."""
    path = path or default_path()
    spark = df.sparkSession
    store = Shared(spark, "packing")
    schema = _schema(keep_ids)
    nearly = min(NEARLY_FULL, capacity // 64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    yield token_pieces(part, path, capacity, end_id, keep_ids)

        yield from _pack_partition(capacity)(items())

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bins = store.cut(docs.mapInArrow(first, schema))
    done, tasks = [], None
    while True:
        done.append(bins.filter(F.col("total") >= capacity - nearly))
        under = bins.filter(F.col("total") < capacity - nearly)
        left = under.count()
        least = -(-left // ROUND_ITEMS)
        if left <= 1 or tasks is not None and tasks <= least:
            done.append(under)
            break
        tasks = max(least, -(-(tasks or under.rdd.getNumPartitions()) // FAN_IN))
        # the same bins meet in the same task whenever it is computed again
        key = F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["ids_crc32"])
        bins = store.cut(under.repartition(tasks, key).mapInArrow(_pack_partition(capacity), schema))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return whole.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.inline("members")).select(*cols)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
