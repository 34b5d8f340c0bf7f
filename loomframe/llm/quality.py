"""Operator 1: quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms say how it is written: characters by kind, bigrams and trigrams of kinds with runs drawn
together (hashed), words that repeat the one before them, and hashed words. Terms of a bounded sample of
labelled documents, weighted by inverse document frequency, are reduced to DIMENSIONS latent ones by an
eigendecomposition; the sample's unit vectors are broadcast (SAMPLE_PER_CLASS rows of each label at most, so
their size has a bound). Every document is projected likewise; blocks of documents are multiplied with all
labelled vectors, which gives every cosine exactly, and its NEIGHBOURS nearest vote with their similarity as
weight. Each document counts whole, however long; nothing is shuffled but the sample.

Defined results: a null or empty text, and one with no term that the sample has, gets the share of label 1 in
the sample as score; with no labelled row at all every score is 0.5. Labels that are null are not learnt from; of
different labels for one document each counts, of equal ones one, and of rows that repeat an id one text. Neighbours
of equal similarity at the edge are taken as they come in the sample's order. A very long text is read in steps; an
empty table gives no rows; repeated rows are each scored; a null id is not held out. Other columns are not read, so
their names cannot clash; keep_good keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import wordhash
from loomframe.llm.arrowtext import slices, string_buffers

#: Rows learnt from, of either label. A bound, not a share: the sample does not grow with the corpus.
SAMPLE_PER_CLASS = 2500
TERMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
#: Documents in a block of cosine products.
BLOCK = 256
THRESHOLD = 0.3
#: Bytes beyond which a text's terms are counted in steps.
LONG = 2 << 20

_WORD_TERMS = 256
_KINDS = 40


def _kinds() -> np.ndarray:
    """Kind of each byte: lower, upper, digit, space, line end, other white or control, beyond ASCII, each mark."""
    out = np.full(256, 5, np.uint8)
    out[128:] = 6
    marks = 7
    for b in range(128):
        c = chr(b)
        if c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == " ":
            out[b] = 3
        elif c == "\n":
            out[b] = 4
        elif 32 < b < 127:
            out[b] = marks
            marks += 1
    return out


KINDS = _kinds()


_GRAMS = TERMS - _KINDS - _WORD_TERMS - 2


def _slots(kinds: np.ndarray, width: int) -> np.ndarray:
    """The term of each `width` kinds in a row."""
    code = np.zeros(len(kinds) - width + 1, np.uint32)
    for j in range(width):
        code = code * np.uint32(64) + kinds[j : len(kinds) - width + 1 + j]
    return _KINDS + 2 + (((code + np.uint32(width)) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(_GRAMS)).astype(np.int64)


def _word_slots(word: np.ndarray) -> np.ndarray:
    return _KINDS + 2 + _GRAMS + (word % np.uint64(_WORD_TERMS)).astype(np.int64)


def _scaled(table: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.log1p(1000 * (table / np.maximum(size, 1)[:, None])).astype(np.float32)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the TERMS terms of each text, as log(1 + count) scaled by the text's length."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    if not len(data):
        return np.zeros((n, TERMS), np.float32)
    if n == 1 and len(data) > LONG:
        return long_term_counts(data)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    kind = KINDS[data]
    counts = np.zeros(n * TERMS, np.float64)

    def add(term: np.ndarray, of: np.ndarray) -> None:
        nonlocal counts
        counts += np.bincount(of * TERMS + term, minlength=n * TERMS)

    add(kind.astype(np.int64), doc)
    turn = np.ones(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(turn)
    k, d = kind[at].astype(np.uint32), doc[at]
    for width in (2, 3):
        if len(k) < width:
            break
        same = d[width - 1 :] == d[: len(d) - width + 1]
        add(_slots(k, width)[same], d[: len(d) - width + 1][same])
    begins, ends, first = wordhash.words(data, offsets)
    if len(begins):
        word = wordhash.word_hashes(data, begins, ends)
        d = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (d[1:] == d[:-1])
        add(_KINDS + again.astype(np.int64), d)
        add(_word_slots(word), d)
    return _scaled(counts.reshape(n, TERMS), size)


def long_term_counts(data: np.ndarray, step: int = wordhash.STEP) -> np.ndarray:
    """What term_counts gives for one long text, which is read `step` bytes at a time."""
    counts = np.zeros(TERMS, np.int64)
    add = lambda term: np.add(counts, np.bincount(term, minlength=TERMS), out=counts)
    runs, last = np.zeros(0, np.uint32), None  # the last two kinds in turn, and the last byte's
    for at in range(0, len(data), step):
        kind = KINDS[data[at : at + step]]
        add(kind.astype(np.int64))
        turn = np.ones(len(kind), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[0] = kind[0] != last
        fresh, last = kind[turn].astype(np.uint32), kind[-1]
        for width in (2, 3):
            k = np.concatenate([runs[len(runs) - min(len(runs), width - 1) :], fresh])
            if len(k) >= width:
                add(_slots(k, width))
        runs = np.concatenate([runs, fresh])[-2:]
    before = None
    for word in wordhash.word_stream(data, step):
        if len(word):
            again = np.concatenate([[before is not None and word[0] == before], word[1:] == word[:-1]])
            add(_KINDS + again.astype(np.int64))
            add(_word_slots(word))
            before = word[-1]
    return _scaled(counts[None], np.array([len(data)]))


class Voters:
    """Labelled vectors and the projection that made them."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        n = len(terms)
        seen = (terms > 0).sum(0)
        weight = np.log((1 + n) / (1 + seen)) + 0.2
        centre = (terms * weight).mean(0) if n else np.zeros(TERMS)
        x = terms * weight - centre
        values, vectors = np.linalg.eigh(x.T @ x) if n else (np.zeros(TERMS), np.eye(TERMS))
        self.basis = (weight[:, None] * vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
        self.centre = (centre @ vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
        self.vectors = self._unit(terms.astype(np.float32))
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 0.5

    def _unit(self, terms: np.ndarray) -> np.ndarray:
        v = terms @ self.basis - self.centre
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.where((size > 0) & (terms.any(1))[:, None], v / np.maximum(size, 1e-12), 0).astype(np.float32)

    def score(self, terms: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), self.prior)
        if not len(self.labels):
            return out
        unit = self._unit(terms)
        k = min(NEIGHBOURS, len(self.labels))
        for b in range(0, len(unit), BLOCK):
            cosine = unit[b : b + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            out[b : b + BLOCK] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Voters:
    """Voters from labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.distinct()
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * sample_per_class rows at most
    # of rows that repeat an id one is learnt from for each label, the first by its text's hash, so that the sample keeps its bound
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    least = texts.groupBy("doc_id", "label").agg(F.min(F.xxhash64("text")).alias("hash"))
    texts = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(least), ["doc_id", "label", "hash"]).dropDuplicates(["doc_id", "label"]).select("doc_id", "text", "label")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", wordhash.STEP):
                x = term_counts(*string_buffers(part.column(1)))
                i, j = np.nonzero(x)
                ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(x)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (j.astype(np.int16), x[i, j])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["doc_id", "label", "term", "value"])

    got = texts.mapInArrow(terms, "doc_id long, label int, term array<short>, value array<float>").toArrow()
    order = np.lexsort((np.asarray(got["label"]), np.asarray(got["doc_id"]))) if got.num_rows else np.zeros(0, np.int64)
    got = got.take(pa.array(order)) if got.num_rows else got
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for r, (t, v) in enumerate(zip(got["term"], got["value"], strict=True)):
        x[r, np.asarray(t.values)] = np.asarray(v.values)
    return Voters(x, np.asarray(got["label"], dtype=np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", wordhash.STEP):
                score = voters.value.score(term_counts(*string_buffers(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of docs, with all their columns, that score the threshold or more: filtered where they are read, so no text is shuffled."""
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels, sample_per_class))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names[at], wordhash.STEP):
                score = voters.value.score(term_counts(*string_buffers(part.column(at))))
                yield part.filter(pa.array(score >= threshold))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
