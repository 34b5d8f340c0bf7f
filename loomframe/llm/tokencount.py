"""Operator 8: token counts by batch encoding in Arrow functions that return lengths only.

A text is split before each run of white space. There no token of a byte-level vocabulary crosses: the pattern
of words lets white space begin a word, never end one, and added tokens hold none, so the counts of the pieces
add up to the count of the whole text, however long. A piece of more than LONG_PIECE bytes, of a script without
spaces say, is split as well where letters or digits end and something else begins, which ends a word too. Pieces
are made distinct per slice, pieces met for the first time are encoded by the library in batches of about
BATCH_BYTES, and a bounded table keeps the counts that a worker has already.

Defined results: a null or empty text has no bytes and no tokens; a text of just the limit is not over it; an
empty table gives no rows; repeated rows are each counted; ids may be null; a very long run of letters without end
is encoded by the library at once; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.arrowtext import segment_sums, slices, string_array, string_buffers

#: Bytes that one call of the library encodes.
BATCH_BYTES = 1 << 18
#: Pieces whose counts a worker remembers, and the longest of them in bytes.
CACHE_PIECES = 500_000
CACHE_PIECE_BYTES = 48

#: Bytes of a piece beyond which it is split within, and where: after letters before what is none, after digits before what is none. An
#: apostrophe may take letters after it into its word, so nothing is split after one.
LONG_PIECE = 1 << 16
WORD_END = regex.compile(r"(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])")
#: White space for every library.
_SURE = np.zeros(256, bool)
_SURE[[0x09, 0x0A, 0x0D, 0x20]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, of one byte or of several."""
    white = _WHITE[data]
    if len(data) < 2:
        return white
    for at in (np.flatnonzero(data[:-1] == 0xC2),):
        at = at[np.isin(data[at + 1], (0x85, 0xA0))]
        white[at] = white[at + 1] = True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(at):
        code = (data[at].astype(np.int64) & 0xF) << 12 | (data[at + 1].astype(np.int64) & 0x3F) << 6 | (data[at + 2] & 0x3F)
        at = at[((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
        white[at] = white[at + 1] = white[at + 2] = True
    return white


def safe_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin; each text begins one, and no other piece is empty."""
    white = white_bytes(data)
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[1:] = (data[1:] <= 0x20) & _SURE[data[1:]] & ~white[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _long(self, piece: str) -> int:
        """Tokens of a long piece, in parts of about BATCH_BYTES characters that end where a word does; a special string is not parted."""
        total = begin = 0
        held = [m.span() for m in self.special.finditer(piece)] if self.special else []
        at = begin + BATCH_BYTES
        while at < len(piece):
            m = WORD_END.search(piece, at)
            if not m:
                break
            at = m.start() + 1
            if any(a < m.start() < b for a, b in held):
                continue
            total += self._lengths([piece[begin : m.start()]])[0]
            begin, at = m.start(), m.start() + BATCH_BYTES
        return total + self._lengths([piece[begin:]])[0]

    def _encode(self, pieces: list[str], sizes: list[int]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for p, n in zip(pieces, sizes, strict=True):
            if size + n >= BATCH_BYTES and batch:
                out += self._lengths(batch)
                batch, size = [], 0
            if n > LONG_PIECE:
                out += self._lengths(batch)
                batch, size = [], 0
                out.append(self._long(p))
            else:
                batch.append(p)
                size += n + 8
        return out + self._lengths(batch)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        begins = safe_pieces(data, offsets)
        if not len(begins):
            return np.zeros(len(offsets) - 1, np.int64)
        coded = string_array(data, np.append(begins, len(data))).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        known = [self.cache.get(p) for p in pieces]
        fresh = [i for i, x in enumerate(known) if x is None]
        sizes = np.diff(string_buffers(coded.dictionary)[1])[fresh].tolist() if fresh else []
        for i, n in zip(fresh, self._encode([pieces[i] for i in fresh], sizes), strict=True):
            known[i] = n
            if len(self.cache) < CACHE_PIECES and len(pieces[i]) <= CACHE_PIECE_BYTES:
                self.cache[pieces[i]] = n
        each = np.array(known, np.int64)[np.asarray(coded.indices)]
        return segment_sums(each, np.searchsorted(begins, offsets, "left"))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. No shuffle; a worker holds one slice of a batch."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = string_buffers(part.column(1))
                n = c.count(data, off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
