"""Operator 9: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. The leaf of a symbol holds (rank of the pair that it forms with its right
neighbour, position); every inner node holds the least leaf below it, so the root names the leftmost pair
of lowest rank. A merge changes three leaves (the merged symbol, its left neighbour and the symbol that
went), each repaired along one path of logarithmic length, until the root holds no pair.

The trees of many distinct words stand beside each other in arrays and take their steps together; a word
longer than LONG_WORD takes the same steps alone. Each distinct word of a batch is encoded once, and a bounded
table keeps the ids of words already seen by the worker.

A long text is encoded piece by piece, cut before white space, and its digests are carried along; a single
word without end is one tree, of about 30 bytes for each of its own. Letters, digits and forms of characters are
those of this Python's Unicode; characters that it does not know, and marks that are not in normal order, are
decided by the library's normalizer and splitter, whose tables are of other versions.

Defined results: a null or empty text has no ids, the decoded text of no ids is empty; an empty table gives no
rows; ties of rank go to the leftmost pair; repeated rows are each encoded; ids may be null; columns other than the
id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.arrowtext import segment_sums, slices, spans_gather, string_array, string_buffers, white_pieces

#: Words of more symbols than this walk their tree one at a time.
LONG_WORD = 256
#: Words whose ids a worker remembers, and the longest word that it remembers, in bytes.
CACHE_WORDS = 250_000
CACHE_WORD_BYTES = 48
#: Bytes of text encoded and decoded at once; indices of their bytes take eight times that.
SLICE_BYTES = 2 << 20
#: Words that share one set of tree arrays.
GROUP_WORDS = 8_192

NONE = np.int32(2**31 - 1)
#: The word pattern of the vocabulary file (its endings as bytes in ENDINGS), and white space as Unicode lists it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = [(ord("s"), 0), (ord("t"), 0), (ord("r"), ord("e")), (ord("v"), ord("e")), (ord("m"), 0), (ord("l"), ord("l")), (ord("d"), 0)]
SPACE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, LETTER, DIGIT, OTHER, INSIDE, UNKNOWN = range(6)


@lru_cache(maxsize=1)
def unicode_kinds() -> np.ndarray:
    """The kind of every code point that this Python knows; of others (unassigned here, but perhaps not in the library) UNKNOWN."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    group = {"L": LETTER, "N": DIGIT}
    for p in range(0x110000):
        category = unicodedata.category(chr(p))
        if category == "Cn":
            kinds[p] = UNKNOWN
        elif category[0] in group:
            kinds[p] = group[category[0]]
    kinds[SPACE_POINTS] = SPACE
    return kinds


def lead_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters beyond ASCII begin in UTF-8, their bytes and their code points."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int64)
    size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
    point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
    return lead, size, point


def _ascii_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for p in range(128):
        c = chr(p)
        kinds[p] = SPACE if p in SPACE_POINTS else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return kinds


ASCII_KINDS = _ascii_kinds()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBpe:
    """The vocabulary of a tokenizer file whose words end in a suffix, and the kernels over it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # its normalizer and word splitter decide on what differs between versions of Unicode; it encodes nothing here
        self.library = Tokenizer.from_file(path)
        self.found_kinds: dict[int, int] = {}
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"{path}: not the word pattern that is built in here")
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int32)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])
        self.pairs = pairs
        order = sorted(pairs)
        self.codes = np.array(order, np.int64)
        self.ranks = np.array([pairs[c][0] for c in order], np.int32)
        self.merged = np.array([pairs[c][1] for c in order], np.int32)
        # open addressing: a slot of a power-of-two table, linear probes
        self.bits = 18
        table = np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(self.codes)
        probes = 0
        todo = np.arange(len(self.codes))
        while len(todo):
            at = (slot[todo] + probes) & (len(table) - 1)
            free = table[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            table[at[first]] = todo[first]
            todo = np.delete(todo, first)
            probes += 1
        self.table, self.probes = table, probes
        tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = t
        self.tokens = tokens
        blob = [f"{t} ".encode() for t in tokens]
        self.token_bytes = np.frombuffer(b"".join(blob), np.uint8)
        self.token_len = np.array([len(x) for x in blob], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.cache: dict[bytes, bytes] = {}
        self._by_rank = np.zeros(int(self.ranks.max()) + 1, np.int32)
        self._by_rank[self.ranks] = self.merged

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, -1 if it has none."""
        code = left.astype(np.int64) * self.size + right
        at = self._slot(code)
        found = np.full(len(code), -1, np.int64)
        todo = np.arange(len(code))
        for _ in range(self.probes):
            k = self.table[at[todo]]
            hit = (k >= 0) & (self.codes[k] == code[todo])
            found[todo[hit]] = k[hit]
            todo = todo[~hit & (k >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
        return found

    # -- merging ---------------------------------------------------------------------------------------------

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte ranges: all ids in order, and the number of each word."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > LONG_WORD:
                for r in rows:
                    ids = self._merge_long(data[starts[r] : starts[r] + lengths[r]])
                    counts[r] = len(ids)
                    parts.append((np.array([r]), ids))
                continue
            step = max(256, GROUP_WORDS * 16 // int(w))
            for g in range(0, len(rows), step):
                some = rows[g : g + step]
                ids, n = self._merge_group(data, starts[some], lengths[some], int(w))
                counts[some] = n
                parts.append((some, ids))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(begin[-1]), np.int64)
        for rows, ids in parts:
            out[spans_gather(begin[rows], counts[rows])] = ids
        return out, counts

    def _merge_group(self, data, starts, lengths, w):
        n = len(starts)
        col = np.arange(w)
        there = col < lengths[:, None]
        at = np.minimum(starts[:, None] + col, max(len(data) - 1, 0))
        raw = data[at]
        sym = np.where(there, self.inner[raw], np.int32(-1))
        rows = np.arange(n)
        sym[rows, lengths - 1] = self.last[raw[rows, lengths - 1]]
        # links between living symbols; column w stands for "none"
        right = np.where(col + 1 < lengths[:, None], col + 1, w).astype(np.int32)
        left = np.broadcast_to(col - 1, (n, w)).astype(np.int32)
        tree = np.full((n, 2 * w), NONE, np.int32)
        pair = (col + 1) < lengths[:, None]
        i, j = np.nonzero(pair)
        k = self.lookup(sym[i, j], sym[i, j + 1])
        ok = k >= 0
        tree[i[ok], w + j[ok]] = self.ranks[k[ok]] * w + j[ok]
        level = w
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        sym, right, left, flat = sym.ravel(), right.ravel(), left.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = flat[live * 2 * w + 1]
            pos = root % w
            base = live * w
            gone = right[base + pos]
            sym[base + pos] = self._by_rank[root // w]
            after = right[base + gone]
            sym[base + gone] = -1
            right[base + pos] = after
            has = after < w
            left[(base + after)[has]] = pos[has]
            tops = live * 2 * w
            flat[tops + w + gone] = NONE
            key = np.full(len(live), NONE, np.int32)
            if has.any():
                k = self.lookup(sym[(base + pos)[has]], sym[(base + after)[has]])
                key[has] = np.where(k >= 0, self.ranks[k] * w + pos[has], NONE)
            flat[tops + w + pos] = key
            before = left[base + pos]
            had = before >= 0
            if had.any():
                b, p = base[had], before[had]
                k = self.lookup(sym[b + p], sym[b + pos[had]])
                flat[tops[had] + w + p] = np.where(k >= 0, self.ranks[k] * w + p, NONE)
            # the paths of the three leaves; where a path is not needed it repeats another
            at = np.concatenate([pos, gone, np.where(had, before, pos)]) + w
            top = np.concatenate([tops, tops, tops])
            level = w
            while level > 1:
                at >>= 1
                two = top + 2 * at
                flat[top + at] = np.minimum(flat[two], flat[two + 1])
                level >>= 1
            live = live[flat[tops + 1] < NONE]
        sym = sym.reshape(n, w)
        alive = sym >= 0
        return sym[alive], alive.sum(1)

    def _merge_long(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        sym = array("i", self.inner[raw].tobytes())
        sym[-1] = int(self.last[raw[-1]])
        w = 1 << (n - 1).bit_length()
        pairs, size = self.pairs, self.size
        none = len(self._by_rank) * w  # above every key, which are not of 32 bits here
        right, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        right[-1] = -1
        tree = array("q", [none]) * (2 * w)

        def key(p: int) -> int:
            r = right[p]
            hit = pairs.get(sym[p] * size + sym[r]) if r >= 0 else None
            return none if hit is None else hit[0] * w + p

        for p in range(n - 1):
            tree[w + p] = key(p)
        for i in range(w - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while tree[1] != none:
            p = tree[1] % w
            g = right[p]
            sym[p] = pairs[sym[p] * size + sym[g]][1]
            sym[g] = -1
            right[p] = right[g]
            if right[p] >= 0:
                left[right[p]] = p
            changed = [(g, none), (p, key(p))]
            if left[p] >= 0:
                changed.append((left[p], key(left[p])))
            for leaf, value in changed:
                i = w + leaf
                tree[i] = value
                i >>= 1
                while i:
                    a, b = tree[2 * i], tree[2 * i + 1]
                    least = a if a < b else b
                    if tree[i] == least:
                        break
                    tree[i] = least
                    i >>= 1
        return np.array([s for s in sym if s >= 0], np.int64)

    # -- texts -----------------------------------------------------------------------------------------------

    def normalize(self, text: str) -> str:
        """As the file's normalizer: NFC, white space to spaces, lower case by character. Runs of spaces stay: they end words all the same."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):  # the library's tables of marks are of another version
                return self.library.normalizer.normalize_str(text)
            if "\u03a3" in text:  # str.lower() would take the word's end into account
                text = text.replace("\u03a3", "\u03c3")
        return text.lower()

    def _kind(self, point: int) -> int:
        """The kind that the library gives a code point, seen from how it splits it between a letter and a mark."""
        if point not in self.found_kinds:
            spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(point)}!")]
            self.found_kinds[point] = LETTER if spans[0] == (0, 2) else DIGIT if len(spans) == 3 else OTHER if spans[-1] == (1, 3) else SPACE
        return self.found_kinds[point]

    def _normalized(self, parts: list[str]) -> list[bytes]:
        """Normalized UTF-8 of each part; what holds characters that this Python does not know is left to the library."""
        blob = [self.normalize(p).encode() for p in parts]
        data = np.frombuffer(b"".join(blob), np.uint8)
        lead, _, point = lead_points(data)
        if len(lead):
            strange = lead[unicode_kinds()[point] == UNKNOWN]
            if len(strange):
                ends = np.cumsum(np.fromiter(map(len, blob), np.int64, len(blob)))
                for i in np.unique(np.searchsorted(ends, strange, "right")).tolist():
                    blob[i] = self.library.normalizer.normalize_str(parts[i]).encode()
        return blob

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words in normalized UTF-8 (contractions, runs of letters, single digits, runs of other characters): begins, ends, all their bytes."""
        kind = ASCII_KINDS[data]
        lead, size, point = lead_points(data)
        if len(lead):
            found = unicode_kinds()[point]
            strange = found == UNKNOWN
            if strange.any():
                found[strange] = [self._kind(p) for p in point[strange].tolist()]
            kind[lead] = found
            for k in range(1, 4):
                more = size > k
                kind[lead[more] + k] = np.where(found[more] == DIGIT, INSIDE, found[more])
        begin = np.empty(len(kind) + 1, bool)
        begin[0] = begin[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:-1])
        begin[:-1] |= kind == DIGIT
        begin[:-1] &= kind != INSIDE
        mark = np.flatnonzero(data == 39)
        if len(mark):  # an apostrophe that begins a run, before one of the endings below
            mark = mark[begin[mark]]
            pad = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = pad[mark + 1], pad[np.minimum(mark + 2, len(pad) - 1)]
            for a, b in ENDINGS:
                if b:
                    hit = (one == a) & (two == b)
                    end = mark[hit] + 3
                else:
                    hit = one == a
                    end = mark[hit] + 2
                begin[mark[hit] + 1] = False
                begin[end] = True
        at = np.flatnonzero(begin)
        start, end = at[:-1], at[1:]
        keep = kind[start] != SPACE
        return start[keep], end[keep], data[kind != SPACE]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids in order, and the number of each."""
        keys = words.cast(pa.large_binary()).to_pylist()
        cache = self.cache
        known = [cache.get(k) for k in keys]
        fresh = [i for i, x in enumerate(known) if x is None]
        if fresh:
            data, off = string_buffers(words)
            at = np.array(fresh)
            ids, count = self.merge_words(data, off[at], off[at + 1] - off[at])
            ends = (4 * np.cumsum(count)).tolist()
            raw, begin, room = ids.astype("<u4").tobytes(), 0, CACHE_WORDS - len(cache)
            for i, end in zip(fresh, ends, strict=True):
                known[i] = got = raw[begin:end]
                begin = end
                if room > 0 and len(keys[i]) <= CACHE_WORD_BYTES:
                    cache[keys[i]] = got
                    room -= 1
        return np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) >> 2

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: all ids (unsigned 32 bit) in order, and offsets of length n + 1."""
        parts: list[str] = []
        owner: list[int] = []
        marks: list[tuple[int, int]] = []  # (index among the parts, special id)
        special = self.special_pattern
        first = sorted({s[:2] for s in self.special})
        for i, t in enumerate(texts):
            if not t:
                continue
            if special and any(c in t for c in first) and special.search(t):
                at = 0
                for m in special.finditer(t):
                    if m.start() > at:
                        parts.append(t[at : m.start()])
                        owner.append(i)
                    marks.append((len(parts), self.special[m[0]]))
                    parts.append("")
                    owner.append(i)
                    at = m.end()
                if at < len(t):
                    parts.append(t[at:])
                    owner.append(i)
            else:
                parts.append(t)
                owner.append(i)
        blob = self._normalized(parts)
        if not blob:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(b" ".join(blob) + b" ", np.uint8)
        start, end, bare = self.words(data)
        size = np.fromiter(map(len, blob), np.int64, len(blob)) + 1
        length = end - start
        if len(start):
            off = np.concatenate([[0], np.cumsum(length)])
            coded = string_array(bare, off).dictionary_encode()
            codes = np.asarray(coded.indices)
            ids, count = self._word_ids(coded.dictionary)
            begin = np.cumsum(count) - count
            each = count[codes]
            out = ids[spans_gather(begin[codes], each)]
        else:
            each, out = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        per_part = segment_sums(each, np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]), "left"))
        if marks:
            at = np.array([m[0] for m in marks])
            where = np.concatenate([[0], np.cumsum(per_part)])[at]
            out = np.insert(out, where, np.array([m[1] for m in marks], np.uint32))
            per_part[at] += 1
        per_text = np.bincount(np.array(owner, np.int64), weights=per_part, minlength=len(texts)).astype(np.int64)
        return out.astype(np.uint32, copy=False), np.concatenate([[0], np.cumsum(per_text)])

    def encode_pieces(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of one long text (UTF-8), piece by piece: pieces begin at white space, which no word and no special string crosses."""
        for piece in white_pieces(raw, SLICE_BYTES):
            yield self.encode([piece.tobytes().decode()])[0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text joined by a space: bytes and (begin, end) of each text in them."""
        size = self.token_len[ids]
        data = self.token_bytes[spans_gather(self.token_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        begin, end = ends[offsets[:-1]], ends[offsets[1:]]
        return data, np.stack([begin, np.maximum(begin, end - 1)], 1)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def long_digest(bpe: WordBpe, part: pa.RecordBatch) -> pa.RecordBatch:
    """The row of one long text, of which no more than a piece is held in any other form."""
    n, of_ids, of_text, begun = 0, hashlib.sha256(), hashlib.sha256(), False
    for ids in bpe.encode_pieces(string_buffers(part.column(1))[0]):
        if len(ids):
            text, spans = bpe.decode(ids, np.array([0, len(ids)]))
            of_text.update((b" " if begun else b"") + text[spans[0, 0] : spans[0, 1]].tobytes())
            of_ids.update(ids.astype("<u4").tobytes())
            n, begun = n + len(ids), True
    return pa.RecordBatch.from_arrays([part.column(0), pa.array([n]), pa.array([of_ids.hexdigest()]), pa.array([of_text.hexdigest()])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Token ids and decoded text of each row, as digests, or with keep_ids as columns `ids` and `decoded` too.

    No shuffle: each row is encoded where it is read. A worker holds one slice of a batch and the bounded
    table of words.
    """
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if part.num_rows == 1 and part.nbytes > 2 * SLICE_BYTES and not keep_ids:
                    yield long_digest(bpe, part)
                    continue
                ids, off = bpe.encode(part.column(1).to_pylist())
                text, spans = bpe.decode(ids, off)
                raw, blob = ids.astype("<u4").tobytes(), text.tobytes()
                cols = [
                    part.column(0),
                    pa.array(np.diff(off)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]),
                    pa.array([hashlib.sha256(blob[a:b]).hexdigest() for a, b in spans.tolist()]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.ListArray.from_arrays(off.astype(np.int32), ids.astype(np.int32)), pa.array([blob[a:b].decode() for a, b in spans.tolist()])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
