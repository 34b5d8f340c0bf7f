"""Operator 10: media columns in FLAC. Texts as 8-bit samples are encoded, decoded, verified and described.

A stream holds STREAMINFO with the MD5 of its samples, a SEEKTABLE with one point for each frame, and frames
of BLOCK samples (the last may be shorter): constant, verbatim, or a fixed linear predictor of order 0 to 4
with Rice-coded residuals, whichever is shortest. A header ends in its CRC-8, a frame in its CRC-16.

The decoder takes the frames of many streams in step: each step reads the next Rice code of every frame
(leading zeros by table, then the low bits), a block of codes is unfolded, and the predictor is undone by
cumulative sums. It checks both checksums of each frame, the sample counts and the MD5, and raises on any
difference. PCM blocks come with the offset of their first sample; read_block() seeks one by the SEEKTABLE.

Defined results: a null or empty text is a payload of 64 zero bytes; a very long text is coded and read back some
frames at a time, and its stream held whole; equal texts have equal values; of predictors and Rice parameters that
cost the same the lower is taken; an empty table gives no rows; repeated rows are each coded; ids may be null; columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.arrowtext import segment_sums, slices, spans_gather, string_buffers

BLOCK = 4096
RATE = 44_100
#: Bytes of text whose bits are laid out at once, and frames that are decoded in step.
ENCODE_BYTES = 2 << 20
DECODE_FRAMES = 4096
#: Frames of a long text that are coded at a time.
LONG_FRAMES = 256
#: Fixed values of the format.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
MAX_ORDER = 4


@lru_cache(maxsize=1)
def crc8_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = ((b << 1) ^ CRC8_POLY) & 0xFF if b & 0x80 else b << 1
        out.append(b)
    return out


@lru_cache(maxsize=65_536)
def crc8(raw: bytes) -> int:
    table, c = crc8_table(), 0
    for b in raw:
        c = table[c ^ b]
    return c


@lru_cache(maxsize=1)
def crc16_table() -> np.ndarray:
    """The remainder of every two bytes."""
    c = np.arange(65_536, dtype=np.uint32)
    for _ in range(16):
        c = np.where(c & 0x8000, (c << 1) ^ CRC16_POLY, c << 1) & 0xFFFF
    return c.astype(np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of byte ranges, two bytes a step for all of them; an odd range is led by a zero byte, which changes nothing."""
    table = crc16_table()
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = starts[order] - (size & 1)
    steps = (size + 1) >> 1
    crc = np.zeros(len(order), np.uint16)
    live = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(steps) else 0), "left")
    odd = (size & 1).astype(bool)
    for i, n in enumerate(live.tolist()):
        at = begin[:n] + 2 * i
        high = data[at].astype(np.uint16)
        if not i:
            high[odd[:n]] = 0
        crc[:n] = table[crc[:n] ^ (high << 8 | data[at + 1])]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=65_536)
def frame_header(number: int, samples: int) -> bytes:
    if number < 0x80:
        coded = bytes([number])
    else:  # the number as UTF-8 would write it, up to 36 bits
        n = 2
        while number >= 1 << (5 * n + 1):
            n += 1
        coded = bytes([(0xFF00 >> n & 0xFF) | number >> 6 * (n - 1), *(0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1))])
    size, tail = (0xC, b"") if samples == BLOCK else (0x6, bytes([samples - 1])) if samples <= 256 else (0x7, struct.pack(">H", samples - 1))
    head = bytes([0xFF, 0xF8, size << 4, 0b0000_001_0]) + coded + tail
    return head + bytes([crc8(head)])


def _bits(size: int, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bytes in which each value (under 2 ** 32) ends before its bit; values don't overlap, so their sums are their union."""
    word, shift = (ends - 1) >> 5, (31 - ((ends - 1) & 31)).astype(np.uint64)
    wide = values.astype(np.uint64) << shift
    words = np.bincount(word, wide & np.uint64(0xFFFFFFFF), minlength=(size + 3) // 4)
    over = np.flatnonzero(wide >> np.uint64(32))
    if len(over):
        words += np.bincount(word[over] - 1, wide[over] >> np.uint64(32), minlength=len(words))
    return words.astype(">u4").view(np.uint8)[:size].copy()


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with zero bytes up to a positive multiple of 64, and their offsets."""
    size = np.diff(offsets)
    full = np.maximum(64, (size + 63) // 64 * 64)
    off = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(off[-1]), np.uint8)
    out[spans_gather(off[:-1], size)] = data
    return out, off


def _encode_frames(payload: np.ndarray, begin: np.ndarray, count: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames over consecutive samples, one after the other, and their sizes in bytes."""
    x = payload.astype(np.int16) - 128
    frame_of = np.repeat(np.arange(len(begin), dtype=np.int32), count)
    place = (np.arange(len(x)) - begin[frame_of]).astype(np.int16)

    # the order whose residuals are least
    best = np.full(len(begin), np.iinfo(np.int64).max)
    order = np.zeros(len(begin), np.int64)
    residual = x
    diff = x
    for o in range(MAX_ORDER + 1):
        if o:
            diff = np.diff(diff, prepend=diff[:1])
        size = np.abs(diff).astype(np.int32)
        for j in range(o):  # warm-up samples are not residuals
            size[np.minimum(begin + j, len(x) - 1)] = 8
        cost = np.add.reduceat(size, begin)
        better = (cost < best) & (count > o)
        order[better], best[better] = o, cost[better]
        if o and better.any():
            residual = np.where(better[frame_of], diff, residual)
    folded = (np.abs(residual).astype(np.uint16) << 1) - (residual < 0)
    coded = np.ones(len(x), bool)
    for j in range(int(order.max())):
        at = begin[order > j] + j
        coded[at], folded[at] = False, 0
    mean = np.add.reduceat(folded.astype(np.int32), begin) / np.maximum(count - order, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 1, 8)
    bits_of = np.stack([np.add.reduceat((folded >> k.astype(np.uint16)[frame_of]).astype(np.int32), begin) + (count - order) * (k + 1) for k in (guess - 1, guess)])
    rice = guess - 1 + bits_of.argmin(0)
    rice_bits = bits_of.min(0) + 8 + 8 * order + 10
    same = np.maximum.reduceat(x, begin) == np.minimum.reduceat(x, begin)
    kind = np.where(same, 0, np.where(rice_bits < 8 + 8 * count, 2, 1))
    body_bits = np.where(kind == 0, 16, np.where(kind == 1, 8 + 8 * count, rice_bits))

    heads = [frame_header(n, c) for n, c in zip(number.tolist(), count.tolist(), strict=True)]
    head_len = np.fromiter(map(len, heads), np.int64, len(heads))
    size = head_len + (body_bits + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(size)])
    body = at[:-1] + head_len  # a subframe begins at a byte, and so do its samples as they are
    pre = np.flatnonzero(kind == 2)
    code = np.flatnonzero(coded & (kind == 2)[frame_of])
    f, u = frame_of[code], folded[code]
    k = rice.astype(np.uint16)[f]
    ends = np.cumsum((u >> k).astype(np.int64) + 1 + k)
    first = np.searchsorted(f, pre, "left")
    slot = np.zeros(len(begin), np.int64)
    slot[pre] = (body[pre] + 1 + order[pre]) * 8 + 10 - np.concatenate([[0], ends])[first]
    # a code's zeros are there already: its one and its low bits end where it does
    out = _bits(int(at[-1]), np.concatenate([ends + slot[f], (body[pre] + 1 + order[pre]) * 8 + 10]), np.concatenate([(u & (1 << k) - 1) | 1 << k, rice[pre]]))
    out[body] = np.where(kind == 0, 0, np.where(kind == 1, 2, (8 + order) << 1))
    plain = np.where(kind == 0, 1, np.where(kind == 1, count, order))
    out[spans_gather(body + 1, plain)] = payload[spans_gather(begin, plain)] ^ 0x80
    out[spans_gather(at[:-1], head_len)] = np.frombuffer(b"".join(heads), np.uint8)
    check = crc16(out, at[:-1], size - 2)
    out[at[1:] - 2], out[at[1:] - 1] = check >> 8, check & 0xFF

    return out, size


def _head(total: int, sizes: np.ndarray, counts: np.ndarray, md5: bytes) -> bytes:
    """What stands before a stream's frames: its mark, STREAMINFO and SEEKTABLE."""
    info = struct.pack(">HH", max(16, int(counts[0])), max(16, int(counts[0]))) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + md5
    points = np.zeros(len(sizes), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
    points["sample"], points["byte"], points["count"] = np.arange(len(sizes)) * BLOCK, np.cumsum(sizes) - sizes, counts
    table = points.tobytes()
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload (of one byte at least)."""
    total = np.diff(offsets)
    frames = -(-total // BLOCK)
    stream = np.repeat(np.arange(len(total)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = offsets[stream] + number * BLOCK
    count = np.minimum(BLOCK, offsets[stream + 1] - begin)
    out, size = _encode_frames(payload, begin, count, number)
    raw, pcm, at = out.tobytes(), (payload ^ 0x80).tobytes(), np.concatenate([[0], np.cumsum(size)])
    streams, f = [], 0
    for i, n in enumerate(frames.tolist()):
        head = _head(int(total[i]), size[f : f + n], count[f : f + n], hashlib.md5(pcm[offsets[i] : offsets[i + 1]]).digest())
        streams.append(head + raw[at[f] : at[f + n]])
        f += n
    return streams


def encode_long(text: np.ndarray) -> bytes:
    """The stream of one long text's payload, as encode gives it, made LONG_FRAMES frames at a time."""
    total = max(64, -(-len(text) // 64) * 64)
    bodies, sizes, counts, md5 = [], [], [], hashlib.md5()
    for at in range(0, total, LONG_FRAMES * BLOCK):
        part = np.zeros(min(LONG_FRAMES * BLOCK, total - at), np.uint8)
        there = text[at : at + len(part)]
        part[: len(there)] = there
        begin = np.arange(0, len(part), BLOCK)
        count = np.minimum(BLOCK, len(part) - begin)
        out, size = _encode_frames(part, begin, count, at // BLOCK + np.arange(len(begin)))
        bodies.append(out.tobytes())
        sizes.append(size)
        counts.append(count)
        md5.update((part ^ 0x80).tobytes())
    return b"".join([_head(total, np.concatenate(sizes), np.concatenate(counts), md5.digest()), *bodies])


class FlacError(ValueError):
    """A stream that does not decode, or not to what its checksums say."""


def seek_points(media: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """Samples in all, where the frames begin, the MD5, and the points of the SEEKTABLE."""
    if media[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, total, md5, points = 4, False, -1, b"", None
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(block[10:18], "big") & (1 << 36) - 1, block[18:34]
            if block[12] & 0x0F or (int.from_bytes(block[10:18], "big") >> 36 & 31) != 7:
                raise FlacError("not one channel of 8-bit samples")
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("count", ">u2")]))
        at += 4 + size
    if total < 0 or points is None:
        raise FlacError("no STREAMINFO or no SEEKTABLE")
    return total, at, md5, points


@lru_cache(maxsize=1)
def _zeros16() -> np.ndarray:
    """Leading zeros of every 16-bit number."""
    out = np.full(65_536, 16, np.uint8)
    for z in range(15, -1, -1):
        out[1 << (15 - z) : 1 << (16 - z)] = z
    return out


def _frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Samples (signed) of frames in step. data ends in 8 spare bytes."""
    check = crc16(data, start, size)  # over its own checksum too: no remainder
    if check.any():
        raise FlacError("a frame's CRC-16 differs")
    head = np.empty(len(start), np.int64)
    for i, (s, n, c) in enumerate(zip(start.tolist(), number.tolist(), count.tolist(), strict=True)):
        want = frame_header(n, c)
        if data[s : s + len(want)].tobytes() != want:
            raise FlacError("a frame's header or its CRC-8 differs")
        head[i] = len(want)
    body = start + head
    kind = data[body] >> 1
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(start)
    for i in np.flatnonzero(kind == 0).tolist():
        out[i] = np.full(count[i], data[body[i] + 1].astype(np.int8), np.int16)
    for i in np.flatnonzero(kind == 1).tolist():
        out[i] = data[body[i] + 1 : body[i] + 1 + count[i]].view(np.int8).astype(np.int16)
    fixed = np.flatnonzero((kind >= 8) & (kind <= 8 + MAX_ORDER))
    if len(fixed) + int((kind < 2).sum()) != len(kind):
        raise FlacError("a kind of subframe that is not written here")
    if not len(fixed):
        return out
    order = kind[fixed].astype(np.int64) - 8
    left = count[fixed] - order
    rank = np.argsort(-left, kind="stable")
    fixed, order, left = fixed[rank], order[rank], left[rank]
    window = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    pos = (body[fixed] + 1 + order) * 8
    top = window[pos >> 3]
    if (top >> 26).any():
        raise FlacError("a residual coding that is not written here")
    k = (top >> 22 & 15).astype(np.int64)
    pos = pos + 10
    zeros, most = _zeros16(), int(left[0])
    codes = np.zeros((most, len(fixed)), np.uint16)
    live = np.searchsorted(-left, -np.arange(most), "left").tolist()
    spare, low = (32 - k).astype(np.uint32), k > 0
    for i, n in enumerate(live):
        p = pos[:n]
        x = window[p >> 3] << (p & 7).astype(np.uint32)
        q = zeros[x >> 16].astype(np.int64)
        if q.max() == 16:
            far = np.flatnonzero(q == 16)
            while len(far):
                at = p[far] + q[far]
                more = zeros[(window[at >> 3] << (at & 7).astype(np.uint32)) >> 16].astype(np.int64)
                q[far] += more
                far = far[more == 16]
        p += q
        p += 1
        x = window[p >> 3] << (p & 7).astype(np.uint32)
        codes[i, :n] = q << k[:n] | np.where(low[:n], x >> np.minimum(spare[:n], 31), 0)
        p += k[:n]
    if (pos > (start[fixed] + size[fixed] - 2) * 8).any() or (pos <= (start[fixed] + size[fixed] - 3) * 8).any():
        raise FlacError("residuals do not end where the frame does")
    table = codes.T
    for i, f in enumerate(fixed.tolist()):
        u, o = table[i, : left[i]], int(order[i])
        r = (u >> 1).astype(np.int16) ^ -(u & 1).astype(np.int16)
        if o:
            warm = data[body[f] + 1 : body[f] + 1 + o].view(np.int8).astype(np.int64)
            seeds = [np.diff(warm, n=j)[-1] for j in range(o)]
            r = r.astype(np.int64)
            for seed in reversed(seeds):
                r = np.cumsum(r) + seed
            r = np.concatenate([warm, r]).astype(np.int16)
        out[f] = r
    return out


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Payloads read back and their offsets; raises FlacError unless every checksum holds."""
    starts, sizes, numbers, counts, frames, totals, md5s = [], [], [], [], [], [], []
    base = 0
    for s in streams:
        total, first, md5, points = seek_points(s)
        begin = first + points["byte"].astype(np.int64)
        starts.append(base + begin)
        sizes.append(np.diff(np.append(begin, len(s))))
        numbers.append(points["sample"].astype(np.int64) // BLOCK)
        counts.append(points["count"].astype(np.int64))
        frames.append(len(points))
        totals.append(total)
        md5s.append(md5)
        base += len(s)
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    start, size, number, count = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (starts, sizes, numbers, counts))
    parts: list[np.ndarray] = [np.zeros(0, np.int16)] * len(start)
    by_size = np.argsort(-count, kind="stable")  # frames in step are about as long as each other
    for g in range(0, len(start), DECODE_FRAMES):
        some = by_size[g : g + DECODE_FRAMES]
        for i, x in zip(some.tolist(), _frames(data, start[some], size[some], number[some], count[some]), strict=True):
            parts[i] = x
    pcm = np.concatenate(parts).astype(np.int8).view(np.uint8) if parts else np.zeros(0, np.uint8)
    off = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    if off[-1] != len(pcm) or (segment_sums(count, np.concatenate([[0], np.cumsum(frames)])) != np.array(totals)).any():
        raise FlacError("a stream has not as many samples as it says")
    raw = pcm.tobytes()
    for i, md5 in enumerate(md5s):
        if hashlib.md5(raw[off[i] : off[i + 1]]).digest() != md5:
            raise FlacError("a stream's MD5 differs")
    return pcm ^ 0x80, off


def decode_long(media: bytes) -> Iterator[np.ndarray]:
    """The payload of one stream, LONG_FRAMES frames at a time; raises FlacError unless every checksum holds."""
    total, first, md5, points = seek_points(media)
    begin = first + points["byte"].astype(np.int64)
    size = np.diff(np.append(begin, len(media)))
    count = points["count"].astype(np.int64)
    if count.sum() != total:
        raise FlacError("a stream has not as many samples as it says")
    check = hashlib.md5()
    for g in range(0, len(points), LONG_FRAMES):
        some = slice(g, g + LONG_FRAMES)
        low, high = int(begin[some][0]), int(begin[some][-1] + size[some][-1])
        data = np.frombuffer(media[low:high] + bytes(8), np.uint8)
        pcm = np.concatenate(_frames(data, begin[some] - low, size[some], points["sample"][some].astype(np.int64) // BLOCK, count[some])).astype(np.int8).view(np.uint8)
        check.update(pcm.tobytes())
        yield pcm ^ 0x80
    if check.digest() != md5:
        raise FlacError("a stream's MD5 differs")


def read_block(media: bytes, sample: int) -> tuple[int, bytes]:
    """The PCM block that holds a sample: the offset of its first sample, and its bytes; only its frame is decoded."""
    total, first, _, points = seek_points(media)
    if not 0 <= sample < total:
        raise FlacError("no such sample")
    i = int(np.searchsorted(points["sample"].astype(np.int64), sample, "right")) - 1
    begin = first + int(points["byte"][i])
    end = first + int(points["byte"][i + 1]) if i + 1 < len(points) else len(media)
    data = np.frombuffer(media[begin:end] + bytes(8), np.uint8)
    block = _frames(data, np.array([0]), np.array([end - begin]), np.array([int(points["sample"][i]) // BLOCK]), np.array([int(points["count"][i])]))[0]
    return int(points["sample"][i]), (block.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def features(pcm: np.ndarray, off: np.ndarray) -> list[str]:
    """Samples, sum, energy, least, greatest and sign changes of each stream."""
    x = pcm.astype(np.int64) - 128
    begin = off[:-1]
    change = np.zeros(len(x), np.int64)
    change[1:] = (x[1:] < 0) != (x[:-1] < 0)
    change[begin] = 0
    cols = [np.diff(off), np.add.reduceat(x, begin), np.add.reduceat(x * x, begin), np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin), np.add.reduceat(change, begin)]
    return [f"n={n};sum={s};energy={e};min={a};max={b};crossings={c}" for n, s, e, a, b, c in zip(*(v.tolist() for v in cols), strict=True)]


def long_row(text: np.ndarray) -> tuple[bytes, list]:
    """The stream of one long text, and its payload's size, SHA-256, checksum of the last 64 bytes and features, read back part by part."""
    media = encode_long(text)
    sha, tail, n, total, energy, least, most, changes, before = hashlib.sha256(), b"", 0, 0, 0, 127, -128, 0, None
    for part in decode_long(media):
        sha.update(part.tobytes())
        tail = (tail + part[-64:].tobytes())[-64:]
        x = part.astype(np.int64) - 128
        below = x < 0
        changes += int((below[1:] != below[:-1]).sum()) + int(before is not None and before != bool(below[0]))
        before = bool(below[-1])
        n, total, energy, least, most = n + len(x), total + int(x.sum()), energy + int((x * x).sum()), min(least, int(x.min())), max(most, int(x.max()))
    return media, [n, sha.hexdigest(), zlib.crc32(tail), f"n={n};sum={total};energy={energy};min={least};max={most};crossings={changes}"]


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row for each input row with the digests of its stream; with keep_media also `media` and `blocks` (first sample, byte offset, samples). No shuffle."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if keep_media:
        schema += ", media binary, blocks array<struct<first_sample: bigint, byte_offset: bigint, samples: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", alone=2 * ENCODE_BYTES):
                size = np.diff(string_buffers(part.column(1))[1])
                if part.num_rows == 1 and size[0] > 2 * ENCODE_BYTES:
                    one, (n, sha, tail, feature) = long_row(string_buffers(part.column(1))[0])
                    media, found = [one], [[n], [sha], [tail], [feature]]
                else:
                    media = []
                    for piece in slices(part, "text", ENCODE_BYTES):
                        media += encode(*payloads(*string_buffers(piece.column(1))))
                    pcm, off = decode(media)
                    raw = pcm.tobytes()
                    spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                    found = [np.diff(off), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans], [zlib.crc32(raw[b - 64 : b]) for _, b in spans], features(pcm, off)]
                cols = [
                    part.column(0), pa.array(size), pa.array(found[0], pa.int64()), pa.array(found[1]), pa.array(found[2], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(found[3]),
                ]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                if keep_media:
                    blocks = [[{"first_sample": int(p["sample"]), "byte_offset": first + int(p["byte"]), "samples": int(p["count"])} for p in points] for _, first, _, points in map(seek_points, media)]
                    cols += [pa.array(media, pa.binary()), pa.array(blocks, pa.list_(pa.struct([("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32())])))]
                    names += ["media", "blocks"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
