"""Operator 4: n-gram Jaccard join by signature trees.

Documents are sets of hashes of word shingles. Rows with equal sets form a class, which is worked on once.

Routing. Under one order of all shingles (those outside a list of the most frequent ones first, by hash; then
those of the list, rarest first) two sets whose similarity reaches the threshold share a shingle among the
first n - ceil(t * n) + 1 of each. Classes that share such a shingle with another point to the least class of
that shingle, where bitmaps allow a link; connected components of these pointers are families, and no link leaves
a family. The order only has to be the same everywhere, so the list's bounded length costs no link. A shingle of
more than HOT classes is dealt out by pairs: two linked sets that first share it share a second one too, among one
more than they are routed by, and meet there. Classes that share such a pair with more than HOT others are joined
into a family as they are.

Trees. A family's classes, by size and signature, are leaves of a tree whose nodes hold the OR of their token
bitmaps, their range of sizes, and the least number of bits of a member. Two nodes are traversed together: a
pair is pruned when the sizes are too far apart, when the bits that the nodes can share leave too small an
overlap, or when all members are in one component already. Pairs of leaves are verified on their exact sets.
A family beyond BLOCK classes is worked on in blocks: every block with itself and with the first; then those
classes that are not in the largest component of the family with all blocks. Nothing else can hold a link.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer
words than a shingle has one shingle, all its words; a very long text is read in steps, and its set held whole; equal
rows are linked; rows with the same id but different texts are documents of their own; ids may repeat or be null (a
component of rows without ids has none either); a similarity of just the threshold is a link; an empty table gives
no rows; other columns are not read. Shingles and classes are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import wordhash
from loomframe.llm.arrowtext import slices, spans_gather, string_buffers
from loomframe.llm.components import components
from loomframe.llm.shared import Shared, membership, passes
from loomframe.llm.textcut import free_name

#: Shingles that come last in the order, as the most frequent; a bound on what is broadcast, not on what is linked.
FREQUENT = 65_536
#: Documents of one slice that must share a shingle for it to be counted as frequent.
FREQUENT_IN_SLICE = 3
SLICE_BYTES = wordhash.STEP
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Bits of a set's bitmap: a power of two, at least BITS_EACH times its shingles, within these bounds; a bitmap that travels with each routed
#: shingle has ROUTE_BITS at most, and from 90 % on one bit a shingle: of two unlike sets of as many shingles as bits, each has nearly a quarter of its
#: shingles apart, where linked ones have a nineteenth. Fewer bits rule out fewer pairs, and never one that is linked.
BITS_EACH, LEAST_BITS, ROUTE_BITS, MOST_BITS = 3, 512, 1 << 15, 1 << 17
#: Classes of a bucket that one task connects; a larger bucket is dealt out by pairs of shingles.
HOT = 2048
#: Stands for the second shingle of sets that can be linked by one alone.
SMALL = np.uint64(0x5851F42D4C957F2D)
FANOUT = 8
#: Pairs, and bytes of their bitmaps, compared at a time.
PAIRS, PAIR_BYTES = 1 << 16, 8 << 20
#: Bytes of the exact bit matrix of a block's shingles; beyond, sorted sets are intersected pair by pair.
MATRIX_BYTES = 32 << 20


def text_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = string_buffers(col)
    if len(off) == 2 and len(data) > 2 * SLICE_BYTES:
        yield wordhash.long_shingles(data, width)
        return
    begins, ends, first = wordhash.words(data, off)
    hashes, at = wordhash.shingle_hashes(wordhash.word_hashes(data, begins, ends), first, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def set_class(s: np.ndarray) -> int:
    """One number for a set."""
    with np.errstate(over="ignore"):
        return int(wordhash.mix(np.array([wordhash.mix(s).sum() + np.uint64(len(s))], np.uint64)).astype(np.int64)[0]) if len(s) else 0


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set by which it is routed, in order, and one more if there is one."""
    n = len(s)
    k = routes(n, percent) + 1
    key = s >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent["hash"], s), len(frequent) - 1)
        key = np.where(frequent["hash"][at] == s, np.uint64(1 << 63) + frequent["rank"][at], key)
    return s[np.argsort(key, kind="stable")[:k]]


def routes(n, percent: int):
    """How many shingles of a set of n are routed: of so many, two sets that are linked share one."""
    return n - -(-percent * n // 100) + 1


def bit_matrix(row: np.ndarray, col: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, -(-width // 64)), np.uint64)
    col = col.astype(np.int64)
    np.bitwise_or.at(out, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    return out


def width_of(n: int, most: int = MOST_BITS, each: int = BITS_EACH) -> int:
    return min(most, max(LEAST_BITS, 1 << (each * n - 1).bit_length() if n else LEAST_BITS))


def route_width(n: int, percent: int) -> int:
    """Bits of the bitmap that travels with each routed shingle of a set of n."""
    return width_of(n, ROUTE_BITS, 1 if percent >= 90 else BITS_EACH)


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """The residues of a set's shingles by the width, as words of 64 bits."""
    out = np.zeros(width, np.uint8)
    out[((s >> np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Wider bitmaps as bitmaps of fewer words: residues by the smaller width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def at_once(bits: np.ndarray) -> int:
    """Pairs of such bitmaps to compare at a time."""
    return max(64, min(PAIRS, PAIR_BYTES // (8 * bits.shape[1])))


# -- trees -------------------------------------------------------------------------------------------------------


class Signatures:
    """Sizes, bitmaps and components so far of some classes. Two may be linked if sizes and bitmaps allow it."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, percent: int):
        self.size, self.bits, self.percent = size, bits, percent
        self.count = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.root = np.arange(len(size))

    def find(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root[i]
            self.root = up

    def head(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def join(self, i: int, j: int, links: list[tuple[int, int]]) -> None:
        """Notes a link if its ends are not connected yet."""
        a, b = self.head(i), self.head(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            links.append((i, j))

    def enough(self, overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether 100 * overlap >= percent * union."""
        return (100 + self.percent) * overlap >= self.percent * (size_a + size_b)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Each bit of one that the other has not is a shingle that they do not share."""
        na, nb = self.size[i], self.size[j]
        common = np.bitwise_count(self.bits[i] & self.bits[j]).sum(1).astype(np.int64)
        return self.enough(np.minimum(na - (self.count[i] - common), nb - (self.count[j] - common)), na, nb)

    def verify(self, a: np.ndarray, b: np.ndarray, links: list[tuple[int, int]]) -> None:
        """Links among pairs of members; pairs that are connected by now are passed over."""
        step = at_once(self.bits)
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            apart = self.find(i) != self.find(j)
            i, j = i[apart], j[apart]
            keep = self.possible(i, j)
            self._links(i[keep], j[keep], links)

    def _links(self, i: np.ndarray, j: np.ndarray, links: list[tuple[int, int]]) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            self.join(x, y, links)


class Sets(Signatures):
    """Classes with their exact sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets = sets
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(sets)), size)
        width = width_of(int(size.max(initial=0)))
        super().__init__(size, np.stack([bitmap(s, width) for s in sets]) if sets else np.zeros((0, 1), np.uint64), percent)
        universe = np.unique(flat)
        self.exact = bit_matrix(row, np.searchsorted(universe, flat), len(universe), len(sets)) if len(sets) * len(universe) <= 8 * MATRIX_BYTES else None

    def _links(self, i: np.ndarray, j: np.ndarray, links: list[tuple[int, int]]) -> None:
        if not len(i):
            return
        if self.exact is None:
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if self.head(x) != self.head(y) and self.enough(len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)), self.size[x], self.size[y]):
                    self.join(x, y, links)
            return
        step = at_once(self.exact)
        overlap = np.concatenate([np.bitwise_count(self.exact[i[k : k + step]] & self.exact[j[k : k + step]]).sum(1).astype(np.int64) for k in range(0, len(i), step)])
        hit = self.enough(overlap, self.size[i], self.size[j])
        super()._links(i[hit], j[hit], links)


class Tree:
    """Nodes over members in order: for each level the first and last member, OR of bitmaps, sizes, least bits."""

    def __init__(self, sets: Signatures, members: np.ndarray):
        least_bit = sets.bits[members].argmax(1)
        self.members = members[np.lexsort((members, sets.count[members], least_bit, sets.size[members]))]
        bits, size, count = sets.bits[self.members], sets.size[self.members], sets.count[self.members]
        self.levels = [(bits, size, size, count)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, c = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(c, at)))

    def one_component(self, sets: Signatures, level: int) -> np.ndarray:
        """The component of the members of each node of a level, -1 if they have several."""
        root = sets.find(self.members)
        at = np.arange(0, len(root), FANOUT**level)
        low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
        return np.where(low == high, low, -1)


def tree_links(sets: Signatures, left: np.ndarray, right: np.ndarray | None, links: list[tuple[int, int]]) -> None:
    """Traverses two trees together, or one with itself, and appends a spanning set of the links between their members."""
    if not len(left) or right is not None and not len(right):
        return
    x = Tree(sets, left)
    y = x if right is None else Tree(sets, right)
    # members that follow each other, and the first of all with each: these connect a family of copies at once
    if right is None:
        sets.verify(x.members[:-1], x.members[1:], links)
    sets.verify(np.full(len(y.members), x.members[0]), y.members, links) if right is not None else None
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    while True:
        bx, lowx, highx, cx = x.levels[lx]
        by, lowy, highy, cy = y.levels[ly]
        keep = np.ones(len(i), bool)
        step = at_once(bx)
        for at in range(0, len(i), step):
            s = slice(at, at + step)
            a, b = i[s], j[s]
            common = np.bitwise_count(bx[a] & by[b]).sum(1).astype(np.int64)
            # a member has cx bits at least, of which no more than `common` can be shared: each other bit is a shingle apart
            most_x = highx[a] - np.maximum(0, cx[a] - common)
            most_y = highy[b] - np.maximum(0, cy[b] - common)
            near = (100 * highx[a] >= sets.percent * lowy[b]) & (100 * highy[b] >= sets.percent * lowx[a])
            keep[s] = near & sets.enough(np.minimum(most_x, most_y), lowx[a], lowy[b])
        one_x, one_y = x.one_component(sets, lx), y.one_component(sets, ly)
        keep &= (one_x[i] < 0) | (one_x[i] != one_y[j])
        i, j = i[keep], j[keep]
        if not len(i):
            return
        if lx == ly == 0:
            a, b = x.members[i], y.members[j]
            keep = (a != b) if right is not None else i < j
            sets.verify(a[keep], b[keep], links)
            return
        down_x, down_y = lx > 0 and lx >= ly, ly > 0 and ly >= lx
        if down_x:
            lx -= 1
            n = len(x.levels[lx][0])
            i = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            j = np.repeat(j, FANOUT)
            i, j = i[i < n], j[i < n]
        if down_y:
            ly -= 1
            n = len(y.levels[ly][0])
            j = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            i = np.repeat(i, FANOUT)
            i, j = i[j < n], j[j < n]
        if right is None and lx == ly:
            i, j = i[i <= j], j[i <= j]


# -- tables ------------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each row (and text_hash, Spark's xxhash64 of the text): documents link when 100 * intersection >= percent * union of their shingle sets."""
    if not 1 <= percent <= 100 or width < 1:
        raise ValueError("percent is from 1 to 100, width at least 1")
    spark = df.sparkSession
    store = Shared(spark, "neardup")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = list(text_sets(part.column(1), width))
                if len(sets) >= FREQUENT_IN_SLICE:
                    h, n = np.unique(np.concatenate(sets), return_counts=True)
                    often = n >= FREQUENT_IN_SLICE
                    yield pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(n[often])], ["hash", "n"])

    top = docs.mapInArrow(frequencies, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    order = np.lexsort((np.asarray(top["hash"]), np.asarray(top["n"]))) if top.num_rows else np.zeros(0, np.int64)
    table = np.zeros(top.num_rows, [("hash", np.uint64), ("rank", np.uint64)])
    table["hash"], table["rank"] = np.asarray(top["hash"])[order].astype(np.uint64) if top.num_rows else 0, np.arange(top.num_rows)
    table.sort(order="hash")
    frequent = spark.sparkContext.broadcast(table)  # FREQUENT rows at most

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # a row's own number, the same when its partition is read again
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = list(text_sets(part.column(1), width))
                first = [prefix(s, frequent.value, percent) if len(s) else s for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32)
                flat = np.concatenate(first).astype(np.int64) if first else np.zeros(0, np.int64)
                bits = [bitmap(s, route_width(len(s), percent)).tobytes() for s in sets]
                cols = [part.column(0), pa.array(np.arange(number, number + len(sets))), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary()), part.column(2)], ["doc_id", "row", "n", "class", "prefix", "bits", "text_hash"])
                number += len(sets)

    whole, whole_path = store.write(hashed.mapInArrow(described, "doc_id long, row long, n long, class long, prefix array<long>, bits binary, text_hash long"))
    rows = store.cut(whole.select("doc_id", "n", "class", *(["text_hash"] if with_hash else [])))
    # a class is known by its first row, which alone is routed (rows of a class have equal sets)
    classes = store.cut(whole.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row")))
    heads, heads_path = store.write(whole.join(classes.select("class", "row"), ["class", "row"]).select("class", "n", "prefix", "bits"))
    store.drop(whole_path)

    def tokens(hot: bool, wanted):
        """Rows (class, token) of the routed shingles, or of the pairs of a hot one with each that follows it in the order, as far as `wanted` lets them through."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                name, size, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
                flat, ends = np.asarray(lists.flatten()).astype(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
                at, owner = np.arange(len(flat)), np.repeat(np.arange(len(name)), np.diff(ends))
                hit = at - ends[:-1][owner] < routes(size, percent)[owner]
                if wanted is not None:
                    hit &= passes(wanted.value, flat.view(np.int64))
                at, owner = at[hit], owner[hit]
                if not hot:
                    yield pa.RecordBatch.from_arrays([pa.array(name[owner]), pa.array(flat[at].astype(np.int64))], ["class", "token"])
                    continue
                after = ends[1:][owner] - at - 1
                for low in range(0, len(at), PAIRS):  # a set's hot shingles are few, what follows each is bounded by its routes
                    some = slice(low, low + PAIRS)
                    one = np.repeat(at[some], after[some])
                    two = spans_gather(at[some] + 1, after[some])
                    single = size[owner[some]] <= 100 // percent
                    with np.errstate(over="ignore"):
                        keys = np.concatenate([wordhash.mix(flat[one] * np.uint64(3) + flat[two]), wordhash.mix(flat[at[some][single]] * np.uint64(3) + SMALL)])
                    names = np.concatenate([np.repeat(name[owner[some]], after[some]), name[owner[some]][single]])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys.astype(np.int64))], ["class", "token"])

        return heads.select("class", "n", "prefix").mapInArrow(run, "class long, token long")

    def buckets_of(routed: DataFrame) -> DataFrame:
        """The tokens that several classes have, with their number; of tokens of the same classes one."""
        shared = routed.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("who")).filter("n > 1")
        return store.cut(shared.groupBy("n", "who").agg(F.min("token").alias("token")).select("token", "n"))

    def members_of(buckets: DataFrame, hot: bool, among=None) -> DataFrame:
        """Rows (class, token) of these buckets: filtered by a bounded bit set where they are made, then exactly."""
        if not hot:
            return tokens(False, membership(buckets, "token")).join(buckets.select("token"), "token", "left_semi")
        kept = membership(buckets, "token")

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(kept.value, np.asarray(batch.column(1)))))

        return tokens(True, among).mapInArrow(through, "class long, token long").join(buckets.select("token"), "token", "left_semi")

    buckets = buckets_of(tokens(False, None))
    members = members_of(buckets.filter(F.col("n") <= HOT), False)
    chained = None
    hot = buckets.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        # two linked sets whose first common shingle is hot share it and their second common one, among one more than is routed
        among = membership(hot, "token")
        paired = buckets_of(tokens(True, among))
        members = members.unionByName(members_of(paired.filter(F.col("n") <= HOT), True, among))
        # what many classes share twice is joined whole, without a look at bitmaps; the exact sets decide
        crowd = paired.filter(F.col("n") > HOT)
        if not crowd.isEmpty():
            crowded = members_of(crowd, True, among)
            least = crowded.groupBy("token").agg(F.min("class").alias("b"))
            chained = crowded.join(least, "token").select(F.col("class").alias("a"), "b").filter("a <> b").distinct()
    members, members_path = store.write(members)
    spots = members.join(heads.select("class", "n", "bits"), "class").repartition("token").sortWithinPartitions("token", "n", "class")
    doubled = (100 // percent - (100 % percent == 0)).bit_length()  # linked sets' widths are this many doublings apart at most

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning connections of each bucket; rows come sorted by bucket, a bucket (of HOT classes at most) may go on in the next batch."""

        def solved(t: pa.Table) -> pa.RecordBatch:
            token, name = np.asarray(t["token"]), np.asarray(t["class"])
            size, (raw, off) = np.asarray(t["n"]), string_buffers(t["bits"].combine_chunks())
            words = np.diff(off) // 8
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            ends = np.append(starts[1:], len(token))
            of = np.repeat(np.arange(len(starts)), ends - starts)
            links: list[tuple[int, int]] = []
            for w in np.unique(words).tolist():
                rows = np.flatnonzero((words >= w) & (words <= w << doubled))
                bits = np.stack([fold(raw[off[r] : off[r + 1]].view(np.uint64)[None], w)[0] for r in rows.tolist()])
                first = np.searchsorted(of[rows], np.arange(len(starts)), "left")
                count = np.searchsorted(of[rows], np.arange(len(starts)), "right") - first
                two = first[count == 2]
                found: list[tuple[int, int]] = []
                Signatures(size[rows], bits, percent).verify(two, two + 1, found)
                for a, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                    part: list[tuple[int, int]] = []
                    tree_links(Signatures(size[rows[a : a + n]], bits[a : a + n], percent), np.arange(n), None, part)
                    found += [(a + i, a + j) for i, j in part]
                links += [(int(rows[i]), int(rows[j])) for i, j in found]
            pair = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(name[pair[:, 0]]), pa.array(name[pair[:, 1]])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            token = np.asarray(batch.column(batch.schema.get_field_index("token")))
            if not len(token):
                continue
            begin = int(np.searchsorted(token != token[0], True)) if token[0] != token[-1] else len(token)
            last = int(len(token) - np.searchsorted(token[::-1] != token[-1], True)) if token[0] != token[-1] else 0
            if held and held[-1].column(held[-1].schema.get_field_index("token"))[-1].as_py() == token[0]:
                held.append(batch.slice(0, begin))
                if begin == len(token):
                    continue
            else:
                begin = 0
            if held:
                yield solved(pa.Table.from_batches(held))
            if last > begin:
                yield solved(pa.Table.from_batches([batch.slice(begin, last - begin)]))
            held = [batch.slice(max(last, begin))]
        if held:
            yield solved(pa.Table.from_batches(held))

    pointers = spots.mapInArrow(connect, "a long, b long").distinct()
    pointers = pointers if chained is None else pointers.unionByName(chained)
    families = store.cut(components(pointers, store).select(F.col("node").alias("class"), F.col("root").alias("family")))
    store.drop(members_path)
    sizes = store.cut(families.join(heads.select("class", "n"), "class").groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    store.drop(heads_path)

    # the sets of classes that share a family with another, from the texts: of rows whose id may be that of a class's first document
    wanted = families.join(classes, "class")
    by_id, by_class = membership(wanted, "first_id"), membership(wanted, "class")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            near = batch.filter(pa.array(passes(by_id.value, np.asarray(ids.fill_null(0))) | np.asarray(ids.is_null())))
            for part in slices(near, "text", SLICE_BYTES):
                sets = list(text_sets(part.column(1), width))
                name = np.array([set_class(s) for s in sets], np.int64)
                _, first = np.unique(name, return_index=True)
                keep = [k for k in first[passes(by_class.value, name[first])].tolist() if len(sets[k])]
                ends = np.concatenate([[0], np.cumsum([len(sets[k]) for k in keep])]).astype(np.int32)
                flat = np.concatenate([sets[k] for k in keep]).astype(np.int64) if keep else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["class", "shingles"])

    sets = docs.mapInArrow(with_sets, "class long, shingles array<long>").dropDuplicates(["class"])
    members = sets.join(families, "class").join(sizes, "family").withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks"))).cast("int"))
    members, members_path = store.write(members.select("family", "class", "shingles", "blocks", "block"))

    def solve(table: pa.Table) -> pa.Table:
        """One job: the members with themselves, and with the others that came along (side 1)."""
        side = np.asarray(table["side"])
        keys = np.asarray(table["class"])
        order = np.lexsort((keys, side))
        order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]  # a member on both sides
        table = table.take(pa.array(order))
        keys, side = keys[order], side[order]
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = np.asarray(lists.flatten()).astype(np.uint64), np.asarray(lists.offsets)
        ends = ends - ends[0]
        sets = Sets([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], percent)
        links: list[tuple[int, int]] = []
        mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        tree_links(sets, mine, None, links)
        tree_links(sets, others, mine, links)
        return pa.table({"a": pa.array([int(keys[i]) for i, _ in links], pa.int64()), "b": pa.array([int(keys[j]) for _, j in links], pa.int64())})

    job = members.select("family", F.col("block").alias("job"), "class", "shingles", F.lit(0).alias("side"))
    hubs = members.filter("block = 0 and blocks > 1").select("family", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("job"), "class", "shingles", F.lit(1).alias("side"))
    links = store.cut(job.unionByName(hubs).groupBy("family", "job").applyInArrow(solve, "a long, b long"))
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        # what is not in its family's largest component meets every block once more
        found = components(links, store)
        at = large.select("family", "class").join(found, F.col("class") == F.col("node"), "left").select("family", "class", F.coalesce("root", "class").alias("root"))
        at = store.cut(at)
        most = at.groupBy("family", "root").count().groupBy("family").agg(F.max(F.struct("count", "root")).alias("m")).select("family", F.col("m.root").alias("root"))
        apart = at.join(most, ["family", "root"], "left_anti").select("family", "class")
        lots = apart.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))
        rest = large.join(apart, ["family", "class"], "left_semi").join(lots, "family").withColumn("lot", F.pmod(F.xxhash64("class", F.lit(1)), F.col("lots")).cast("int"))
        stay = rest.select("family", "lot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("job"), "class", "shingles", F.lit(0).alias("side"))
        meet = large.join(lots, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("block").alias("job"), "class", "shingles", F.lit(1).alias("side"))
        more = stay.unionByName(meet).groupBy("family", "lot", "job").applyInArrow(solve, "a long, b long")
        links = store.cut(links.unionByName(more))
    store.drop(members_path)
    found = components(links, store).select(F.col("node").alias("class"), "root")
    first = found.join(classes, "class").groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = found.join(first, "root").select("class", "component_id")
    of_class = store.cut(classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "first_id").alias("component_id")))
    return rows.join(of_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["text_hash"] if with_hash else []))


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: one of least id; a row without an id stays if none of its component has one. Of rows that
    repeat id and text one stays, of rows that repeat an id each counts by its own text."""
    own = free_name(df, "__near")
    key, text = f"{own}key", f"{own}text"
    # a row without an id gets a number beyond usual ids in its place
    keyed = df.withColumn(text, F.xxhash64(text_col)).withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.col(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)))
    found = near_duplicates(keyed.select(key, text_col), width, percent, key, text_col, with_hash=True)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    return keyed.join(kept, [key, text], "left_semi").dropDuplicates([key, text]).drop(key, text)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
