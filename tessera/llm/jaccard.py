"""Exact Jaccard join of word-shingle sets, by relations between sets.

Sets share a link if their Jaccard similarity is at least three quarters. Each set
posts its rarest shingles, as many as any partner must share one of (prefix filter).
A list of postings is ordered by size and position, and whole blocks of it are
skipped where sizes or positions rule a link out. Where many sets of a list may be
linked, they aren't paired: the most central one is their pivot, each is compared
with it, and answers between the others are derived from those answers:

with R the shingles of pivot p that u lacks and A those that u has besides,
|u & v| = |p| - |R_u| - |R_v| + |R_u & R_v| + |A_u & A_v|,
so u and v are linked exactly if
cost(u) + cost(v) - 7 (|R_u & R_v| + |A_u & A_v|) <= |p|, cost = 4 |R| + 3 |A|.

Sets within the pivot's reach (cost <= |p|) are linked to it and need no pair among
themselves. Only the others are compared with the pivot's sets, over their
differences and in blocks by cost: as what two sets share of their differences is at
most a third of the lesser cost, whole blocks that lie too far apart are skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words of a shingle.
SHINGLE = 5
#: Shingles are counted in buckets for the order from rare to common; any order gives the same links. There is a bucket for so many bytes of text, between the least and most bits: 2^25 buckets take 64 MB of a worker while counting, 32 MB afterwards.
BYTES_A_BUCKET, LEAST_BITS, MOST_BITS = 256, 18, 25
#: Buckets of the table that travel together.
BLOCK_BITS = 16
#: Steps of the scale by which bucket counts are told apart, for each doubling.
STEPS = 8
#: Sets that a task remembers to take equal ones once; with more, some are counted again, which changes no link.
SEEN = 1 << 18
#: Postings of a reducing task, about.
POSTINGS = 1_000_000
#: Postings that a task holds before it sends them on.
HELD = 2_000_000
#: Sets of a list that are looked at pair by pair; longer lists go to a pivot.
SMALL = 48
#: Sets of a pivot that are compared with each other in one place.
BLOCK = 1_024
#: Bits of the filter for sets that take part in a pair: 16 MB always.
FILTER_BITS = 27
#: A shingle whose bucket counts so many sets has its list made without an exchange by shingle.
HOT = 65_536
#: Rows of pivots that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Blocks of a pivot's sets by cost: so many for each e-fold of what a cost is beyond none, in units of the pivot's size.
BANDS = 8

_U = np.uint64


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles; of the whole sequence where it is shorter; none without words."""
    return np.unique(common.windows(common.word_hashes(common.words(text)), SHINGLE))


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of a set's hashes, six bytes each, in order."""
    return np.unique(s >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(_U).reshape(-1)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers of a set, which together are its class."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def number_of(s: np.ndarray, clashes: frozenset[int]) -> int:
    """The number that stands for a set's class: the first of its two, unless another class has it, too."""
    first, second = class_of(s)
    return first ^ second if first in clashes else first


def need(a, b):
    """Common shingles that sets of these sizes must have: 100 i >= 75 (a + b - i)."""
    return (3 * (a + b) + 6) // 7


def prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def _shown(counts: np.ndarray) -> bytes:
    """A block's counts in the fewest bytes: all of them, or places and counts of those that aren't zero."""
    small = counts.max() < 256
    at = np.flatnonzero(counts)
    if 3 * len(at) < len(counts) and small:
        return b"s" + at.astype(np.uint16).tobytes() + counts[at].astype(np.uint8).tobytes()
    return b"1" + counts.astype(np.uint8).tobytes() if small else b"4" + counts.astype(np.uint32).tobytes()


def _add(into: np.ndarray, shown: bytes) -> None:
    """Add a block's counts to others, both of 32 bits; a sum that is too large stays at the largest number."""
    at, more = slice(None), None
    if shown[:1] == b"s":
        n = (len(shown) - 1) // 3
        at, more = np.frombuffer(shown, np.uint16, n, 1), np.frombuffer(shown, np.uint8, n, 1 + 2 * n)
    else:
        more = np.frombuffer(shown, np.uint8 if shown[:1] == b"1" else np.uint32, -1, 1)
    total = into[at] + more
    into[at] = np.where(total < into[at], np.uint32(0xFFFFFFFF), total)


def bucket_bits(size: int) -> int:
    """Bits of the bucket table for so many bytes of text."""
    return max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(2, size / BYTES_A_BUCKET)))))


def _sketch(bits: int):
    """A row for each document, then the counts of shingle buckets over the task's different sets."""

    def run(batches):
        table, seen = np.zeros(1 << bits, np.uint16), set()
        most = np.uint16(0xFFFF)
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in _SKETCH}
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                s = shingles(text)
                cid, check = class_of(s)
                cols["doc_id"].append(doc_id)
                cols["n"].append(len(s))
                cols["cid"].append(cid)
                cols["check"].append(check)
                if cid not in seen and len(s):
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cid)
                    # a set's hashes are sorted and differ, so those of one bucket stand next to each other
                    at = s >> _U(64 - bits)
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    n, at = np.diff(np.r_[first, len(at)]), at[first]
                    table[at] = np.minimum(table[at] + n, most)  # what is that common is last anyway
            cols["block"] = cols["counts"] = [None] * len(cols["n"])
            yield common.batch(_SKETCH, cols)
        for k, counts in enumerate(table.reshape(-1, 1 << BLOCK_BITS)):
            if counts.any():
                yield common.batch(_SKETCH, {"doc_id": [None], "n": [None], "cid": [None], "check": [None], "block": [k], "counts": [_shown(counts)]})

    return run


def scale(counts: np.ndarray | float) -> np.ndarray:
    """Counts on a logarithmic scale of one byte."""
    return np.minimum(np.floor(STEPS * np.log2(np.asarray(counts, np.float64) + 1)), 255).astype(np.uint8)


def _table(sketch: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The counts of all tasks on their scale, and their mean; added up block by block: by a few tasks first, so that little is exchanged."""
    blocks = 1 << (bits - BLOCK_BITS)

    def add_up(batches):
        by: dict[int, np.ndarray] = {}
        for rb in batches:
            for k, shown in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                _add(by.setdefault(k, np.zeros(1 << BLOCK_BITS, np.uint32)), shown)
        for k, counts in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_shown(counts)], pa.binary())], names=["block", "counts"])

    table, total = np.zeros((blocks, 1 << BLOCK_BITS), np.uint8), 0
    shown = "block int, counts binary"
    parts = sketch.where("block IS NOT NULL").select("block", "counts")
    few = max(8, math.isqrt(parts.rdd.getNumPartitions()))
    sums = common.by_arrow(parts.coalesce(few), add_up, shown).repartition(min(blocks, 64), "block")
    for r in common.by_arrow(sums, add_up, shown).toLocalIterator():
        counts = np.zeros(1 << BLOCK_BITS, np.uint32)
        _add(counts, bytes(r.counts))
        table[r.block] = scale(counts)
        total += int(counts.sum(dtype=np.int64))
    common.release()
    return table.reshape(-1), total / table.size


class _Ranks:
    """The order of shingles, rare ones first, from bucket counts on their scale."""

    def __init__(self, table: np.ndarray, mean: float, hot: int) -> None:
        self.table, self.shift = table, _U(64 - int(table.size).bit_length() + 1)
        self.common, self.hot = scale(mean + 6 * np.sqrt(mean) + 1), scale(hot)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """A set's prefix, whether each of it is hot, and how central the set is (0 to 255)."""
        cnt = self.table[(s >> self.shift).astype(np.int64)]
        order = np.lexsort((s, cnt))[: prefix(len(s))]
        return s[order], cnt[order] >= self.hot, int(255 * (cnt >= self.common).mean())


def _pairs_of(h: np.ndarray, cid: np.ndarray, n: np.ndarray, rest: np.ndarray, central: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to compare from postings of one reducing task: (pivot or first, other, whether as a pivot's)."""
    order = np.lexsort((cid, n, h))
    h, cid, n, rest, central = h[order], cid[order], n[order], rest[order], central[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])]
    h, cid, n, rest, central = h[keep], cid[keep], n[keep].astype(np.int64), rest[keep].astype(np.int64), central[keep]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    length = np.diff(np.r_[first, len(h)])
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    star: list[np.ndarray] = []

    def put(a, b, is_star: bool) -> None:
        left.append(a)
        right.append(b)
        star.append(np.full(len(a), is_star))

    two = first[length == 2]
    ok = np.minimum(rest[two], rest[two + 1]) >= need(n[two], n[two + 1])
    put(cid[two[ok]], cid[two[ok] + 1], False)
    for a, m in zip(first[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        at = np.arange(a, a + m)
        if m > SMALL:
            for part in _by_position(at, n, rest):
                put(*_star(cid, central, part), True)
            continue
        x, r = n[at], rest[at]
        may = np.minimum(r[:, None], r[None, :]) >= need(x[:, None], x[None, :])
        may &= np.tri(m, k=-1, dtype=bool)
        if not may.any():
            continue
        i, j = np.nonzero(may)
        if len(i) <= 2:
            put(cid[at[i]], cid[at[j]], False)
            continue
        for part in _parts(m, i, j):
            inside = np.isin(i, part)
            if inside.sum() < len(part):
                put(cid[at[i[inside]]], cid[at[j[inside]]], False)
            else:
                put(*_star(cid, central, at[part]), True)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(left), np.concatenate(right), np.concatenate(star)


def largest(n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The largest partner that a set of n shingles may have by a shingle behind which, itself included, it has rest of them."""
    return 7 * rest // 3 - n


def _by_position(at: np.ndarray, n: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """The places of a list, sizes ascending, in parts whose sets may be linked.

    By position a list has a block of sets that may be linked with ones of their size or
    larger, and a block of those that stand so far back that only smaller ones come into
    question. Of the second block no two can be linked, so all pairs within it are
    skipped, and a set of it stays only where the first block has one of a fitting size.
    Sets that none can be linked with go first. What is left is cut where sizes leap.
    """
    size, most = n[at], largest(n[at], rest[at])
    least = -(-3 * size // 4)
    front = most >= size
    stays = front.copy()
    back = np.flatnonzero(~front & (most >= least))
    if len(back) and front.any():
        f = np.flatnonzero(front)
        lo, hi = np.searchsorted(size[f], least[back]), np.searchsorted(size[f], most[back], "right")
        # the largest reach among so many neighbours, doubling: the range of each is covered by two of them
        reach, levels = most[f], []
        while True:
            levels.append(reach)
            step = 1 << (len(levels) - 1)
            if 2 * step > len(f):
                break
            reach = np.maximum(reach[:-step], reach[step:])
        width = np.maximum(hi - lo, 1)
        level = np.int64(np.log2(width))
        best = np.zeros(len(back), np.int64)
        for k, r in enumerate(levels):
            own = (level == k) & (hi > lo)
            best[own] = np.maximum(r[lo[own]], r[hi[own] - (1 << k)])
        stays[back] = (hi > lo) & (best >= size[back])
    at = at[stays]
    if not len(at):
        return []
    gaps = np.flatnonzero(4 * n[at[:-1]] < 3 * n[at[1:]])
    return [part for part in np.split(at, gaps + 1) if len(part) > 1]


def _star(cid: np.ndarray, central: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = cid[at]
    p = c[np.lexsort((common.mix(c.view(_U)), -central[at].astype(np.int64)))[0]]
    others = c[c != p]
    return np.full(len(others), p), others


def _parts(m: int, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Connected parts of more than one of m places, joined by pairs (i, j)."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [p for x in np.unique(label) if len(p := np.flatnonzero(label == x)) > 1]


def _bitmap(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    k = ids >> _U(64 - FILTER_BITS)
    np.bitwise_or.at(out, (k >> _U(3)).astype(np.int64), (_U(1) << (k & _U(7))).astype(np.uint8))
    return out


def _own(cid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """One number for a class and the document that stands for it."""
    return common.mix(cid.astype(np.int64).view(_U) ^ common.mix(doc_id.astype(np.int64).view(_U)))


_POSTED = pa.schema([("slice", pa.int32()), ("h", pa.binary()), ("cid", pa.binary()), ("n", pa.binary()), ("rest", pa.binary()), ("central", pa.binary())])


def candidates(docs: DataFrame, table: np.ndarray, mean: float, clashes: frozenset[int], postings: int, reducers: int) -> DataFrame:
    """Different pairs (a, b, star) of classes that may be linked; of a star pair a is the pivot."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast((table, mean, clashes, HOT))
    slices = max(reducers, -(-postings // POSTINGS))

    def each(batches, of):
        seen: set[int] = set()
        table, mean, clashes, hot = ranks.value
        r = _Ranks(table, mean, hot)
        for rb in batches:
            for text in rb.column(0).to_pylist():
                s = shingles(text)
                if len(s):
                    cid = number_of(s, clashes)
                    if cid not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(cid)
                        of(cid, len(s), *r.prefix(s))
            yield

    def post(batches):
        held: list[tuple] = []
        often: list[tuple] = []
        size = 0

        def of(cid, n, h, is_hot, central):
            nonlocal size
            at = np.flatnonzero(is_hot)
            # of a hot list, sets that none can be linked with are left out here
            at = at[largest(n, n - at) >= -(-3 * n // 4)]
            often.extend((x, cid, central, n, n - p) for x, p in zip(h[at].view(np.int64).tolist(), at.tolist(), strict=True))
            pos = np.flatnonzero(~is_hot)
            held.append((h[pos], np.full(len(pos), cid), np.full(len(pos), n, np.uint32), (n - pos).astype(np.uint32), np.full(len(pos), central, np.uint8)))
            size += len(pos)

        def flush():
            nonlocal size
            if size:
                h, cid, n, rest, central = map(np.concatenate, zip(*held, strict=True))
                # the slice comes of the high half of the hash, and the low half tells shingles of a slice apart
                to = ((h >> _U(32)) * _U(slices) >> _U(32)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(slices + 1))
                low = h.astype(np.uint32)
                for k in range(slices):
                    at = order[cuts[k] : cuts[k + 1]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (low, cid, n, rest, central))], schema=_POSTED)
            held.clear()
            size = 0
            if often:
                # of a hot shingle sets go their own way, not the shingle's
                k = abs(often[0][1]) % slices
                x, cid, central, n, rest = (np.array(v, np.int64).tobytes() for v in zip(*often, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - k], pa.int32()), *(pa.array([v], pa.binary()) for v in (x, cid, n, rest, central))], schema=_POSTED)
                often.clear()

        for _ in each(batches, of):
            if size >= HELD or len(often) >= 100_000:
                yield from flush()
        yield from flush()

    none = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_()), ("central", pa.int64()), ("n", pa.int64()), ("most", pa.int64())])

    def reduce(batches):
        by: dict[int, list] = {}
        for rb in batches:
            cols = [rb.column(i).to_pylist() for i in range(6)]
            for k, *blobs in zip(*cols, strict=True):
                if k < 0:
                    x, cid, n, rest, central = (np.frombuffer(b, np.int64) for b in blobs)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(cid), pa.nulls(len(x), pa.bool_()), pa.array(central), pa.array(n), pa.array(largest(n, rest))], schema=none)
                    continue
                by.setdefault(k, []).append([np.frombuffer(b, t) for b, t in zip(blobs, (np.uint32, np.int64, np.uint32, np.uint32, np.uint8), strict=True)])
        for k in list(by):
            a, b, star = _distinct(*_pairs_of(*map(np.concatenate, zip(*by.pop(k), strict=True))))
            for i in range(0, len(a), 100_000):
                part = [pa.array(x[i : i + 100_000]) for x in (a, b, star)]
                yield pa.RecordBatch.from_arrays([*part, *(pa.nulls(len(part[0]), pa.int64()) for _ in range(3))], schema=none)

    src = docs.select("text")
    posted = common.by_arrow(src, post, "slice int, h binary, cid binary, n binary, rest binary, central binary").repartition(slices, "slice")
    rows = common.cut(common.by_arrow(posted, reduce, "a long, b long, star boolean, central long, n long, most long"))
    found = rows.where("star IS NOT NULL").select("a", "b", "star")
    hot = rows.where("star IS NULL").select(F.col("a").alias("h"), F.col("b").alias("cid"), "central", "n", "most").distinct()
    # as in _by_position: the first block's sizes and reach, and its most central set as the pivot
    front = F.col("most") >= F.col("n")
    pivots = common.cut(hot.groupBy("h").agg(F.max_by(F.when(front, F.col("cid")), F.struct(front, "central", F.xxhash64("cid"), "cid")).alias("a"), F.min(F.when(front, F.col("n"))).alias("low"), F.max(F.when(front, F.col("n"))).alias("high"), F.max(F.when(front, F.col("most"))).alias("reach")).where("a IS NOT NULL"))
    meets = front | ((F.col("most") >= F.col("low")) & (4 * F.col("high") >= 3 * F.col("n")) & (F.col("reach") >= F.col("n")))
    pivots = F.broadcast(pivots) if pivots.count() <= BROADCAST_ROWS else pivots.hint("merge")
    stars = hot.join(pivots, "h").where((F.col("a") != F.col("cid")) & meets).select("a", F.col("cid").alias("b"), F.lit(True).alias("star"))
    found = found.unionByName(stars)
    return found.groupBy("a", "b").agg(F.max("star").alias("star"))


def _distinct(a: np.ndarray, b: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once; pairs that aren't a pivot's in a fixed direction."""
    turn = ~star & (a > b)
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    order = np.lexsort((~star, b, a))
    a, b, star = a[order], b[order], star[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[keep], b[keep], star[keep]


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elements of a that aren't in b; both sorted and without repeats."""
    if not len(b):
        return a
    i = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[i] != a]


def links(docs: DataFrame, pairs: DataFrame, stands: DataFrame, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Links (a, b) between classes, as many as join every two linked ones through others.

    stands has the class and the smallest document of each class. Sets are made again
    from the texts, of those documents alone whose class takes part in a pair.
    """
    spark = docs.sparkSession
    taking = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = taking.join(stands, "cid")

    def mark(batches):
        out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for rb in batches:
            out |= _bitmap(_own(rb.column(0).to_numpy(), rb.column(1).to_numpy()))
        # only the blocks with something in them
        for k, block in enumerate(out.reshape(-1, 1 << 13)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["k", "bits"])

    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8).reshape(-1, 1 << 13)
    marked = common.by_arrow(wanted.coalesce(8), mark, "k int, bits binary")
    for r in marked.toLocalIterator():  # 16 MB from each of 8 tasks at most
        bits[r.k] |= np.frombuffer(r.bits, np.uint8)
    held = spark.sparkContext.broadcast(bits.reshape(-1))

    def make(batches):
        bits = held.value
        for rb in batches:
            cids, sets = [], []
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s):
                    continue
                cid = number_of(s, clashes)
                k = int(_own(np.array([cid]), np.array([-(2**63) if doc_id is None else doc_id]))[0]) >> (64 - FILTER_BITS)
                if bits[k >> 3] >> (k & 7) & 1:
                    cids.append(cid)
                    sets.append(packed(s))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "s"])

    # what the filter lets by wrongly meets no pair, and a repeated row makes a link twice
    made = common.by_arrow(docs.select("doc_id", "text"), make, "cid long, s binary")
    path = common.fresh_path(spark, "sets")
    made.write.parquet(path)
    sets = spark.read.parquet(path)
    # of the second exchange of sets only those take part that others are compared with
    firsts = common.cut(pairs.select("a").distinct())
    heads = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    heads = heads.join(F.broadcast(firsts), "a", "left_semi") if firsts.count() <= BROADCAST_ROWS else heads
    whole = pairs.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")).hint("merge"), "b").join(heads.hint("merge"), "a")

    def compare(batches):
        for rb in batches:
            rows: list[tuple] = []
            for a, b, star, sb, sa in zip(*(rb.column(c).to_pylist() for c in ("a", "b", "star", "sb", "sa")), strict=True):
                p, u = unpacked(sa), unpacked(sb)
                add, lack = _less(u, p), _less(p, u)
                cost = 4 * len(lack) + 3 * len(add)
                linked = cost <= len(p)
                if star:
                    rows.append((a, b, linked, len(p), band(cost, len(p)), packed(add << _U(16)), np.searchsorted(p, lack).astype(np.uint32).tobytes()))
                elif linked:
                    rows.append((a, b, True, 0, 0, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["a", "b", "linked", "size", "band", "add", "lack"])

    path = common.fresh_path(spark, "compared")
    common.by_arrow(whole.select("a", "b", "star", "sb", "sa"), compare, "a long, b long, linked boolean, size long, band int, add binary, lack binary").write.parquet(path)
    compared = spark.read.parquet(path)
    direct = compared.where("linked").select("a", "b")
    member = compared.where("size > 0")
    # by pivot and band: how many sets there are, and how many of them out of the pivot's reach
    bands = member.groupBy("a", "band").agg(F.count(F.lit(1)).alias("m"), F.sum((~F.col("linked")).cast("long")).alias("out"))
    outs = bands.where("out > 0").select("a", F.col("band").alias("i"), F.ceil(F.col("out") / BLOCK).cast("int").alias("ni"), "out")
    anys = bands.select("a", F.col("band").alias("j"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nj"), "m")
    blocks = common.cut(outs.join(anys, "a").where((F.col("j") <= F.col("i")) & near_bands(F.col("i"), F.col("j")) & ~((F.col("i") == F.col("j")) & (F.col("m") == 1))).select("a", "i", "j", "ni", "nj", "m"))
    total = member.count()

    def dealt(rows: DataFrame, own: str) -> DataFrame:
        """rows with all blocks that their band takes part in. Those of pivots with a large share of all rows stay where they are: their blocks are broadcast."""
        large = F.col("m") > max(4 * BLOCK, total // common.HOT_KEYS)
        hot = blocks.where(large).select("a").distinct()
        rows = rows.withColumn(own, F.col("band"))
        here = rows.join(F.broadcast(blocks.join(F.broadcast(hot), "a").drop("m")), ["a", own])
        there = rows.join(F.broadcast(hot), "a", "left_anti").join(blocks.drop("m").hint("merge"), ["a", own])
        return here.unionByName(there.select(*here.columns))

    block = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["a", "i", "j", "si", "sj"]
    rest = ["outside", "b", "size", "add", "lack"]
    as_out = dealt(member.where("NOT linked"), "i").withColumns({"si": block("ni"), "outside": F.lit(True)}).withColumn("sj", each_of("nj")).select(*keys, *rest)
    as_any = dealt(member, "j").withColumns({"sj": block("nj"), "outside": F.lit(False)}).withColumn("si", each_of("ni")).select(*keys, *rest)
    tasks = as_out.unionByName(as_any).repartition(*keys).sortWithinPartitions(*keys)

    def derive(batches):
        key, held = None, []
        for rb in batches:
            cols = [rb.column(c).to_pylist() for c in (*keys, *rest)]
            found: list[tuple[int, int]] = []
            for row in zip(*cols, strict=True):
                if row[:5] != key:
                    found += derived(held)
                    key, held = row[:5], []
                held.append(row[5:])
            if found:
                yield _links(found)
        if found := derived(held):
            yield _links(found)

    more = common.by_arrow(tasks.select(*keys, *rest), derive, "a long, b long")
    return direct.unionByName(more)


def band(cost: int, size: int) -> int:
    """The block of a pivot's sets, by what they cost, that one is in."""
    return int(BANDS * math.log1p(cost / size))


def near_bands(i: Column, j: Column) -> Column:
    """Whether sets of bands i and j <= i may be linked: two sets that cost c and d <= c share at most d / 3 of their differences, so that c <= 4 / 3 d + the pivot's size."""
    return F.exp(i / BANDS) - 1 <= 4 / 3 * (F.exp((j + 1) / BANDS) - 1) + 1 + 1e-9


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def derived(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between sets out of a pivot's reach and its other sets, from rows (outside, set, pivot's size, added shingles, places in the pivot that lack); a spanning forest of them."""
    outs, anys = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    if not outs or not anys:
        return []
    size = rows[0][2]
    parts, owner, cost, total = [], [], [], []
    for k, (_, _, _, add, lack) in enumerate([*outs, *anys]):
        a, r = unpacked(add), np.frombuffer(lack, np.uint32)
        parts += (a, r + _U(1 << 60))
        owner.append(np.full(len(a) + len(r), k))
        cost.append(4 * len(r) + 3 * len(a))
        total.append(len(a) + len(r))
    cost_, total_ = np.array(cost), np.array(total)
    no = len(outs)
    # too different in cost for all they could share: most pairs end here
    over = cost_[:no, None] + cost_[None, no:] - size
    may = over <= 7 * np.minimum(total_[:no, None], total_[None, no:])
    ids_out, ids_any = np.array([r[1] for r in outs]), np.array([r[1] for r in anys])
    may &= ids_out[:, None] != ids_any[None, :]
    if not may.any():
        return []
    x, own = np.concatenate(parts), np.concatenate(owner)
    _, column, times = np.unique(x, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, own = column[shared], own[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    same = np.zeros(may.shape, np.float32)
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    step = max(1, 30_000_000 // (no + len(anys)))
    for c in range(0, width, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        m = np.zeros((no + len(anys), min(step, width - c)), np.float32)
        m[own[lo:hi], column[lo:hi] - c] = 1
        same += m[:no] @ m[no:].T
    i, j = np.nonzero(may & (over <= 7 * same))
    return _forest(ids_out[i].tolist(), ids_any[j].tolist())


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[ry] = rx
            out.append((x, y))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(cid, part) of every class with an edge: part is the smallest class reachable.

    Labels spread along edges and jump to their labels' labels. A pivot has an edge to
    each of its sets, and a component's label comes to stand at all of its classes; what
    such hubs and labels say is broadcast, so that their rows stay where they are.
    """
    both = common.cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = common.cut(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("cid"), F.least("a", "low").alias("part"), "degree"))
    n_edges, n = both.count(), labels.count()
    while True:
        told = common.join_unique(both.withColumnRenamed("b", "cid"), labels.select("cid", "part", "degree"), ["cid"], "degree", n_edges)
        near = told.groupBy("a").agg(F.min("part").alias("low"))
        spread = common.cut(labels.join(near, labels["cid"] == near["a"]).select("cid", F.least("part", "low").alias("next"), F.col("part").alias("was"), "degree"))
        asked = spread.groupBy("next").agg(F.count(F.lit(1)).alias("copies"))
        far = asked.join(spread.select(F.col("cid").alias("next"), F.col("next").alias("far")), "next")
        new = common.join_unique(spread, far, ["next"], "copies", n)
        new = common.cut(new.select("cid", F.least("next", "far").alias("part"), (F.least("next", "far") < F.col("was")).alias("moved"), "degree"))
        labels = new.select("cid", "part", "degree")
        if new.where("moved").isEmpty():
            return labels.select("cid", "part")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text).

    A document without words (null, empty or blank text) has an empty set and is linked
    with nothing: its component is its own id. Documents of equal sets are linked. Rows
    that repeat a doc_id stay, each with its own text's set; a null doc_id is never the
    smallest unless all of its component are null. Ties don't arise: links are exact.
    """
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    bits = bucket_bits(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    path = common.fresh_path(spark, "shingles")
    common.by_arrow(d, _sketch(bits), "doc_id long, n long, cid long, check long, block int, counts binary").write.option("compression", "zstd").parquet(path)
    sketch = spark.read.parquet(path)
    rows = sketch.where("block IS NULL").select("doc_id", "n", "cid", "check")
    table, mean = _table(sketch, bits)
    classes = common.cut(rows.where("n > 0").groupBy("cid", "check").agg(F.min("doc_id").alias("smallest"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    # of n sets some n * n / 2^65 share the first of their two numbers
    clashes = frozenset(r.cid for r in classes.groupBy("cid").count().where("count > 1").select("cid").collect())
    number = F.when(F.col("cid").isin(*clashes), F.col("cid").bitwiseXOR("check")).otherwise(F.col("cid")) if clashes else F.col("cid")
    if clashes and not classes.groupBy(number.alias("cid")).count().where("count > 1").isEmpty():
        raise RuntimeError("two different sets have one number in both ways")
    rows, classes = rows.withColumn("cid", number).drop("check"), classes.withColumn("cid", number).drop("check")
    sets, postings, total = classes.agg(F.count(F.lit(1)), F.sum(F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1), F.sum("copies")).first()
    if sets and sets > 1:
        pairs = common.cut(candidates(d, table, mean, clashes, postings, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        stands = classes.select("cid", F.coalesce("smallest", F.lit(-(2**63))).alias("doc_id"))
        parts = common.cut(components(links(d, pairs, stands, clashes)))
        least = parts.join(classes, "cid").groupBy("part").agg(F.min("smallest").alias("least"), F.count(F.lit(1)).alias("copies"))
        linked = common.join_unique(parts, least, ["part"], "copies", sets).select("cid", "least")
        of_class = classes.join(linked, "cid", "left").select("cid", "copies", F.coalesce("least", "smallest").alias("component"))
    else:
        of_class = classes.select("cid", "copies", F.col("smallest").alias("component"))
    out = common.join_unique(rows, common.cut(of_class), ["cid"], "copies", total or 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
