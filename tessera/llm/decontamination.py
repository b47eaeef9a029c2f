"""Benchmark decontamination by spaced-seed hashing.

A mask lays over a window of tokens and ignores some of its places, so a window
hashes alike whatever stands there. Benchmark and training windows join on those
hashes; a hit fixes how an item and a document lie against each other, and all
their tokens that lie against each other so are compared place by place. An overlap counts if enough tokens in
a row agree but for some substitutions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Fixed masks; 1 reads a place and 0 ignores it. Every overlap that counts has a hit: without five tokens in a row that agree, it has runs of four at most,
#: and as four in five agree, two runs of four stand next to each other or one of the few shorter patterns is there, which the second mask fits all.
MASKS = ("11111", "110111")
#: Tokens of an overlap that must agree at least, and the share of them that must.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: Bits of the filter over benchmark hashes: 16 MB whatever the benchmark holds. More hashes only let more misses on to the join.
FILTER_BITS = 27
#: Benchmark windows that are broadcast at most; beyond that the join is a sort-merge join.
BROADCAST_ROWS = 200_000

#: Characters of scripts without spaces between words: each is a token of its own.
_ALONE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_TOKEN = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens: runs of letters and digits of any script, in lower case, without punctuation of any script; single characters where words aren't set apart."""
    return common.word_hashes(_TOKEN.findall(text.lower())) if text else np.zeros(0, np.uint64)


def _mask_places(masks: tuple[str, ...]) -> list[list[int]]:
    return [[i for i, c in enumerate(m) if c == "1"] for m in masks]


def seeds(h: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask that fits into h: its number, and the hash of every window under it."""
    for k, (mask, at) in enumerate(zip(masks, _mask_places(masks), strict=True)):
        n = len(h) - len(mask) + 1
        if n > 0:
            out = np.full(n, k + 1, np.uint64)
            for j in at:
                out += h[j : j + n] * common.PLACES[j]
            yield k, common.mix(out)


def short_seed(h: np.ndarray) -> np.uint64:
    """The hash of a whole item of fewer tokens than LEAST_TOKENS."""
    out = np.uint64(1000 + len(h))
    with np.errstate(over="ignore"):
        for j, x in enumerate(h):
            out += x * common.PLACES[100 + j]
    return common.mix(np.array([out]))[0]


def short_windows(h: np.ndarray, length: int) -> np.ndarray:
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 1000 + length, np.uint64)
    for j in range(length):
        out += h[j : j + n] * common.PLACES[100 + j]
    return common.mix(out)


def best_overlap(same: np.ndarray, least: int = LEAST_TOKENS, share: float = LEAST_SHARE) -> tuple[int, int] | None:
    """The longest stretch [i, j) of at least least places of which at least share agree, with both ends agreeing; the first of equals."""
    n = len(same)
    if n < least or same.sum() < share * least:
        return None
    score = np.r_[0.0, np.cumsum(np.where(same, 1 - share, -share))]
    # a stretch fits if its sum isn't negative; the longest has a prefix minimum to its left and a suffix maximum to its right
    eps = 1e-9
    low = np.minimum.accumulate(score)
    best = None
    starts = np.flatnonzero(np.r_[True, score[1:-1] < low[:-2]]) if n > 1 else np.array([0])
    high = np.maximum.accumulate(score[::-1])[::-1]
    j = 0
    for i in starts.tolist():
        j = max(j, i)
        while j + 1 <= n and high[j + 1] >= score[i] - eps:
            j += 1
        a, b = i, j
        while a < b and not same[a]:
            a += 1
        while b > a and not same[b - 1]:
            b -= 1
        if b - a >= least and (best is None or b - a > best[1] - best[0]):
            best = (a, b)
    return best


def overlap(same: np.ndarray, least: int = LEAST_TOKENS, share: float = LEAST_SHARE) -> tuple[int, int] | None:
    """The longest stretch as best_overlap has it in which also least places agree; the first of equals."""
    span = best_overlap(same, least, share)
    if span is None or same[span[0] : span[1]].sum() >= least:
        return span
    total = np.r_[0, np.cumsum(same)]
    for n in range(span[1] - span[0], least - 1, -1):
        agree = total[n:] - total[:-n]
        fits = np.flatnonzero((agree >= max(least, share * n - 1e-9)) & same[: len(same) - n + 1] & same[n - 1 :])
        if len(fits):
            return int(fits[0]), int(fits[0]) + n
    return None


def contaminated(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST_TOKENS, share: float = LEAST_SHARE) -> DataFrame:
    """Overlaps of documents (doc_id, text) with benchmark items (item_id, text): a row for each pair and the longest of its overlaps.

    doc_start and item_start are token numbers, n_tokens the overlap's length and
    n_same how many of its tokens agree. An item of fewer than least tokens counts if it
    stands whole in a document, token for token. Items and documents without tokens
    (null, empty, punctuation alone) overlap with nothing; a null doc_id or item_id goes
    through as null. Rows that repeat a document's id are one document for the result.
    Overlaps of the same length: the first in the document, then in the item.

    An item that has a hit in a document is compared over its whole length, so an overlap
    is found whole. A small benchmark is broadcast as a sorted list of its windows, and the
    documents' workers compare; of a larger one each hit brings the item's tokens, and as
    many of the document's on either side as the longest item has.
    """
    spark = docs.sparkSession

    def of_items(batches):
        for rb in batches:
            out: dict[str, list] = {"seed": [], "item_id": [], "at": [], "length": [], "item": []}
            for item_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                h = tokens(text)
                if not len(h):
                    continue
                found = [(-1, 0, short_seed(h))] if len(h) < least else [(k, i, s) for k, ss in seeds(h, masks) for i, s in enumerate(ss)]
                for _, i, s in found:
                    out["seed"].append(np.int64(np.uint64(s).view(np.int64)) if isinstance(s, np.uint64) else s)
                    out["item_id"].append(item_id)
                    out["at"].append(i)
                    out["length"].append(len(h))
                    out["item"].append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["seed"], pa.int64()), pa.array(out["item_id"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["item"], pa.binary())], names=list(out))

    item_rows = common.cut(common.by_arrow(items.select(items["item_id"].cast("long"), items["text"]), of_items, "seed long, item_id long, at long, length long, item binary"))
    n_items = item_rows.count()
    shorts = sorted(r.length for r in item_rows.where(F.col("length") < least).select("length").distinct().collect())
    reach = item_rows.agg(F.max("length")).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(_filter(item_rows))

    def hits(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of windows that the filter lets through, and their seeds."""
        bits = np.frombuffer(bitmap.value, np.uint8)
        for s in [*(s for _, s in seeds(h, masks)), *(short_windows(h, n) for n in shorts)]:
            k = s >> np.uint64(64 - FILTER_BITS)
            at = np.flatnonzero(bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            yield at, s[at]

    def compare(d: np.ndarray, t: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
        """Starts in d and t, length and agreeing tokens of the overlap where t's first token lies against d[diagonal]."""
        a, b = max(0, diagonal), max(0, -diagonal)
        n = min(len(d) - a, len(t) - b)
        same = d[a : a + n] == t[b : b + n]
        if len(t) < least:
            span = (0, n) if n == len(t) and same.all() else None
        else:
            span = overlap(same, least, share)
        return span and (a + span[0], b + span[0], span[1] - span[0], int(same[span[0] : span[1]].sum()))

    def listed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(6)], names=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_same"])

    plain = docs.select(docs["doc_id"].cast("long"), docs["text"])
    result = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_same long"

    if n_items <= BROADCAST_ROWS:
        held = spark.sparkContext.broadcast(_index(item_rows))

        def of_docs(batches):
            seed, number, at, ids, texts = held.value
            texts = [np.frombuffer(x, np.uint64) for x in texts]
            for rb in batches:
                out = []
                for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                    h = tokens(text)
                    pairs = []
                    for place, s in hits(h):
                        first = np.searchsorted(seed, s)
                        n = np.searchsorted(seed, s, "right") - first
                        row = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                        pairs.append((number[row] << 40) + np.repeat(place, n) - at[row] + (1 << 39))
                    for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                        k = pair >> 40
                        if (span := compare(h, texts[k], (pair & (1 << 40) - 1) - (1 << 39))) is not None:
                            out.append((doc_id, ids[k], *span))
                if out:
                    yield listed(out)

        found = common.by_arrow(plain, of_docs, result)
    else:

        def hits_of_docs(batches):
            for rb in batches:
                ids, seed, at, around, lead = [], [], [], [], []
                for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                    h = tokens(text)
                    for place, s in hits(h):
                        for i, x in zip(place.tolist(), s.view(np.int64).tolist(), strict=True):
                            a = max(0, i - reach)
                            ids.append(doc_id)
                            seed.append(x)
                            at.append(i)
                            around.append(h[a : i + reach].tobytes())
                            lead.append(i - a)
                            if len(ids) == 1_000:
                                yield of_hits(ids, seed, at, around, lead)
                                ids, seed, at, around, lead = [], [], [], [], []
                yield of_hits(ids, seed, at, around, lead)

        def of_hits(ids, seed, at, around, lead):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seed, pa.int64()), pa.array(at, pa.int64()), pa.array(around, pa.large_binary()).cast(pa.binary()), pa.array(lead, pa.int64())], names=["doc_id", "seed", "doc_at", "around", "lead"])

        def verify(batches):
            for rb in batches:
                out = []
                cols = rb.to_pydict()
                for doc_id, doc_at, around, lead, item_id, at, item in zip(*(cols[c] for c in ("doc_id", "doc_at", "around", "lead", "item_id", "at", "item")), strict=True):
                    if (span := compare(np.frombuffer(around, np.uint64), np.frombuffer(item, np.uint64), lead - at)) is not None:
                        out.append((doc_id, item_id, span[0] + doc_at - lead, *span[1:]))
                if out:
                    yield listed(out)

        pairs = common.by_arrow(plain, hits_of_docs, "doc_id long, seed long, doc_at long, around binary, lead long").join(item_rows, "seed")
        found = common.by_arrow(pairs, verify, result)
    best = F.min(F.struct((-F.col("n_tokens")).alias("less"), "doc_start", "item_start", "n_tokens", "n_same"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.doc_start", "best.item_start", "best.n_tokens", "best.n_same")


def _index(item_rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int | None], list[bytes]]:
    """The windows' seeds in order, with item numbers and places, and the items' ids and tokens by number."""
    numbers: dict[tuple[int | None, bytes], int] = {}
    rows = [(r.seed, numbers.setdefault((r.item_id, bytes(r.item)), len(numbers)), r.at) for r in item_rows.toLocalIterator()]
    seed, number, at = np.ascontiguousarray(np.array(rows, np.int64).reshape(-1, 3).T)
    order = np.argsort(seed.view(np.uint64))
    return seed.view(np.uint64)[order], number[order], at[order], [k[0] for k in numbers], [k[1] for k in numbers]


def _filter(item_rows: DataFrame) -> bytes:
    """A bitmap over the highest FILTER_BITS bits of the seeds; of fixed size, put together from blocks of it."""
    block_bits = 16

    def set_bits(batches):
        blocks: dict[int, np.ndarray] = {}
        for rb in batches:
            k = rb.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            for b in np.unique(k >> np.uint64(block_bits)).tolist():
                inner = (k[k >> np.uint64(block_bits) == b] & np.uint64((1 << block_bits) - 1)).astype(np.int64)
                blocks.setdefault(b, np.zeros(1 << block_bits, bool))[inner] = True
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])

    parts = common.by_arrow(item_rows.select("seed"), set_bits, "block int, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (block_bits - 3)
    for r in parts.toLocalIterator():  # one partition's blocks at a time
        out[r.block * size : (r.block + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()
