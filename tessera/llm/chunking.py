"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over the text's UTF-8; a chunk ends where
bits of the hash are zero. Below the wanted length more bits must be zero than
above it (normalised chunking), so lengths gather around it and boundaries come
back after an insertion. A fingerprint is the set of chunk digests with the
chunks' lengths as weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Chunk lengths in bytes: least, wanted, most; and bits that must be zero before and after the wanted length.
LEAST, WANTED, MOST = 32, 128, 512
STRICT_BITS, LOOSE_BITS = 9, 5
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))
#: The gear: a 32-bit number for each byte, by a fixed rule.
GEAR = (common.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234_5678)) >> np.uint64(32)).astype(np.uint32)
#: Bytes hashed at a time, so that a very long text takes bounded memory besides itself.
STRIDE = 1 << 22


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Sum over k < 32 of GEAR[byte at i - k] << k, modulo 2^32, for each place i; by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of data; none for no data."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    loose: list[int] = []
    strict: set[int] = set()
    for a in range(0, n, STRIDE):
        b = max(0, a - 31)
        h = gear_hashes(raw[b : a + STRIDE])[a - b :]
        at = np.flatnonzero(h & _LOOSE == 0)
        loose += (at + (a + 1)).tolist()
        strict.update((at[h[at] & _STRICT == 0] + (a + 1)).tolist())
    ends, start, i, m = [], 0, 0, len(loose)
    while n - start > LEAST:
        least, wanted, most = start + LEAST, start + WANTED, min(start + MOST, n)
        cut = most
        while i < m and loose[i] < least:
            i += 1
        j = i
        while j < m:
            at = loose[j]
            if at >= most:
                break
            if at >= wanted or at in strict:
                cut = at
                break
            j += 1
        i = j
        ends.append(cut)
        start = cut
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """The set of chunk digests, each with its chunk's length."""
    out, start = {}, 0
    for end in boundaries(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def show(fingerprint: dict[int, int]) -> str:
    """Digests in order, each with its chunk's length; equal sets look equal."""
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(fingerprint.items()))


def read(shown: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in shown.split(",") if x)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment: bytes of common chunks against those of the smaller set; two empty sets are alike, an empty and another not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints added; a null text counts as empty and has the empty one. A column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]
    at, cols = keep.index(text), [str(i) for i in range(len(keep))]
    schema = ", ".join([*(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(cols, keep, strict=True)), "__new string"])

    def run(batches):
        for rb in batches:
            got = [show(chunks((t or "").encode("utf-8", "surrogatepass"))) for t in rb.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(got, pa.string())], names=[*cols, "__new"])

    out = common.by_arrow(docs.select(*(docs[c].alias(n) for c, n in zip(keep, cols, strict=True))), run, schema)
    return out.select(*(F.col(f"`{n}`").alias(c) for c, n in zip(keep, cols, strict=True)), F.col("__new").alias(name))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """text with its last half of code points, rounded down, replaced by as many of following's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and likenesses to that and to the next document's.

    Next is the one after it by descending doc_id (equal ids by descending text, a null
    id last); after the last comes the first, and a lone document follows itself. A null
    text counts as empty. Every row stays, repeated ones too.

    Texts are exchanged once, into ranges of doc_id; the first document of each range
    also goes to the range before it, where the last document needs it. The bounds come
    from quantiles of doc_id, so a range is as large as the ids of one value make it.
    """
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def bucket(ids: pa.Array) -> np.ndarray:
        """Cuts above each id; a null id goes to the last range."""
        down = len(cuts) - np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), down).astype(np.int32)

    def largest(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(rb.column(0))), rb.column(0)], names=["bucket", "doc_id"])

    # the first row of each range, as many as there are tasks
    top = common.by_arrow(d.select("doc_id"), largest, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()
    firsts = sorted((r.bucket, r.doc_id) for r in top)
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    first_id, lends_to = dict(firsts), {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}

    def deal(batches):
        """Rows of each range, and copies of its first for the range before; of rows with that id all, the first of which will count."""
        for rb in batches:
            own = bucket(rb.column(0))
            lent = np.array([i for i, (b, x) in enumerate(zip(own.tolist(), rb.column(0).to_pylist(), strict=True)) if first_id[b] == x], np.int64)
            take = np.r_[np.arange(len(own)), lent]
            to = np.r_[own, [lends_to[b] for b in own[lent].tolist()]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(take)), rb.column(1).take(pa.array(take)), pa.array(to), pa.array(np.arange(len(take)) >= len(own))], names=["doc_id", "text", "bucket", "lent"])

    d = common.by_arrow(d, deal, "doc_id long, text string, bucket int, lent boolean")
    d = d.repartition(n, "bucket").sortWithinPartitions("bucket", "lent", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        held = None  # (bucket, doc_id, text, fingerprint), waiting for what follows
        rows: list[tuple] = []

        def close(held, text, fp) -> None:
            _, doc_id, own, own_fp = held
            new = edited(own, text).encode("utf-8", "surrogatepass")
            new_fp = chunks(new)
            rows.append((doc_id, len(own), hashlib.sha256(new).hexdigest(), show(own_fp), show(new_fp), likeness(own_fp, new_fp), likeness(own_fp, fp)))

        for rb in batches:
            for doc_id, text, bucket, lent in zip(*(rb.column(i).to_pylist() for i in range(4)), strict=True):
                if lent and (held is None or held[0] != bucket):
                    continue  # a further document with the same id as the one that was lent
                fp = chunks(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    close(held, text, fp)
                held = None if lent else (bucket, doc_id, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)
            rows.clear()
        if held is not None:
            raise RuntimeError(f"nothing follows document {held[1]}")

    return common.by_arrow(d, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
