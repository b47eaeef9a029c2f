"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Short
windows of a document are compressed with either; a window that the toxic dictionary
shortens more is evidence. Logistic regression calibrates the largest differences
and how many pass each threshold into a score.

Most of toxic text is ordinary, and what a trainer finds most often in it is what it
finds in any text. So the toxic dictionary is trained on the stretches of toxic text
whose short strings stand there in many more contexts than in ordinary text. Contexts
are counted, not occurrences, as copies of one document would make any of its strings
look typical. When windows are compressed, either dictionary stands beside a large one
of ordinary text, which takes care of what is common in the language.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Labelled documents of each class that are learned from at most, and code points of each at most: of longer texts as many slices from all over.
SAMPLE, SAMPLE_CHARS, SLICES = 4_000, 65_536, 16
#: Bytes of a window, of the ordinary and of the toxic dictionary.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 64, 32_768, 2_048
#: Bytes of the strings that are counted; in how many contexts one must stand in toxic text, by number and by toxic documents, and how much likelier than in ordinary text.
STRING, LEAST_CONTEXTS, LEAST_SHARE, LEAST_RATIO = 6, 5, 0.05, 8.0
#: Bits of the table in which strings are counted first.
BUCKET_BITS = 18
#: Windows of ordinary text that the ordinary dictionary is trained on at most, those of the lowest hashes.
TRAINING_WINDOWS = 100_000
#: Thresholds in bytes whose passing windows are counted.
THRESHOLDS = (3, 4, 5, 6, 8)


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def cut_windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Windows of about size bytes that end between words where they can; a space stands at either end of the text."""
    b = b" " + text.encode("utf-8", "surrogatepass").lower() + b" "
    out, i, n = [], 0, len(b)
    while i < n:
        j = i + size
        if j >= n:
            out.append(b[i:])
            break
        k = b.rfind(b" ", i + 1, j + 1)
        if k <= i:
            k = j
        out.append(b[i : k + 1])
        i = k
    return out


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=5, target_length=0, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance:
    """Compression lengths of windows with both dictionaries; one per worker."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.pair = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_parameters())
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters()))

    def differences(self, windows: list[bytes]) -> np.ndarray:
        """Bytes by which the toxic dictionary shortens each window more."""
        a, b = (np.fromiter(map(len, map(c.compress, windows)), np.int64, len(windows)) for c in self.pair)
        return a - b

    def features(self, text: str) -> np.ndarray:
        windows = cut_windows(text)
        d = np.sort(self.differences(windows))[::-1]
        top = np.zeros(3)
        top[: min(3, len(d))] = d[:3]
        n = np.log1p(len(d))
        passing = [np.log1p((d >= t).sum()) for t in THRESHOLDS]
        return np.r_[top, passing, n, d.mean(), top[0] / (1 + n)]


def _strings(text: str) -> tuple[bytes, np.ndarray]:
    """A text as lower-case bytes between spaces, and the string of STRING bytes that begins at each place, as a number."""
    data = b" " * (STRING + 2) + text.encode("utf-8", "surrogatepass").lower().replace(b"\n", b" ") + b" "
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    key = np.zeros(len(raw) - STRING + 1, np.uint64)
    for j in range(STRING):
        key = key << np.uint64(8) | raw[j : j + len(key)]
    return data, key


def _places(strings: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the sorted strings each key is, or -1."""
    at = np.minimum(np.searchsorted(strings, key), len(strings) - 1)
    return np.where(strings[at] == key, at, -1)


def typical(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Stretches of toxic texts, in order, made of strings that these have in many contexts and ordinary ones hardly have. A string's context is a hash of 16 bits of what stands before it."""
    least = max(LEAST_CONTEXTS, LEAST_SHARE * len(toxic))
    # how often strings come at all, in buckets: nearly all come too seldom, and only the others' contexts are kept
    buckets, total = np.zeros(1 << BUCKET_BITS, np.int32), 0
    for text in toxic:
        _, key = _strings(text)
        total += len(key)
        buckets += np.bincount((common.mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(buckets)).astype(np.int32)
    seen: list[np.ndarray] = []
    for text in toxic:
        _, key = _strings(text)
        before = common.mix(np.r_[np.zeros(STRING, np.uint64), key[:-STRING]]) >> np.uint64(48)
        often = buckets[(common.mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] >= least
        seen.append(np.unique((key << np.uint64(16) | before)[often]))
    strings, contexts = np.unique(np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)])) >> np.uint64(16), return_counts=True)
    strings, contexts = strings[contexts >= least], contexts[contexts >= least]
    if not len(strings):
        return []
    other, times = 0, np.zeros(len(strings), np.int64)
    for text in ordinary:
        _, key = _strings(text)
        other += len(key)
        at = _places(strings, key)
        times += np.bincount(at[at >= 0], minlength=len(strings))
    strings = strings[contexts / total >= LEAST_RATIO * (times + 0.5) / max(1, other)]
    out: list[bytes] = []
    for text in toxic if len(strings) else []:
        data, key = _strings(text)
        at = np.flatnonzero(_places(strings, key) >= 0)
        if len(at):
            ends = np.flatnonzero(np.diff(at) > 1)
            out += [data[i : j + STRING] for i, j in zip(at[np.r_[0, ends + 1]].tolist(), at[np.r_[ends, len(at) - 1]].tolist(), strict=True)]
    return out


def _dictionary(size: int, samples: list[bytes], segment: int, string: int) -> bytes:
    """A trained dictionary, of segments of so many bytes by how often their strings come; what samples there are where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [x.center(8) for x in samples], k=segment, d=string).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _by_hash(windows: list[bytes], most: int) -> list[bytes]:
    """At most so many windows, those of the lowest hashes, whatever their order."""
    return windows if len(windows) <= most else sorted(windows, key=lambda w: (xxhash.xxh3_64_intdigest(w), w))[:most]


def train(rows: list[tuple[str, int]]) -> Model | None:
    """A model from texts and labels; None without both labels. Every third text by hash calibrates, the others make the dictionaries."""
    parts: dict[tuple[bool, int], list[str]] = defaultdict(list)
    for text, label in sorted(rows):
        parts[zlib.crc32(text.encode("utf-8", "surrogatepass")[::-1]) % 3 == 0, label].append(text)
    if not all(parts[False, x] for x in (0, 1)):
        return None
    ordinary = _dictionary(ORDINARY_BYTES, _by_hash([w for t in parts[False, 0] for w in cut_windows(t)], TRAINING_WINDOWS), 64, 8)
    toxic = _dictionary(TOXIC_BYTES, typical(parts[False, 1], parts[False, 0]), 16, 6)
    distance = Distance(ordinary, ordinary + toxic)
    held = [(t, y) for y in (0, 1) for t in (parts[True, y] or parts[False, y])]
    x = np.array([distance.features(t) for t, _ in held])
    y = np.array([y for _, y in held], float)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    return Model(ordinary, ordinary + toxic, _logistic((x - centre) / scale, y), centre, scale)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both classes weigh the same, so a score of one half is where they are equally likely."""
    x = np.c_[np.ones(len(x)), x]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.distance = model, Distance(model.ordinary, model.toxic)

    def score(self, text: str) -> float:
        m = self.model
        x = (self.distance.features(text) - m.centre) / m.scale
        return float(1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled documents whose fold isn't 0: of each class at most sample ids, those with the lowest hashes.

    Ids are chosen first, from labels alone, so documents' texts aren't exchanged; the
    chosen ones are at most 2 * sample rows of SAMPLE_CHARS code points, and of a longer
    text slices from its beginning to its end. A label that is null or neither 0 nor 1
    isn't learned from; of an id with several labels the largest counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.fold_col() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = first[0].unionByName(first[1]).select(F.col("doc_id").cast("long").alias("__id"), "toxic")
    text = F.coalesce(docs["text"], F.lit(""))
    part = SAMPLE_CHARS // SLICES
    slices = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, (F.floor(i * (F.length(text) - part) / (SLICES - 1)) + 1).cast("int"), F.lit(part))), " ")
    shown = F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(slices)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id")).select(shown.alias("text"), "toxic").distinct().orderBy(F.xxhash64("text")).limit(4 * sample)
    model = train([(r.text, r.toxic) for r in rows.toLocalIterator()])
    common.release()
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score is at least one half) added.

    The score depends on the text alone; a null text counts as empty. Without a model
    (no labels of one class) every score is 0. Repeated rows are scored each. Columns of
    docs with the added names are replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at, cols = keep.index("text"), [str(i) for i in range(len(keep))]

    def run(batches):
        scorer = Scorer(held.value) if held.value is not None else None
        for rb in batches:
            s = [scorer.score(t or "") if scorer else 0.0 for t in rb.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s, pa.float64())], names=[*cols, "__score"])

    schema = ", ".join([*(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(cols, keep, strict=True)), "__score double"])
    out = common.by_arrow(docs.select(*(docs[c].alias(n) for c, n in zip(keep, cols, strict=True))), run, schema)
    return out.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(cols, keep, strict=True)), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, without the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value) if held.value is not None else None
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([scorer.score(t or "") if scorer else 0.0 for t in rb.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = common.by_arrow(docs.select(docs["doc_id"], docs["text"]), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (common.fold_col() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
