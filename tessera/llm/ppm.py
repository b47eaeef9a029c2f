"""Language-model scores by prediction by partial matching over bytes.

Counts of every context of up to ORDER bytes and the byte after it are gathered over
the whole training part. They form a trie; what follows a context is predicted from
its longest suffix there. A byte not seen there costs an escape (method C: as likely as
the number of different bytes seen) to the next shorter context, where the bytes
already ruled out are excluded from counts and from the escape. Beneath the empty
context, the bytes never seen are equally likely.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of context at most; with the byte that follows a key has six bytes.
ORDER = 5
#: Six-byte keys whose probabilities are broadcast at most, those of the highest counts; the others' come by a join, so the bound is one of memory alone.
NODES = 1 << 21
#: Six-byte keys in a partition of the trie, about.
PART_KEYS = 1 << 18
#: Bytes of context by which the trie is dealt out; what shorter contexts predict all partitions have.
SHARED = 3
#: Words whose counts are broadcast at most; the counts of the others are joined.
WORDS = 1 << 20
#: Bytes and words counted at a time before they are summed up.
PORTION = 1 << 22
#: Bytes of texts scored at a time, where no text alone is longer.
SCORED = 1 << 19
TRAINING_FOLD_OUT = 1

_U = np.uint64


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte key that ends at each byte and at each text's end mark (a zero byte), and each text's number of keys."""
    pad = b"\x00" * ORDER
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\x00")]), np.uint8).astype(_U)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    key = data.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= data[:-k] << _U(8 * k)
    starts = np.cumsum(lengths + ORDER) - lengths
    keep = np.ones(len(data), bool)
    for k in range(1, ORDER + 1):
        keep[starts - k] = False
    return key[keep], lengths


class Sums:
    """Counts by key, summed up whenever PORTION of them have come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= PORTION:
            self.sum_up()

    def sum_up(self) -> None:
        if not self.size:
            return
        new = np.sort(np.concatenate(self.waiting))
        first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
        keys, counts = new[first], np.diff(np.r_[first, len(new)])
        if len(self.keys):
            keys, counts = np.r_[self.keys, keys], np.r_[self.counts, counts]
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts, self.waiting, self.size = keys, counts, [], 0


def count(docs: DataFrame) -> DataFrame:
    """Counts over the texts of docs: rows (kind, key, n), kind 0 for six-byte keys and 1 for words."""

    def run(batches):
        grams, vocabulary = Sums(), Sums()
        for rb in batches:
            part: list[bytes] = []
            size = 0
            for t in [*common.texts(rb), None]:
                if t is not None:
                    part.append(t.encode("utf-8", "surrogatepass"))
                    size += len(part[-1])
                if part and (t is None or size >= PORTION):
                    grams.add(keys_of(part)[0])
                    for b in part:
                        vocabulary.add(common.word_hashes(b.lower().split()))
                    part, size = [], 0
        for kind, sums in enumerate((grams, vocabulary)):
            sums.sum_up()
            for a in range(0, len(sums.keys), 100_000):
                k = sums.keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(sums.counts[a : a + 100_000])], names=["kind", "key", "n"])

    return common.by_arrow(docs.select("text"), run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def at_most(counts: DataFrame, bound: int) -> DataFrame:
    """The rows of the highest counts, all rows of a count together, as long as they are bound at most."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    if counts.count() <= bound:
        return counts
    # how many counts there are is at most the root of twice their sum
    least, total = 1, 0
    for r in sizes.orderBy(F.desc("n")).toLocalIterator():
        total += r.rows
        if total > bound:
            least = r.n + 1
            break
    return counts.where(F.col("n") >= least)


class Order(NamedTuple):
    """One order of the trie: keys (context and byte) and counts; contexts with their number."""

    keys: np.ndarray
    counts: np.ndarray


class Table:
    """A hash table from 64-bit keys to places, looked up for many keys at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        left = np.flatnonzero(~hit & (got >= 0))
        mask = (1 << self.bits) - 1
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            go = ~hit & (got >= 0)
            left, at = left[go], at[go]
        return out


class Trie:
    """Contexts of every order with what they predict, in logarithms to base 10."""

    def __init__(self, orders: list[Order]) -> None:
        """orders[k] has the contexts of k bytes, as low bytes of the key above the last."""
        self.entries, self.log_count, self.contexts = [], [], []
        self.top_all, self.top_escape, self.below_all, self.below_escape = [], [], [], []
        lower_n = lower_d = lower_counts = None
        for k, o in enumerate(orders):
            order = np.argsort(o.keys)
            keys, counts = o.keys[order], o.counts[order].astype(np.float64)
            own = keys >> _U(8)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(keys) else np.zeros(0, np.int64)
            contexts = own[first]
            n = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            d = np.diff(np.r_[first, len(keys)]).astype(np.float64)
            self.top_all.append(np.log10(n + d))
            self.top_escape.append(np.log10(d) - np.log10(n + d))
            if k == 0:
                # beneath the empty context: the bytes not seen are equally likely
                self.below_all.append(np.full(len(d), np.log10(np.maximum(256 - d, 1))))
                self.below_escape.append(np.zeros(len(d)))
            else:
                at = self.contexts[k - 1].find(contexts & _U((1 << (8 * (k - 1))) - 1))
                inner = self.entries[k - 1].find(keys & _U((1 << (8 * k)) - 1))
                if (at < 0).any() or (inner < 0).any():
                    raise ValueError(f"order {k} has keys whose suffixes order {k - 1} lacks")
                ruled_out = np.add.reduceat(lower_counts[inner], first) if len(first) else np.zeros(0)
                left_n, left_d = lower_n[at] - ruled_out, lower_d[at] - d
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.below_all.append(np.where(left_d > 0, np.log10(left_n + left_d), 0.0))
                    self.below_escape.append(np.where(left_d > 0, np.log10(left_d) - np.log10(left_n + left_d), 0.0))
            self.entries.append(Table(keys))
            self.log_count.append(np.log10(counts))
            self.contexts.append(Table(contexts))
            lower_n, lower_d, lower_counts = n, d, counts

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after its first ORDER."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        above = np.full(len(keys), -1, np.int32)  # the context that rules bytes out, one order up
        for k in range(len(self.entries) - 1, -1, -1):
            if not len(open_):
                return out
            key = keys[open_] & _U((1 << (8 * (k + 1))) - 1)
            at = self.entries[k].find(key)
            hit = at >= 0
            got, a = open_[hit], at[hit]
            up = above[got]
            top = up < 0
            value = self.log_count[k][a]
            if top.any():
                c = self.contexts[k].find(key[hit][top] >> _U(8))
                value[top] -= self.top_all[k][c]
            if not top.all():
                value[~top] -= self.below_all[k + 1][up[~top]]
            out[got] += value
            miss = ~hit
            open_, key = open_[miss], key[miss]
            if not len(open_):
                return out
            c = self.contexts[k].find(key >> _U(8))
            known = c >= 0
            up = above[open_]
            first = known & (up < 0)
            out[open_[first]] += self.top_escape[k][c[first]]
            later = up >= 0
            if later.any():
                out[open_[later]] += self.below_escape[k + 1][up[later]]
            above[open_] = np.where(known, c, -1)
        up = above[open_]
        known = up >= 0
        out[open_[known]] -= self.below_all[0][up[known]]
        out[open_[~known]] -= np.log10(256)
        return out


def orders_of(keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    """All orders' counts from those of the longest keys."""
    out = [Order(keys, counts)]
    for k in range(ORDER, 0, -1):
        low = out[0].keys & _U((1 << (8 * k)) - 1)
        order = np.argsort(low, kind="stable")
        low, c = low[order], out[0].counts[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        out.insert(0, Order(low[first], np.add.reduceat(c, first) if len(first) else c))
    return out


def lowest(counts: DataFrame) -> list[Order]:
    """The orders of fewer bytes of context than SHARED, from counts of six-byte keys. The last of them has a key for each different string of SHARED bytes, far fewer than the 16 million there could be."""
    t = counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * SHARED)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    return orders_of(t.column("key").to_numpy().view(_U), t.column("n").to_numpy())[:SHARED]


def predicted(rows: DataFrame, low: list[Order], n_rows: int) -> DataFrame:
    """(key, value): the log10 probability, under the whole trie, of each key that is asked for.

    rows (key, n, asked) have every six-byte key of the corpus with its count, and with
    n = 0 whatever else is asked for. A key is predicted from contexts that end in the same
    SHARED bytes, so the trie is dealt out by these: a partition has all of them and their
    counts. Of the orders beneath, which all partitions share, each has the lowest().
    """
    shared = rows.sparkSession.sparkContext.broadcast([tuple(o) for o in low])

    def run(batches):
        keys, counts, asked = [], [], []
        for rb in batches:
            key, n = rb.column(0).to_numpy().view(_U), rb.column(1).to_numpy()
            keys.append(key[n > 0])
            counts.append(n[n > 0])
            asked.append(key[rb.column(2).to_numpy(zero_copy_only=False).astype(bool)])
        if not any(map(len, asked)):
            return
        trie = Trie([Order(*o) for o in shared.value] + orders_of(np.concatenate(keys), np.concatenate(counts))[SHARED:])
        for a in asked:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(trie.log10(a))], names=["key", "value"])

    dealt = rows.select("key", "n", "asked").repartition(max(1, -(-n_rows // PART_KEYS)), F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * SHARED)) - 1)))
    return common.by_arrow(dealt, run, "key long, value double")


class Known:
    """Values of some keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.table, self.values = Table(keys), np.r_[values, 0.0]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, 0 where it isn't known, and whether it is."""
        at = self.table.find(keys)
        return self.values[at], at >= 0


_HELD: dict[str, tuple[Known, Known]] = {}

_PART = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("open", pa.list_(pa.int64())), ("open_times", pa.list_(pa.int64()))])


def scores(docs: DataFrame, nodes: int = NODES, words: int = WORDS) -> DataFrame:
    """Scores of each document under the trie, and under a unigram model of its words, both from the documents of folds other than 1.

    score is the log10 probability of the text's UTF-8 and an end mark. A null text
    counts as empty: its end alone is scored, and its one token is the end. Repeated
    rows are scored each, and counted each in training; a null doc_id is of the fold of
    empty text. Without training documents every byte is as likely as any other.

    The probabilities of the commonest six-byte keys (nodes at most) and the counts of the
    commonest words are broadcast, both of bounded size; what the other keys and words
    have comes by a join, so that every count is exact whatever the bounds. Rare keys and
    words are in few documents, so no key of those joins is large, but for words of
    held-out documents alone, where Spark splits a large key's rows.
    """
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    training = d.where(common.fold_col() != TRAINING_FOLD_OUT)
    counts = common.cut(count(training.select("text")))
    grams = counts.where("kind = 0").select("key", "n")
    n_grams, low = grams.count(), lowest(grams)
    common_grams = at_most(grams, nodes)
    least = 1 if n_grams <= nodes else common_grams.agg(F.min("n")).first()[0]
    common_grams = predicted(grams.withColumn("asked", F.lit(False) if least is None else F.col("n") >= least), low, n_grams).toArrow()
    vocabulary = counts.where("kind = 1").select("key", "n")
    n_docs = training.count()
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)
    common_words = at_most(vocabulary, words).toArrow()
    held = spark.sparkContext.broadcast((common_grams.column("key").to_numpy().view(_U), common_grams.column("value").to_numpy(), common_words.column("key").to_numpy().view(_U), common_words.column("n").to_numpy()))
    scale = total + 0.5 * (distinct + 1)
    key_of_model = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        if key_of_model not in _HELD:
            _HELD.clear()
            keys, values, word_keys, n = held.value
            _HELD[key_of_model] = (Known(keys, values), Known(word_keys, np.log10((n + 0.5) / scale)))
        of_grams, of_words = _HELD[key_of_model]
        end = float(np.log10((n_docs + 0.5) / scale))
        rid = TaskContext.get().partitionId() << 40
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in _PART}
            cols["doc_id"] = rb.column(0).to_pylist()
            every = [t.encode("utf-8", "surrogatepass") for t in common.texts(rb)]
            cols["rid"] = list(range(rid, rid + len(every)))
            rid += len(every)
            a = 0
            while a < len(every):
                b, size = a, 0
                while b < len(every) and (b == a or size < SCORED):
                    size += len(every[b])
                    b += 1
                for score, left, times in _known_by_text(of_grams, every[a:b]):
                    cols["score"].append(score)
                    cols["open"].append(left.view(np.int64))
                    cols["open_times"].append(times)
                a = b
            for t in every:
                h, times = np.unique(common.word_hashes(t.lower().split()), return_counts=True)
                values, known = of_words.find(h)
                cols["n_tokens"].append(int(times.sum()) + 1)
                cols["n_known"].append(int(times[known].sum()) + (n_docs > 0))
                cols["base"].append(float((times * values).sum()) + end)
                cols["rare"].append(h[~known].view(np.int64))
                cols["times"].append(times[~known].astype(np.int32))
            yield common.batch(_PART, cols)

    path = common.fresh_path(spark, "ppm")
    common.by_arrow(d, run, "rid long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>, open array<long>, open_times array<long>").write.parquet(path)
    part = spark.read.parquet(path)
    rare = part.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    joined = rare.join(vocabulary, "key", "left").select("rid", (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / scale)).alias("base"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"))
    more = joined.groupBy("rid").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"))
    left = part.select("rid", F.explode(F.arrays_zip("open", "open_times")).alias("x")).select("rid", F.col("x.open").alias("key"), F.col("x.open_times").alias("times"))
    asked = common.cut(left.select("key").distinct())
    rows = grams.withColumn("asked", F.lit(False)).unionByName(asked.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    value = predicted(rows, low, n_grams + asked.count())
    rest = left.join(value, "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("value")).alias("more_score"))
    return part.select("rid", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "rid", "left").join(rest, "rid", "left").select(
        "doc_id",
        (common.fold_col() == TRAINING_FOLD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _portions(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of texts and how many each has; a very long text is taken alone and in portions, so that memory stays bounded."""
    if len(texts) == 1 and len(texts[0]) > 4 * PORTION:
        t = texts[0]
        for a in range(0, len(t) + 1, PORTION):
            part = t[max(0, a - ORDER) : a + PORTION] + (b"\x00" if a + PORTION > len(t) else b"")
            part = b"\x00" * max(0, ORDER - a) + part
            data = np.frombuffer(part, np.uint8).astype(_U)
            key = data.copy()
            for k in range(1, ORDER + 1):
                key[k:] |= data[:-k] << _U(8 * k)
            yield key[ORDER:], np.array([len(key) - ORDER])
    elif texts:
        yield keys_of(texts)


def _by_text(trie: Trie, texts: list[bytes]) -> list[float]:
    """Each text's score under a whole trie."""
    out = np.zeros(len(texts))
    for keys, lengths in _portions(texts):
        out += np.add.reduceat(trie.log10(keys), np.cumsum(lengths) - lengths)
    return out.tolist()


def _known_by_text(known: Known, texts: list[bytes]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Each text's score as far as its keys are known, the keys that aren't, and how often it has these."""
    scores = np.zeros(len(texts))
    left: list[list[np.ndarray]] = [[] for _ in texts]
    for keys, lengths in _portions(texts):
        values, hit = known.find(keys)
        ends = np.cumsum(lengths)
        scores += np.add.reduceat(values, ends - lengths)
        at = np.flatnonzero(~hit)
        cuts = np.searchsorted(at, np.r_[0, ends])
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            left[i].append(keys[at[cuts[i] : cuts[i + 1]]])
    empty = np.zeros(0, _U), np.zeros(0, np.int64)
    return [(s, *(np.unique(np.concatenate(x), return_counts=True) if x else empty)) for s, x in zip(scores.tolist(), left, strict=True)]
