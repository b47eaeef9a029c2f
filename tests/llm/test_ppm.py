from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import common, ppm


def model_of(texts):
    counts = defaultdict(Counter)
    for t in texts:
        p = bytes(ppm.ORDER) + t + b"\0"
        for i in range(ppm.ORDER, len(p)):
            for j in range(ppm.ORDER + 1):
                counts[p[i - j : i]][p[i]] += 1
    return counts


def log10_of(counts, history, symbol):
    out, excluded = 0.0, set()
    for j in range(ppm.ORDER, -1, -1):
        here = {a: n for a, n in counts.get(history[len(history) - j :] if j else b"", {}).items() if a not in excluded}
        if not here:
            continue
        n, d = sum(here.values()), len(here)
        if symbol in here:
            return out + math.log10(here[symbol] / (n + d))
        out += math.log10(d / (n + d))
        excluded |= set(here)
    return out - math.log10(256 - len(excluded))


def brute(counts, text):
    p = bytes(ppm.ORDER) + text + b"\0"
    return sum(log10_of(counts, p[i - ppm.ORDER : i], p[i]) for i in range(ppm.ORDER, len(p)))


def test_documents_against_brute_force(spark, odd, none):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcab éx\n") for _ in range(r.randint(0, 60)))) for i in range(150)] + [(x.doc_id, x.text) for x in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    training = [(t or "").encode() for i, t in rows if common.fold(i) != 1]
    counts = model_of(training)
    words = Counter(w for t in training for w in t.lower().split())
    n, v = sum(words.values()) + len(training), len(words) + 1
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        c = [words[x] for x in w] + [len(training)]
        want.append((i, common.fold(i) == 1, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), brute(counts, (t or "").encode())))
    for bound in (ppm.WORDS, 5):  # with few words broadcast, the others come by the join
        got = [tuple(x) for x in ppm.scores(df, words=bound).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, round(x[6], 6))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert ppm.scores(none).collect() == []


def test_probabilities_add_up_to_one_also_when_pruned():
    texts = [b"abracadabra", b"abba", b"cabbage", b"banana band"]
    orders = ppm.orders_of(*_counts(texts))
    pruned = [ppm.Order(o.keys[o.counts >= k + 1], o.counts[o.counts >= k + 1]) for k, o in zip((0, 0, 1, 1, 1, 1), orders, strict=True)]
    for trie in (ppm.Trie(orders), ppm.Trie(pruned)):
        for history in (b"abrac", b"zzzzz", b"banan", b"\0\0\0\0\0"):
            keys = [int.from_bytes(history + bytes([s]), "big") for s in range(256)]
            p = 10 ** trie.log10(ppm.np.array(keys, ppm.np.uint64))
            assert p.sum() == pytest.approx(1)


def _counts(texts):
    return ppm.np.unique(ppm.keys_of(texts)[0], return_counts=True)


def test_portions_of_a_long_text(monkeypatch):
    trie = ppm.Trie(ppm.orders_of(*_counts([b"abracadabra" * 10])))
    text = b"abracadabracab" * 30
    want = ppm._by_text(trie, [text])[0]
    monkeypatch.setattr(ppm, "PORTION", 50)
    assert ppm._by_text(trie, [text])[0] == pytest.approx(want)


def test_scores_are_the_same_whatever_is_broadcast(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, "".join(r.choice("abcdé \n") for _ in range(r.randint(0, 80)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = model_of([t.encode() for i, t in rows if common.fold(i) != 1])
    want = {i: brute(counts, t.encode()) for i, t in rows}
    monkeypatch.setattr(ppm, "PART_KEYS", 300)  # several partitions of the trie
    for nodes in (0, 40, ppm.NODES):
        assert {x.doc_id: x.score for x in ppm.scores(df, nodes=nodes).collect()} == pytest.approx(want)


def test_a_trie_without_its_suffixes_fails():
    orders = ppm.orders_of(*_counts([b"abracadabra"]))
    orders[2] = ppm.Order(orders[2].keys[1:], orders[2].counts[1:])
    with pytest.raises(ValueError):
        ppm.Trie(orders)
