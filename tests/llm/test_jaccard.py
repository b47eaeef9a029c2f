from __future__ import annotations

import random

import numpy as np

from tessera.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    parts: dict[int, list] = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in parts.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df).collect()), key=repr)


def edits(r, words, most):
    out = list(words)
    for _ in range(r.randint(0, most)):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return " ".join(out)


def test_against_brute_force_with_large_groups(spark):
    r = random.Random(7)
    rows, k = [], 0
    shared = [f"s{i}" for i in range(55)]
    for size, most in ((140, 9), (60, 3), (30, 7), (5, 5)):
        base = [f"b{k}_{i}" for i in range(120)]
        for _ in range(size):
            rows.append((k, edits(r, base, most)))
            k += 1
    for _ in range(60):  # a passage that many share, and near copies of near copies
        rows.append((k, " ".join([*shared, *(f"u{r.randrange(10**6)}" for _ in range(60))])))
        k += 1
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain = chain[2:] + [f"d{i}_0", f"d{i}_1"]
        rows.append((k, " ".join(chain)))
        k += 1
    rows += [(k + i, rows[i * 3][1]) for i in range(40)]
    r.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_odd_texts(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(spark, rows) == brute(rows)
    assert jaccard.joined(none).collect() == []


def test_every_text_alike(spark):
    rows = [(i, "the very same text in every row of it") for i in range(300)]
    assert {c for _, _, c in got(spark, rows)} == {0}


def test_large_classes_and_hubs_stay_in_place(spark, monkeypatch):
    from tessera.llm import common

    r = random.Random(6)
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, edits(r, base, 4)) for i in range(70)] + [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, " ".join(f"x{r.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    assert got(spark, rows) == brute(rows)


def test_hot_lists(spark, monkeypatch):
    r = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, edits(r, base, 8)) for i in range(120)] + [(1000 + i, " ".join(f"x{r.randrange(10**6)}" for _ in range(50))) for i in range(60)]
    monkeypatch.setattr(jaccard, "HOT", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    assert got(spark, rows) == brute(rows)


def test_need_and_prefix():
    for a in range(1, 60):
        for b in range(1, 60):
            i = jaccard.need(a, b)
            assert 4 * i >= 3 * (a + b - i) and 4 * (i - 1) < 3 * (a + b - i + 1)
    assert jaccard.prefix(0) == 0 and jaccard.prefix(1) == 1


def test_packed_sets_come_back():
    s = np.unique(np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    assert (jaccard.unpacked(jaccard.packed(s)) == s >> np.uint64(16)).all()


def test_blocks_by_position_lose_no_pair_that_may_be_linked():
    r = np.random.default_rng(2)
    for _ in range(60):
        m = int(r.integers(2, 90))
        n = np.sort(r.integers(5, int(r.choice([9, 40, 200])), m))
        rest = np.maximum(1, n - r.integers(0, np.maximum(1, n // 3)))
        parts = jaccard._by_position(np.arange(m), n, rest)
        home = {int(x): k for k, p in enumerate(parts) for x in p}
        for i in range(m):
            for j in range(i):
                if min(rest[i], rest[j]) >= jaccard.need(n[i], n[j]) and 4 * n[j] >= 3 * n[i]:
                    assert i in home and home[i] == home.get(j)
    # a passage that stands far back in all sets makes no pairs at all
    assert jaccard._by_position(np.arange(500), np.full(500, 100), np.full(500, 76)) == []


def test_bands_lose_no_pair_that_may_be_linked(spark):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        size, c = int(r.integers(20, 400)), int(r.integers(0, 1500))
        d = int(r.integers(0, c + 1))
        if 3 * c <= 4 * d + 3 * size:
            rows.append((jaccard.band(c, size), jaccard.band(d, size)))
    df = spark.createDataFrame(rows, "i int, j int")
    assert rows and df.where(~((df["j"] <= df["i"]) & jaccard.near_bands(df["i"], df["j"]))).count() == 0


def test_two_sets_with_one_first_number(spark, monkeypatch):
    """Where a class's first number is another's, too, both are told apart by their second."""
    s = [jaccard.shingles(f"one two three four five {x}") for x in ("six", "seven")]
    assert jaccard.number_of(s[0], frozenset()) == jaccard.class_of(s[0])[0]
    clash = frozenset(jaccard.class_of(x)[0] for x in s)
    assert len({jaccard.number_of(x, clash) for x in s} | clash) == 4


def test_counts_stay_at_the_largest_number():
    a = np.array([0, 2**32 - 2], np.uint32)
    jaccard._add(a, b"4" + np.array([7, 9], np.uint32).tobytes())
    assert a.tolist() == [7, 2**32 - 1]
    assert jaccard.bucket_bits(0) == jaccard.LEAST_BITS and jaccard.bucket_bits(1 << 60) == jaccard.MOST_BITS
    assert (np.diff(jaccard.scale(np.arange(1000)).astype(int)) >= 0).all()
