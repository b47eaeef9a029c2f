from __future__ import annotations

from collections import Counter

import numpy as np

from tessera.llm import sharding


def test_matrix_has_its_sums():
    counts, sizes = [7, 0, 12, 1, 30], [10, 10, 10, 10, 10]
    rows = np.array([sharding.row_of(3, counts, sizes, p) for p in range(len(counts))])
    assert rows.sum(1).tolist() == counts and rows.sum(0).tolist() == sizes


def test_matrix_is_hypergeometric():
    # 2 rows from a partition of 2 of 4 into shards of 2: none, one or two meet with chances 1/6, 4/6, 1/6
    n = Counter(int(sharding.row_of(seed, [2, 2], [2, 2], 0)[0]) for seed in range(3000))
    assert abs(n[0] / 3000 - 1 / 6) < 0.03 and abs(n[1] / 3000 - 4 / 6) < 0.03


def test_law_round_trip_and_uniformity(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'x' AS shard").repartition(7)
    seen = Counter()
    for seed in range(8):
        rows = sharding.shuffle(df, 6, seed=seed, block_bytes=2_000).collect()
        assert sorted(r.doc_id for r in rows) == list(range(1000)) and all(r.text == f"text {r.doc_id}" for r in rows)
        for s in range(6):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots))) and len(slots) in (166, 167)
        seen.update((r.doc_id % 2, r.shard) for r in rows)
    assert max(seen.values()) < 1.25 * min(seen.values())


def test_odd_rows(spark, odd, none):
    rows = sharding.shuffle(odd, 5).collect()
    assert len(rows) == odd.count() and max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1
    assert sharding.shuffle(none, 5).collect() == []


def test_large_classes_are_drawn_exactly_in_sum():
    rng = np.random.default_rng(0)
    out = sharding._draw(rng, np.array([3 * 10**9, 10**9, 5], np.int64), 2 * 10**6)
    assert out.sum() == 2 * 10**6 and abs(out[0] / out[1] - 3) < 0.05


def test_draws_beyond_numpys_own():
    rng = np.random.default_rng(3)
    for good, bad, n in ((4 * 10**9, 6 * 10**9, 10**9), (10**12, 10**13, 7 * 10**9), (10**10, 3, 10**10), (10**6, 10**13, 10**12), (5, 10**10, 10**10 - 1)):
        draws = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(12)], float)
        total = good + bad
        mean, var = n * good / total, n * (good / total) * (bad / total) * (total - n) / (total - 1)
        assert (draws >= max(0, n - bad)).all() and (draws <= min(n, good)).all()
        assert abs(draws.mean() - mean) <= 6 * (var / len(draws)) ** 0.5 + 1
    # the inversion has numpy's distribution where both can draw
    own = np.array([sharding._by_mode(rng, 300, 900, 200) for _ in range(4000)])
    theirs = rng.hypergeometric(300, 900, 200, 4000)
    assert abs(own.mean() - theirs.mean()) < 0.6 and 0.9 < own.var() / theirs.var() < 1.1
