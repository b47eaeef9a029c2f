from __future__ import annotations

import hashlib
import random

import numpy as np

from tessera.llm import chunking as C


def brute_boundaries(data: bytes):
    ends, start, h = [], 0, 0
    hashes = []
    for b in data:
        h = (h << 1) + int(C.GEAR[b]) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(data):
        if len(data) - start <= C.LEAST:
            ends.append(len(data))
            break
        cut = min(start + C.MOST, len(data))
        for at in range(start + C.LEAST, cut):
            mask = C._STRICT if at < start + C.WANTED else C._LOOSE
            if hashes[at - 1] & int(mask) == 0:
                cut = at
                break
        ends.append(cut)
        start = cut
    return ends


def text(r, n):
    return "".join(r.choice("abcdefgh ijkl\nüé") for _ in range(n))


def test_boundaries_against_brute_force(monkeypatch):
    r = random.Random(1)
    for stride in (C.STRIDE, 100):
        monkeypatch.setattr(C, "STRIDE", stride)
        for n in (0, 1, 31, 32, 33, 200, 3000):
            data = text(r, n).encode()
            assert C.boundaries(data) == brute_boundaries(data)


def test_shift_resistance():
    r = random.Random(2)
    t = text(r, 5000)
    a, b = C.chunks(t.encode()), C.chunks((t[:100] + "inserted words" + t[100:]).encode())
    assert C.likeness(a, b) > 0.85 and C.likeness(a, C.chunks(text(r, 5000).encode())) < 0.05
    assert C.read(C.show(a)) == a


def test_against_brute_force(spark, odd, none):
    r = random.Random(3)
    rows = [(i * 3, text(r, r.choice((0, 5, 300, 2000)))) for i in range(60)]
    for buckets in (1, 2, 7, 100):
        check(spark, rows, buckets)
    check(spark, [(x.doc_id, x.text) for x in odd.collect()], 3)
    check(spark, [(5, "alone")], 4)
    check(spark, [(None, "a"), (None, "b")], 4)
    check(spark, [(1, "same id"), (1, "same id too"), (2, "z"), (0, None)], 3)
    assert C.compare_with_next(none).collect() == []


def check(spark, rows, buckets):
    order = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (C.chunks(x.encode()) for x in (t, new, following))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), C.show(a), C.show(b), C.likeness(a, b), C.likeness(a, c)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in C.compare_with_next(df, buckets).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints(spark, odd):
    rows = C.fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(x.fingerprint == C.show(C.chunks((x.text or "").encode())) for x in rows)


def test_gear_hash_is_of_the_last_32_bytes():
    data = np.random.default_rng(0).integers(0, 256, 100).astype(np.uint8)
    assert (C.gear_hashes(data)[60:] == C.gear_hashes(data[20:])[40:]).all()
