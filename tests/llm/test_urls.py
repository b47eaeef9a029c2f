from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import urls as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.shown), default=None)
    return host, path, best and best.shown, best and best.verdict


def test_rules(spark):
    every = [None, "", "x", "http://", "HTTP://Ä.Example.COM/en/7?x#y", "http://a.example.com/en/71", "http://example.com/en/6", "http://notexample.com/en/7", "https://com/en/", "ftp://a.net/de/8", "http://b.example.net/de/8/x", "http://net?/de/", "http://q.org#/es/", "http://q.org/es", "http://q.org/es/://x", "a://b://c/en/", "http://u.com/\nen/", "http://x.com\n/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(every)], "page_id long, url string")
    host, path = U.split(F.col("url"))
    d = df.withColumns({"host": host, "path": path})
    rule, verdict = U.ruled(F.col("host"), F.col("path"))
    for r in d.select("url", "host", "path", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url


def test_models_tell_classes_apart_and_sum_to_one(spark):
    r = random.Random(1)
    rows, k = [], 0
    for _ in range(400):
        rows.append((k, f"http://{'pills' if r.random() < 0.9 else 'site'}{r.randrange(99)}.com/en/{r.randrange(999)}"))
        rows.append((k + 1, f"http://{'garden' if r.random() < 0.9 else 'site'}{r.randrange(99)}.net/de/{r.randrange(999)}"))
        k += 2
    rows += [(k + 1, "http://pills7.org/xx/5"), (k + 2, "http://garden7.org/xx/5"), (k + 3, None)]
    out = {x.page_id: x for x in U.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == len(rows) and out[0].verdict == "block" and out[1].verdict == "allow" and out[0].score is None
    assert out[k + 1].score > out[k + 2].score and out[k + 1].verdict == "block" and out[k + 2].verdict == "allow" and out[k + 3].host == ""
    m = U.Markov()
    for u in (b"abcab", b"abd", b"xab"):
        m.learn(u)
    f = m.frozen()
    total = 0.0
    for b in range(256):
        key, p, c = b"\0\0ab", 0.0, 4
        while c >= 0:
            ctx = key[4 - c :] if c else b""
            if (x := f.get(ctx + bytes([b]))) is not None:
                p += x
                break
            p += f.get(ctx + b"\xff\xff", 0.0)
            c -= 1
        else:
            p += U._UNSEEN
        total += 2**p
    assert total == pytest.approx(256 / 257 + 1 / 257, abs=0.01)


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "http://a.info/x"), (1, "http://a.info/x"), (None, None)], "page_id long, url string")
    assert [x.verdict for x in U.judged(rows).collect()] == ["allow"] * 3
    assert U.fit(rows.select("url", F.lit("x").alias("verdict")))[1] == math.inf
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def chance(counts, context, byte):
    """The interpolated chance of a byte after a context, straight from the counts."""
    lower = chance(counts, context[1:], byte) if context else 1 / 257
    follow = counts.get(context)
    return (follow[byte] + len(follow) * lower) / (sum(follow.values()) + len(follow)) if follow else lower


def counted(urls):
    counts = defaultdict(Counter)
    for u in urls:
        p = bytes(U.ORDER) + u + b"\0"
        for i in range(U.ORDER, len(p)):
            for k in range(U.ORDER + 1):
                counts[p[i - k : i]][p[i]] += 1
    return counts


def score_of(models, url):
    p = bytes(U.ORDER) + url + b"\0"
    each = [sum(math.log2(chance(m, p[i - U.ORDER : i], p[i])) for i in range(U.ORDER, len(p))) for m in models]
    return (each[1] - each[0]) / (len(url) + 1)


def test_whole_query_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    rows = [(i, r.choice([f"http://{word()}.com/en/{word()}", f"https://{word()}.net/de/{word()}?q", f"http://{word()}.org/es/{word()}#x", f"http://{word()}.info/{word()}", word(), "", None])) for i in range(260)]
    rows += [(7, rows[7][1]), (None, "http://a.info/b"), (None, None)]
    ruled = {u: brute(u)[3] for _, u in rows if brute(u)[3] is not None}
    split = {u: xxhash.xxh3_64_intdigest(u.encode()) % 5 == 0 for u in ruled}
    models = [counted([u.encode() for u, v in ruled.items() if v == which and not split[u]]) for which in U.VERDICTS]
    held = sorted((score_of(models, u.encode()), v == "block") for u, v in ruled.items() if split[u])
    bad, good = [x for x, b in held if b], [x for x, b in held if not b]
    errors = [sum(b for _, b in held[:i]) / len(bad) + sum(not b for _, b in held[i:]) / len(good) for i in range(len(held) + 1)]
    best = [i for i, e in enumerate(errors) if e <= min(errors) + 1e-12]
    cut = best[len(best) // 2]
    threshold = held[0][0] - 1 if cut == 0 else held[-1][0] + 1 if cut == len(held) else (held[cut - 1][0] + held[cut][0]) / 2
    df = spark.createDataFrame([(*x, "clash", 1.0, "h") for x in rows], "page_id long, url string, rule string, score double, host string").repartition(3)
    out = U.judged(df).collect()
    got = sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in out), key=repr)
    said = lambda u: brute(u)[3] or U.VERDICTS[score_of(models, (u or "").encode()) > threshold]
    assert got == sorted(((i, *brute(u)[:3], said(u)) for i, u in rows), key=repr)
    scores = {x.page_id: x.score for x in out if x.page_id is not None and x.score is not None}
    assert scores and all(scores[i] == pytest.approx(score_of(models, (u or "").encode())) for i, u in rows if i in scores)
