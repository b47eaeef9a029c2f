from __future__ import annotations

import random

import numpy as np

from tessera.llm import decontamination as D


def brute_overlap(same, least, share):
    best = None
    for i in range(len(same)):
        for j in range(i + least, len(same) + 1):
            if same[i] and same[j - 1] and sum(same[i:j]) >= share * (j - i) - 1e-9 and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
    return best


def test_best_overlap_against_brute_force():
    r = random.Random(5)
    for _ in range(400):
        same = np.array([r.random() < r.choice((0.5, 0.85, 0.95)) for _ in range(r.randint(1, 50))])
        got, want = D.best_overlap(same, 8, 0.8), brute_overlap(list(same), 8, 0.8)
        assert (got is None) == (want is None)
        if got:
            assert got[1] - got[0] == want[1] - want[0]


def sentence(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def test_planted_passages_with_substitutions(spark, odd, none):
    r = random.Random(2)
    items = [(i, sentence(r, r.randint(16, 60))) for i in range(30)]
    items += [(50, "Short, but whole!".split()), (51, [])]
    docs, planted = [], set()
    for d in range(120):
        words = sentence(r, r.randint(20, 200))
        if d % 3 == 0:
            k, passage = items[r.randrange(30)]
            passage = list(passage)
            for p in range(5, len(passage), 9):  # one word in nine
                passage[p] = "changed"
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in passage]
            planted.add((d, k))
        docs.append((d, " ".join(words)))
    docs.append((500, "it is Short but whole, as items go"))
    docs.append((501, "Short but broken"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(60, None), (61, "?!")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in D.contaminated(df, it).collect()}
    assert set(found) == planted | {(500, 50)}
    assert all(x.n_same >= D.LEAST_SHARE * x.n_tokens for x in found.values())
    assert D.contaminated(odd, it).collect() == []
    assert D.contaminated(none, it).collect() == []
    assert D.contaminated(df, it.limit(0)).collect() == []


def patterns():
    """Agreements of overlaps that count, without five in a row: runs of four at most between substitutions.

    With ten runs or more two of four stand side by side, as four in five agree.
    """

    def runs_of(k, spare):
        if not k:
            yield ()
            return
        for r in range(max(0, 4 - spare), 5):
            yield from ((r, *rest) for rest in runs_of(k - 1, spare - 4 + r))

    for s in range(1, 9):
        spare = 4 * (s + 1) - max(D.LEAST_TOKENS, 4 * s)
        yield from ("0".join("1" * r for r in runs) for runs in (runs_of(s + 1, spare) if spare >= 0 else ()) if runs[0] and runs[-1])


def test_masks_hit_every_overlap_that_counts():
    hit = lambda p, m: any(all(p[i + j] == "1" for j, c in enumerate(m) if c == "1") for i in range(len(p) - len(m) + 1))
    assert all(any(hit(p, m) for m in D.MASKS) for p in ["11111", "111101111", *patterns()])


def brute_rows(docs, items):
    """{(doc, item): length of the longest overlap}"""
    out = {}
    for d, a in docs:
        for t, b in items:
            best = 0
            for diagonal in range(1 - len(b), len(a)):
                same = [0 <= diagonal + k < len(a) and a[diagonal + k] == b[k] for k in range(len(b))]
                for i in range(len(same)):
                    for j in range(i + D.LEAST_TOKENS, len(same) + 1):
                        n = sum(same[i:j]) if same[i] and same[j - 1] else 0
                        if n >= D.LEAST_TOKENS and 5 * n >= 4 * (j - i):
                            best = max(best, j - i)
            if best:
                out[d, t] = best
    return out


def test_random_substitutions_against_brute_force(spark):
    r = random.Random(4)
    items = [(i, sentence(r, r.randint(15, 30))) for i in range(12)]
    docs = []
    for d in range(240):
        passage = [w if r.random() < 0.8 else "changed" for w in items[d % 12][1]]
        docs.append((d, [*sentence(r, 3), *passage, *sentence(r, 3)]))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = brute_rows(docs, items)
    assert len(want) > 80 and {(x.doc_id, x.item_id): x.n_tokens for x in D.contaminated(df, it).collect()} == want


def test_a_shorter_overlap_counts_where_the_longest_has_too_few_that_agree():
    same = np.array([c == "1" for c in "110111101111011" + "0" * 20 + "1111111111111"])
    assert D.best_overlap(same, 13, 0.8) == (0, 15)
    assert D.overlap(same) == (35, 48)


def test_a_long_overlap_is_found_whole(spark, monkeypatch):
    r = random.Random(6)
    item = sentence(r, 500)
    passage = [w if k % 10 else "changed" for k, w in enumerate(item, 5)]
    passage[200:240] = ["other"] * 40  # a gap without hits
    docs = [(1, " ".join([*sentence(r, 70), *passage, *sentence(r, 30)])), (None, " ".join(item)), (2, " ".join(sentence(r, 100)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(item)), (None, " ".join(item[100:130])), (8, "short item")], "item_id long, text string")
    same = [a == b for a, b in zip(passage, item, strict=True)]
    want = {(1, 7): (70, 0, 500, sum(same)), (None, 7): (0, 0, 500, 500), (1, None): (170, 0, 30, sum(same[100:130])), (None, None): (100, 0, 30, 30)}
    assert same[0] and same[-1] and same[100] and same[129]
    for rows in (D.BROADCAST_ROWS, 0):
        monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
        assert {(x.doc_id, x.item_id): tuple(x)[2:] for x in D.contaminated(df, it).collect()} == want


def test_tokens_of_other_scripts_and_punctuation():
    same = lambda a, b: D.tokens(a).tolist() == D.tokens(b).tolist()
    assert same("“Große” — ÄRGER…", '"große" - ärger...') and same("it’s", "it's")
    assert len(D.tokens("今天天气很好。")) == 6 and len(D.tokens("Привет, мир!")) == 2 and len(D.tokens("カタカナ word")) == 5
