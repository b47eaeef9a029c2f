from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.llm import common, toxicity


def test_held_out_accuracy_and_odd_rows(spark, odd, none):
    r = random.Random(4)
    plain = ["".join(r.choice(("the", "ing", "er", "an", "tion", "ou", "st")) for _ in range(r.randint(1, 3))) for _ in range(300)]
    bad = ["grumbolous", "vilefrog", "wretchedly", "nastikins"]
    docs, labels = [], []
    for i in range(1500):
        words = [r.choice(plain) for _ in range(r.randint(30, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (4, 7)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    rows = toxicity.scores(df, model).collect()
    held = [x for x in rows if x.held_out]
    assert {x.held_out for x in rows} == {True, False} and all(x.held_out == (common.fold(x.doc_id) == 0) for x in rows)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.95
    out = toxicity.scored(odd, model)
    assert out.count() == odd.count() and out.columns[-2:] == ["score", "predicted"]
    assert toxicity.scores(none, model).collect() == []
    only_one = toxicity.fit(df, lab.where(F.col("toxic") == 1))
    assert only_one is None and {x.score for x in toxicity.scores(odd, only_one).collect()} == {0.0}


def test_windows_hold_all_of_a_text():
    for t in ("", "a", "word " * 50, "x" * 500, "ü" * 70):
        w = toxicity.cut_windows(t)
        assert b"".join(x[: len(x) - 1] if k + 1 < len(w) else x for k, x in enumerate(w)) == b" " + t.encode() + b" "
