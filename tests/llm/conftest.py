from __future__ import annotations

import pytest

#: Documents with what each operator has to get through: null, empty and blank texts, ties, repeated rows, other scripts.
TEXTS = [None, "", "   \n\t", "one", "one two three", "Ünïcödé straße 日本語 😀 mixed", "a" * 3000, "same words again and again " * 40, "same words again and again " * 40]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", None, None, None, "clash"), (3, "one", "en", "src0", 3, "clash"), (3, "one", "en", "src0", 3, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
