from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read())


def encoded(codec, texts, pattern=P.PATTERN):
    """Texts by way of pieces and numbers, as tasks do it."""
    split = bpe.Splitter(pattern)
    numbers = [np.frombuffer(split.split(t), "<i4") for t in texts]
    ids = codec.ids([p.encode("utf-8", "surrogatepass") for p in split.numbers])
    return [b"".join(ids[k] for k in n) for n in numbers]


@pytest.fixture(scope="module")
def reference(codec):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    return lambda t: np.array(e.encode_ordinary(t), "<u4").tobytes()


def test_same_ids_as_the_library(codec, reference):
    r = random.Random(3)
    letters = "ab aA1 \n\t  '’\x1c\x85 é日本　😀_-.,aaaa lllssstt'se're "
    every = ["", " ", "a" * 4000, " " * 100, "ab" * 1500, "aab" * 900] + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    assert encoded(codec, every) == [reference(t) for t in every] and bpe.Splitter(P.PATTERN).cuts


def test_round_trip(codec):
    every = ["grüße 日本 😀\n\n  x", "it's  they're\t\tdon't", ""]
    assert [codec.decode(i).decode() for i in encoded(codec, every)] == every


def test_a_lower_rank_that_a_merge_brings_about_comes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"aba": 290, b"abab": 310}
    c = bpe.Codec(ranks)
    e = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for t in ("abab", "ababab", "abaab", "bababa"):
        assert encoded(c, [t], r"\S+")[0] == np.array(e.encode_ordinary(t), "<u4").tobytes()


def test_frames(spark, odd, none, reference):
    rows = bpe.encode(odd, PATH, P.PATTERN).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert any(reference(t or "") == np.array(r.token_ids, "<u4").tobytes() and hashlib.sha256((t or "").encode()).hexdigest() == r.decoded_sha256 for i, t in texts if i == r.doc_id)
        assert r.score == "clash"
    assert bpe.digests(none, PATH, P.PATTERN).collect() == []


def test_a_pattern_that_joins_over_a_space_isn_t_cut_there(codec):
    for pattern in (r"\w+ \w+|.", r"[^,]+|,"):
        split = bpe.Splitter(pattern)
        assert not split.cuts
        e = tiktoken.Encoding("j", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
        t = "some words, and more of them,here"
        assert encoded(codec, [t], pattern)[0] == np.array(e.encode_ordinary(t), "<u4").tobytes()


def test_the_corpus_in_many_runs_of_numbers(spark, monkeypatch, reference):
    r = random.Random(9)
    words = ["".join(r.choice("abcdé日 ") for _ in range(r.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(200)] + [(500, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: np.array(x.token_ids, "<u4").tobytes() for x in bpe.encode(df, PATH, P.PATTERN).collect()}
    assert got == {i: reference(t) for i, t in rows}


def test_numbers_in_few_bytes_come_back():
    r = np.random.default_rng(1)
    for top in (1, 200, 60_000, 70_000, 2**31 - 1):
        for n in (0, 1, 50):
            a = r.integers(0, top, n)
            assert bpe.joined(*bpe.planes(a)).tolist() == a.tolist() == bpe.wide(bpe.narrow(a)).tolist()
