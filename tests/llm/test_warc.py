from __future__ import annotations

import base64
import hashlib
import io
import random

from tessera.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def expected(rows, least=0):
    """By payload: the first of the smallest id is the response, all others revisit it. Rows are told apart by their order, so of equal rows one is the response."""
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for p, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        alike = len(p) >= least
        out += [(i, len(p), sha, "revisit" if alike and k else "response", ids[0] if alike and k else None) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(spark, rows, least=0):
    out = warc.roundtrip(spark, pages(spark, rows), least).collect()
    assert all(r.intact for r in out)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(i, f"http://x.example/{i}\r\nX: y", r.choice(["", None, "<p>a</p>", "<b>ü😀\r\n\r\nWARC/1.1\r\n</b>"]) if i % 2 else f"<html>{i}" + "z" * r.randint(0, 5000)) for i in range(120)]
    rows += [(None, None, "no id"), (200, "u", "x" * 3_000_000)]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, 5) == expected(rows, 5)


def test_nothing(spark):
    assert warc.roundtrip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_repeated_rows_and_ids_and_clashing_columns(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (None, "d", "y"), (None, "d", "y"), (3, None, ""), (3, None, None), (4, "e", "x")]
    assert got(spark, rows) == expected(rows)
    assert [r for r in got(spark, rows) if r[3] == "revisit" and r[0] == 1] == [(1, 1, expected(rows)[0][2], "revisit", 1)]
    wide = spark.createDataFrame([(*r, 7, "z") for r in rows], "page_id long, url string, html string, record long, bytes string")
    out = warc.roundtrip(spark, wide.repartition(3)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(rows)


def test_a_payload_with_many_copies_stays_in_place(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(90)]
    assert got(spark, rows) == expected(rows)


def test_chunk_rows_carry_digests(spark, tmp_path):
    text = "".join(chr(97 + i % 26) for i in range(2_500_000))
    records = warc.numbered(pages(spark, [(1, "u", text), (2, "v", text), (3, "w", "")]))
    chunks = warc.chunked(records)
    assert max(len(r.data) for r in chunks.collect()) == warc.CHUNK and chunks.count() == 7
    heads = warc.classified(warc.digested(chunks))
    assert {r.page_id: (r.bytes, bytes(r.sha1)) for r in heads.collect()} == {i: (len(t), hashlib.sha1(t).digest()) for i, t in ((1, text.encode()), (2, text.encode()), (3, b""))}
    files = warc.write(chunks, heads, f"file://{tmp_path}/w")
    rows = sorted(warc.read(files.select("path")).collect(), key=lambda r: (r.page_id, r.chunk_no))
    own = [r for r in rows if r.page_id == 1]
    assert [r.chunk_no for r in own] == [0, 1, 2] and b"".join(bytes(r.data) for r in own) == text.encode()
    done = 0
    for r in own:
        done += len(r.data)
        assert r.bytes_so_far == done and r.digest_so_far == warc.digest32(hashlib.sha1(text[:done].encode()).digest())
    assert [r.record_type for r in rows if r.page_id == 2] == ["revisit"] and len([r for r in rows if r.page_id == 3]) == 1


def test_a_broken_archive_is_an_error():
    import pytest

    with pytest.raises(ValueError):
        list(warc.parse(io.BufferedReader(io.BytesIO(b"HTTP/1.1 200\r\n\r\n"))))
