from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

from tessera.llm import secrets as S

KEY = "AKIA" + "ABCDEFGH12345678"


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_base_spans():
    r = random.Random(1)
    parts = ["password", "PassWd", "toKen", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdef", "x", KEY, "AKIA12", "0123456789abcdef01234567", "deadbeef", "ſecret", "ü"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert S.scan(t) == brute_base(t)
        base, every = S.find(t)
        assert base == brute_base(t) and set(base) <= set(every)


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


def test_layers_and_spans():
    secret = f"token = abcdef123 {KEY}"
    url = urllib.parse.quote(secret)
    esc = "".join(f"\\u{ord(c):04x}" for c in secret)
    for wrapped in (b64(secret.encode()), b64(gzip.compress(secret.encode())), b64(zlib.compress(secret.encode())), b64(b64(secret.encode()).encode()), urllib.parse.quote(b64(secret.encode()), safe=""), b64(url.encode()), b64(esc.encode()), b64(gzip.compress(b64(zlib.compress(esc.encode())).encode()))):
        text = f"héad {wrapped} tail"
        base, every = S.find(text)
        assert not base and {k for k, _, _ in every} == {"assign", "access"}
        # padding that is escaped itself is no part of the run as it stands
        assert all(wrapped.startswith(text[i:j]) and j - i >= len(wrapped) - 6 for _, i, j in every)
    # layers of the whole text map each character
    text = f"pre {url} post"
    (kind, i, j), (kind2, i2, j2) = S.find(text)[1]
    assert kind == "assign" and urllib.parse.unquote(text[i:j]) == "token = abcdef123"
    assert kind2 == "access" and text[i2:j2] == KEY and S.find(text)[0] == [("access", i2, j2)]
    text = f"pre {esc} post"
    assert [(k, len(text[i:j])) for k, i, j in S.find(text)[1]] == [("assign", 6 * len("token = abcdef123")), ("access", 6 * len(KEY))]


def test_ends_and_bounds():
    for t in ("%2525252525", "\\u005cu0041", "%" * 50, "a" * 5000, b64(b"\x1f\x8bbroken") * 3, "%E2%28%A1", "\\ud83d\\ude00 \\ud83d", b64(bytes(range(256)))):
        S.find(t)
    bomb = b64(zlib.compress(b"a " * 2_000_000 + b"password=hunter22222"))
    assert S.find(bomb)[1] == [("assign", 0, len(bomb))]


def test_a_secret_over_the_edge_of_two_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 100)
    t = b64(zlib.compress(b"x " * 47 + b"password=hunter22222 y" * 1))
    assert ("assign", 0, len(t)) in S.find(t)[1]


def test_frames(spark, odd, none):
    rows = spark.createDataFrame([(1, f"a {KEY} b", 20), (2, "clean", 5), (3, None, None), (4, f"é {b64(KEY.encode() + b'  ')}", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in S.secrets(rows).collect()}
    assert got[1].n_access == 1 and got[1].spans == "access:2:22" and got[1].base_sha256 == hashlib.sha256(b"access:2:22").hexdigest()
    assert got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4].n_added == 1
    masked = {r.doc_id: r for r in S.redacted(rows).collect()}
    assert masked[1].text == "a [SECRET] b" and masked[1].n_chars == 12 and masked[2].text == "clean" and masked[3].text is None and masked[4].text == "é [SECRET]"
    assert S.redacted(odd).count() == odd.count() and S.redacted(odd).columns == odd.columns
    assert S.secrets(none).collect() == [] and S.secrets(odd).count() == odd.count()


def test_members_frames_and_layers_without_base64_between():
    import zstandard

    z = lambda b: zstandard.ZstdCompressor().compress(b)
    key = b"password=hunter2222"
    noise = bytes(random.Random(3).randrange(256) for _ in range(3000))
    for data in (
        gzip.compress(b"first") + gzip.compress(key),
        gzip.compress(b"first") + b"\0\0 " + key,
        z(b"first") + z(key),
        z(noise) + z(noise + b" " + key),
        gzip.compress(gzip.compress(key)),
        gzip.compress(z(zlib.compress(key))),
        gzip.compress(b"\x00\xff " + key),
        b"\x00\xff " + key,
        gzip.compress(noise + b" " + key),
    ):
        t = f"a {b64(data)} b"
        assert [(k, t[i:j].rstrip("=")) for k, i, j in S.find(t)[1]] == [("assign", b64(data).rstrip("="))], data[:30]
    for data in (gzip.compress(key), zlib.compress(key), z(key), gzip.compress(gzip.compress(key))):
        t = f"see q={urllib.parse.quote(data)} b"
        assert ("assign", True) in [(k, i <= 6 and j == len(t) - 2) for k, i, j in S.find(t)[1]]  # a stream may also spell it out


def test_all_pieces_of_a_stream_are_read(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 100)
    body = b"\x01" + b"y " * 200 + "é".encode() * 100 + b" password=hunter22222 z"
    for data in (zlib.compress(body), gzip.compress(zlib.compress(body))):
        t = b64(data)
        assert ("assign", 0, len(t)) in S.find(t)[1]


def test_a_layer_that_unfolds_into_itself_ends(monkeypatch):
    monkeypatch.setattr(S, "_inflate", lambda pieces: iter([b"".join(pieces)]))
    S.find(b64(gzip.compress(b"anything")))


def peeled(text):
    """All that a text holds after one decoding of one run of it, by the plainest means."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            out.append((m.start(), m.end(), base64.b64decode(m[0] + "=" * (-len(m[0]) % 4), validate=True)))
        except ValueError:
            continue
    return [(i, j, d) for i, j, d in out]


def brute(text):
    """Spans of base64 runs that hold, however deep, a base secret; and the base spans."""
    found = {("base", *s[1:]) for s in S.scan(text)}
    for i, j, data in peeled(text):
        work = [data]
        while work:
            d = work.pop()
            if d[:2] == b"\x1f\x8b":
                d = gzip.decompress(d)
            t = d.decode("utf-8", "replace")
            if S.scan(t):
                found.add(("deep", i, j))
            work += [x for _, _, x in peeled(t)]
    return found


def test_added_spans_against_brute_force():
    r = random.Random(5)
    plain = ["password=hunter2222", "nothing to see here", "AKIA" + "Q" * 20, "a token: abcdef123", "just prose, no more"]
    for _ in range(150):
        t = r.choice(plain)
        for _ in range(r.randint(1, 3)):
            b = t.encode()
            b = gzip.compress(b, mtime=0) if r.random() < 0.3 else b
            t = r.choice(["see ", "x: ", ""]) + base64.b64encode(b).decode().rstrip("=") + r.choice([" end", ".", ""])
        t = f"{r.choice(plain)} | {t} | {r.choice(plain)}"
        base, every = S.find(t)
        want = brute(t)
        assert {s[1:] for s in base} == {s[1:] for s in want if s[0] == "base"}
        deep = [s[1:] for s in want if s[0] == "deep"]
        added = {s[1:] for s in every} - {s[1:] for s in base}
        assert all(any(a <= i and j <= b for a, b in deep) for i, j in added) and all(any(a <= i and j <= b for i, j in {s[1:] for s in every}) for a, b in deep)


def test_a_stream_unfolds_piece_by_piece(monkeypatch):
    held = []
    real = S.scan
    monkeypatch.setattr(S, "PIECE", 1 << 12)
    monkeypatch.setattr(S, "scan", lambda t: held.append(len(t)) or real(t))
    big = ("x" * 50 + " ") * 20_000 + "password=hunter2222"
    text = base64.b64encode(gzip.compress(big.encode(), mtime=0)).decode()
    base, every = S.find(text)
    assert not base and [s[0] for s in every] == ["assign"] and max(held) <= len(text) + 4 * S.OVERLAP
