"""Secret scans with a worklist of decoded layers.

The text itself is the first layer. The worklist is a stack of layers that are begun:
the layers within one come up one at a time and are worked off before the next, so of a
stream that unfolds into gigabytes one piece is held at each depth. Each layer is scanned for secrets and for
encoded stretches (percent escapes, Unicode escapes, base64, and compressed bytes
within base64, percent escapes or each other); what those decode to are further
layers, until nothing new comes up. Bytes that aren't UTF-8 are read with marks in
place of what isn't, so that secrets between them are found. A layer's content that was seen before in the same document at the same place
isn't taken up again, so a cycle ends. Each character of a layer knows the span of
the document's text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A character of each kind of encoding that plain prose has little of; without any, no layer can come.
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]{1,6}\})|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
_UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A stretch that percent escapes and characters beside them may spell bytes in.
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!#$&-;=?-~])+")
#: How a compressed stream may begin.
_MAGIC = re.compile(rb"\x1f\x8b|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)", re.DOTALL)
#: Bytes of a layer that a compressed stream may unfold into at a time; more follow as layers of their own.
PIECE = 1 << 24
#: Characters by which such layers overlap, so that a secret over an edge is found.
OVERLAP = 1 << 12

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Base spans (kind, start, end) of one layer: leftmost, non-overlapping by kind; failing matches are passed over."""
    out: list[Span] = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


class _Zstd:
    """A zstd frame's decoder, used as those of zlib are; input goes in by little, as output has no bound of its own."""

    unconsumed_tail = unused_data = b""

    def __init__(self) -> None:
        import zstandard

        self.error = zstandard.ZstdError
        self.d = zstandard.ZstdDecompressor().decompressobj()

    @property
    def eof(self) -> bool:
        return self.d.eof

    def decompress(self, data: bytes | memoryview, most: int) -> bytes:
        data = memoryview(data)
        try:
            out = self.d.decompress(data[:1024])
        except self.error as e:
            raise zlib.error(str(e)) from e
        self.unconsumed_tail = data[1024:]
        if self.d.eof:
            self.unused_data = self.d.unused_data + bytes(self.unconsumed_tail)
        return out


def _decoder(data: bytes | memoryview) -> zlib._Decompress | _Zstd | None:
    """What unfolds bytes that begin like these; None where they aren't compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd()
    if len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(15)
    return None


def _inflate(pieces: Iterable[bytes | memoryview]) -> Iterator[bytes]:
    """What compressed bytes unfold into, all members and frames of them up to one that is broken; what follows them and isn't compressed comes as it is."""
    source = iter(pieces)
    rest: bytes | memoryview = b""
    first = True
    while True:
        while len(rest) < 4 and (more := next(source, None)) is not None:
            rest = bytes(rest) + more if len(rest) else more
        d = _decoder(rest)
        got = False
        try:
            while d is not None and not d.eof:
                piece = d.decompress(rest, PIECE)
                rest = d.unconsumed_tail
                if piece:
                    got = True
                    yield piece
                if not d.eof and not len(rest) and len(piece) < PIECE and not len(rest := next(source, b"")):
                    return
        except zlib.error:
            if first or got:
                return
            d = None
        if d is None:
            if bytes(rest).strip(b"\x00"):
                yield bytes(rest)
                yield from source
            return
        rest = d.unused_data
        first = False


def _blocks(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes in blocks of about PIECE."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= PIECE:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _texts(blocks: Iterable[bytes]) -> Iterator[str]:
    """Blocks as texts that overlap."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    tail = ""
    for block in blocks:
        s = decoder.decode(block)
        if s:
            yield tail + s
            tail = (tail + s)[-OVERLAP:]
    if s := decoder.decode(b"", True):
        yield tail + s


def _unfolded(data: bytes | memoryview, new: Callable[[bytes], bool]) -> Iterator[str]:
    """The texts of all that bytes unfold into, of what this unfolds into, and so on, as long as new() finds each layer's digest new."""
    blocks: Callable[[], Iterable[bytes | memoryview]] = lambda: [data]
    head = data
    while _decoder(head) is not None:
        above = blocks
        blocks = lambda above=above: _blocks(_inflate(above()))
        digest, head, n = hashlib.sha256(b"bytes"), b"", 0
        for block in blocks():
            digest.update(block)
            head = head or block
            n += 1
        if not head or not new(digest.digest()):
            return
        if n == 1:
            blocks = lambda only=head: [only]
        yield from _texts(blocks())


class Layer(NamedTuple):
    """A decoded text, and where it comes from in the layer above.

    A stretch (at, i, j, plain) says that the characters from at on come from [i, j) above:
    one by one where plain, else all of them from the whole. Without stretches all comes
    from [start, end) above.
    """

    text: str
    above: Layer | None = None
    stretches: list[tuple[int, int, int, bool]] | None = None
    start: int = 0
    end: int = 0

    def origin(self, i: int, j: int) -> tuple[int, int]:
        """The span of the document's text that [i, j) of this layer comes from."""
        layer = self
        while layer.above is not None:
            if layer.stretches is None:
                i, j = layer.start, layer.end
            else:
                at, a, _, plain = layer.stretches[bisect_right(layer.stretches, i, key=_place) - 1]
                last, b, c, plain_last = layer.stretches[bisect_right(layer.stretches, j - 1, key=_place) - 1]
                i, j = a + (i - at if plain else 0), b + (j - last) if plain_last else c
            layer = layer.above
        return i, j


def _place(stretch: tuple[int, int, int, bool]) -> int:
    return stretch[0]


class _Builder:
    """Puts a decoded layer together, stretch by stretch."""

    def __init__(self, above: Layer) -> None:
        self.above, self.parts, self.stretches, self.size, self.end = above, [], [], 0, 0

    def put(self, s: str, i: int, j: int, plain: bool) -> None:
        if s:
            self.parts.append(s)
            self.stretches.append((self.size, i, j, plain))
            self.size += len(s)
        self.end = j

    def decoded(self, s: str, i: int, j: int) -> None:
        """s in place of [i, j), after what stands before it as it is."""
        self.put(self.above.text[self.end : i], self.end, i, True)
        self.put(s, i, j, False)

    def layer(self) -> Layer | None:
        if not self.end:
            return None
        n = len(self.above.text)
        self.put(self.above.text[self.end :], self.end, n, True)
        return Layer("".join(self.parts), self.above, self.stretches)


def _url_layer(above: Layer) -> Layer | None:
    """The whole layer with percent escapes decoded."""
    b = _Builder(above)
    for m in _URL.finditer(above.text):
        s = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
        if "\ufffd" in s:
            b.decoded(s, *m.span())
            continue
        p = m.start()
        for ch in s:
            q = p + 3 * len(ch.encode())
            b.decoded(ch, p, q)
            p = q
    return b.layer()


def _unicode_layer(above: Layer) -> Layer | None:
    """The whole layer with Unicode escapes decoded; two escapes of a surrogate pair are one character."""
    b = _Builder(above)
    high: tuple[int, int, int] | None = None

    def lone() -> None:
        if high is not None:
            b.decoded(chr(high[0]), high[1], high[2])

    for m in _UNICODE_ONE.finditer(above.text):
        code = next((int(g, 10 if i == 4 else 16) for i, g in enumerate(m.groups()) if g is not None), 0)
        if code > 0x10FFFF:
            continue
        if high is not None and 0xDC00 <= code < 0xE000 and m.start() == high[2]:
            b.decoded(chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], m.end())
            high = None
            continue
        lone()
        high = None
        if 0xD800 <= code < 0xDC00:
            high = (code, *m.span())
        else:
            b.decoded(chr(code), *m.span())
    lone()
    return b.layer()


def _base64_bytes(text: str) -> Iterator[tuple[bytes, int, int]]:
    """What each base64 run decodes to, and the run's span."""
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        body = run.replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            continue
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True), m.start(), m.end()
        except binascii.Error:
            continue


def _url_bytes(text: str) -> Iterator[tuple[memoryview, int, int]]:
    """Where percent escapes spell bytes that aren't UTF-8: what may be a compressed stream among them, and the stretch's span."""
    for m in _URL_BYTES.finditer(text):
        if "%" not in m[0]:
            continue
        data = urllib.parse.unquote_to_bytes(m[0])
        try:
            data.decode()
        except UnicodeDecodeError:
            view = memoryview(data)
            for at in _MAGIC.finditer(data):
                if _decoder(view[at.start() :]) is not None:
                    yield view[at.start() :], m.start(), m.end()


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those that decoded layers add."""
    base = scan(text)
    if not (_BASE64.search(text) or "%" in text or "\\" in text or "&#" in text):
        return base, base
    every, seen = set(base), {_key(text, 0, len(text))}
    # layers that are begun: what each unfolds into comes one by one, and is done with before the next of them is made
    begun = [_inner(Layer(text), seen)]
    while begun:
        layer = next(begun[-1], None)
        if layer is None:
            begun.pop()
            continue
        every.update((kind, *layer.origin(i, j)) for kind, i, j in scan(layer.text))
        begun.append(_inner(layer, seen))
    return base, sorted(every, key=_order)


def _inner(layer: Layer, seen: set[tuple[bytes, int, int]]) -> Iterator[Layer]:
    """The layers that one holds, as far as they are new at their place; a stream's content piece by piece as it unfolds."""

    def new(key: tuple[bytes, int, int]) -> bool:
        return key not in seen and not seen.add(key)

    def unfolded(data: bytes | memoryview, i: int, j: int) -> Iterator[Layer]:
        at = layer.origin(i, j)
        for content in _unfolded(data, lambda digest: new((digest, *at))):
            if new(_key(content, *at)):
                yield Layer(content, layer, None, i, j)

    text = layer.text
    span = layer.origin(0, len(text)) if text else (0, 0)
    if "%" in text:
        if (found := _url_layer(layer)) and new(_key(found.text, *span)):
            yield found
        for data, i, j in _url_bytes(text):
            yield from unfolded(data, i, j)
    if ("\\" in text or "&#" in text) and (found := _unicode_layer(layer)) and new(_key(found.text, *span)):
        yield found
    for data, i, j in _base64_bytes(text):
        plain = Layer(data.decode("utf-8", "replace"), layer, None, i, j)
        if new(_key(plain.text, *layer.origin(i, j))):
            yield plain
        yield from unfolded(data, i, j)


def _key(text: str, i: int, j: int) -> tuple[bytes, int, int]:
    """What tells a layer apart: its content and the span that it comes from."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), i, j


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """text with every stretch that spans cover replaced by mark, overlapping spans by one."""
    out, end = [], 0
    for i, j in _merged(spans):
        out += (text[end:i], mark)
        end = j
    return "".join([*out, text[end:]])


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for _, i, j in sorted(spans, key=lambda s: (s[1], s[2])):
        if out and i < out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each document: counts by kind and digest of the base spans, and all spans.

    Offsets are code points of the text, ends exclusive. A null text counts as empty:
    no spans, the digest of no bytes. Rows stay as many as they are; a null doc_id
    stays null. Other columns of docs aren't returned.
    """

    def run(batches):
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in _FOUND}
            cols["doc_id"] = rb.column("doc_id").to_pylist()
            for text in common.texts(rb):
                base, every = find(text)
                kinds = [k for k, _, _ in base]
                for k in KINDS:
                    cols[f"n_{k}"].append(kinds.count(k))
                cols["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols["spans"].append(listed(every))
                cols["n_added"].append(len(every) - len(base))
            yield common.batch(_FOUND, cols)

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return common.by_arrow(src, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret's span in text replaced by a mark; n_chars, where there is one, follows.

    Every row stays, also those without text (null stays null) or without secrets.
    """
    schema = docs.schema
    names = [str(i) for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for rb in batches:
            cols = list(rb.columns)
            old = cols[at].to_pylist()
            new = [redact(t, find(t)[1]) if t else t for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if count >= 0:
                lengths = cols[count].to_pylist()
                cols[count] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, old, new, strict=True)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns)

    docs_columns = list(docs.columns)
    src = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    return common.by_arrow(src, run, schema)
