"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split into pieces, which merges don't cross, and each task gives its
different pieces numbers of its own. One exchange brings equal pieces of the whole
corpus together, so that merges are replayed on each of them once: the pieces are laid
out as one array of byte tokens, an inverted index leads from the rank of a token pair
to the positions where that pair stands, merges are applied in rank order, and after
each one only the neighbours of merged positions are looked up and indexed again. The
ids of pieces go back to the tasks that have them, and numbers become ids in place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Two white-space characters in a row, which a split at single spaces can't treat.
_RUN = re.compile(r"\s\s")
#: Every character that the pattern or str.isspace takes for white space, but the space.
_EDGE = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

#: Places that leave the index of pairs together, at least.
AT_ONCE = 20_000
#: Bytes of pieces that are replayed together.
PORTION = 2_000_000
#: Texts between spaces that a worker remembers, and pieces that a task numbers before it starts afresh; both bound memory alone.
REMEMBERED, NUMBERED = 300_000, 1_000_000
#: Bytes beyond which a piece is replayed alone.
LONG = 1_000
#: Ids that are decoded at a time.
DECODED = 1 << 20
#: Characters of many kinds, by which a pattern is tried.
_PROBES = ("a", "Z", "é", "ß", "7", "٣", "日", "本", "😀", ".", "'", "-", "_", "(", "$", "\u0301", "न", "\x00", "\u200d")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the bytes of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Codec:
    """Encodes and decodes by ranks; one per worker, since building it takes a moment."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        if len(self.bytes_of) != len(ranks):
            raise ValueError("two tokens have one rank")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for bytes {missing[:5]}")
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges into, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        k = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.values[i], np.int32(-1))

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, by applying merges in rank order over all of them.

        The lowest ranks leave the index together until AT_ONCE places are there. Of
        one piece, one merge is made at a time: the leftmost of the lowest rank; its
        other places go back. So a pair that a merge brings about comes before later
        places if its rank is lower. Pieces don't touch each other.
        """
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        if not n:
            return [b""] * len(pieces)
        tok = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        nxt[last] = -1
        prv[1:][last[:-1]] = -1
        rank = np.full(n, -1, np.int32)
        inner = np.flatnonzero(~last).astype(np.int32)
        rank[inner] = self.pair_ranks(tok[inner], tok[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] >= 0]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            stops = [*starts[1:].tolist(), len(r)]
            for value, i, j in zip(r[starts].tolist(), starts.tolist(), stops, strict=True):
                if (group := index.get(value)) is None:
                    index[value] = [at[i:j]]
                    heapq.heappush(heap, value)
                else:
                    group.append(at[i:j])

        add(inner)
        while heap:
            got: list[np.ndarray] = []
            ready, low, high = 0, heap[0], -1
            while heap and (high < 0 or ready < AT_ONCE):
                high = heapq.heappop(heap)
                group = index.pop(high)
                got += group
                ready += sum(map(len, group))
            at = got[0] if len(got) == 1 else np.concatenate(got)
            r = rank[at]
            ok = (r >= low) & (r <= high)
            at = np.sort(at[ok])
            if not len(at):
                continue
            at = at[np.r_[True, at[1:] != at[:-1]]]
            if len(at) > 1:
                w = word[at]
                if (w[1:] == w[:-1]).any():
                    order = np.lexsort((at, rank[at], w))
                    at, w = at[order], w[order]
                    first = np.r_[True, w[1:] != w[:-1]]
                    back, at = at[~first], at[first]
                else:
                    back = at[:0]
            else:
                back = at[:0]
            right = nxt[at]
            tok[at] = rank[at]
            alive[right] = False
            rank[right] = -1
            after = nxt[right]
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            rank[at] = -1
            rank[at[has]] = self.pair_ranks(tok[at[has]], tok[after[has]])
            before = prv[at]
            there = before >= 0
            rank[before[there]] = self.pair_ranks(tok[before[there]], tok[at[there]])
            add(np.concatenate((at[has], before[there], back)))
        kept = tok[alive].astype("<u4").tobytes()
        counts = np.r_[0, np.cumsum(alive)]
        edges = (counts[np.r_[0, ends]] * 4).tolist()
        return [kept[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; a piece that is a token is that token."""
        known = [self.ranks.get(p) for p in pieces]
        hard = iter(self.replay([p for p, r in zip(pieces, known, strict=True) if r is None and len(p) <= LONG]))
        return [r.to_bytes(4, "little") if r is not None else next(hard) if len(p) <= LONG else self.alone(p) for p, r in zip(pieces, known, strict=True)]

    def alone(self, piece: bytes) -> bytes:
        """Ids of one long piece, merge by merge: of one piece merges can't be made together, so its index of pairs is a heap of ranks and places."""
        tok: list[int] = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n, of = len(tok), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := of(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            r, i = x >> 40, x & ((1 << 40) - 1)
            j = after[i]
            if tok[i] < 0 or j >= n or of(tok[i] << 32 | tok[j]) != r:
                continue  # one of the two was merged since
            tok[i], tok[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := of(tok[i] << 32 | tok[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (k := before[i]) >= 0 and (r := of(tok[k] << 32 | tok[i])) is not None:
                heapq.heappush(heap, r << 40 | k)
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.decoded(ids))

    def decoded(self, ids: bytes) -> Iterator[bytes]:
        """What ids stand for, DECODED of them at a time."""
        every = np.frombuffer(ids, "<u4")
        for a in range(0, len(every), DECODED):
            yield b"".join(map(self.bytes_of.__getitem__, every[a : a + DECODED].tolist()))


class _Numbers(dict):
    """Pieces by number, in the order in which they come up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Splitter:
    """Splits texts into pieces, as numbers of this splitter's own."""

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.numbers, self.units = _Numbers(), {}
        #: Whether a single space between two characters that aren't white space always begins a piece under this pattern.
        self.cuts = all(self.pattern.findall(f"{a} {b}") == [*self.pattern.findall(a), *self.pattern.findall(f" {b}")] for a in _PROBES for b in _PROBES)

    def _numbered(self, pieces: list[str]) -> bytes:
        return np.array([self.numbers[p] for p in pieces], "<i4").tobytes()

    def split(self, text: str) -> bytes:
        """The numbers of a text's pieces, as little-endian 32-bit integers.

        Where a single space begins a piece, a text without runs of white space is cut
        there, and what stands between such spaces is split once.
        """
        if not self.cuts or not text or text[0] in _EDGE or text[-1] in _EDGE or text[-1] == " " or _RUN.search(text):
            return self._numbered(self.pattern.findall(text))
        cut = text.split(" ")
        units = self.units
        for c in set(cut).difference(units):
            units[c] = self._numbered(self.pattern.findall(" " + c))
        return b"".join((self._numbered(self.pattern.findall(cut[0])), *map(units.__getitem__, cut[1:])))

    def trim(self) -> None:
        """Forget texts between spaces, when they are many; numbers stay."""
        if len(self.units) > REMEMBERED:
            self.units.clear()


_CODECS: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(load_ranks(data))
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids (array of int), ids_sha256 and decoded_sha256 added.

    A null text counts as empty: no ids, and the digests of no bytes. Repeated rows
    are encoded each on its own and stay. Columns of docs with the added names are
    replaced. The vocabulary file is read on the driver and broadcast; its size
    doesn't depend on the corpus.
    """
    return _coded(docs, ranks_path, pattern, text, True)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """As encode, but n_tokens and the two digests without the ids themselves."""
    return _coded(docs, ranks_path, pattern, text, False)


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, and how many these are."""
    top = int(numbers.max()) if len(numbers) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", -1, 1).astype(np.int64)


def planes(numbers: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The lowest and second lowest bytes of numbers, and what is above. Numbers of pieces that come often are small, so apart from each other these compress well."""
    return (numbers & 0xFF).astype(np.uint8).tobytes(), (numbers >> 8 & 0xFF).astype(np.uint8).tobytes(), narrow(numbers >> 16)


def joined(low: bytes, middle: bytes, above: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint8) | np.frombuffer(middle, np.uint8).astype(np.int64) << 8 | wide(above) << 16


def _split(docs: DataFrame, pattern: str, schema: str, keep: list[str], slices: int) -> DataFrame:
    """Rows of docs with numbers for their texts (low, middle, above), each with the task (part) and the run of numbers (run) that they belong to; after each run its pieces, by slices of the pieces' hashes, with numbers in low and lengths in middle."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        splitter = Splitter(pattern)

        def pieces(like: pa.RecordBatch):
            every = [p.encode("utf-8", "surrogatepass") for p in splitter.numbers]
            to = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every)) % np.uint64(slices)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(slices + 1, dtype=np.uint64))
            for x in range(slices):
                at = order[cuts[x] : cuts[x + 1]]
                if len(at):
                    some = [every[i] for i in at.tolist()]
                    lengths = np.fromiter(map(len, some), np.int64, len(some))
                    none = [pa.nulls(1, like.schema.field(i).type) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*none, *(pa.array([v], pa.int32()) for v in (part, k, x)), *(pa.array([v], pa.binary()) for v in (narrow(np.diff(at, prepend=0)), narrow(lengths), None, b"".join(some)))], names=names)

        rb = None
        for rb in batches:
            numbers = [planes(np.frombuffer(splitter.split(t), "<i4")) for t in common.texts(rb, "__text")]
            m = rb.num_rows
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(keep))), *(pa.array(np.full(m, v, np.int32)) for v in (part, k)), pa.nulls(m, pa.int32()), *(pa.array(p, pa.binary()) for p in (zip(*numbers, strict=True) if m else [[]] * 3)), pa.nulls(m, pa.binary())], names=names)
            splitter.trim()
            if len(splitter.numbers) > NUMBERED:
                yield from pieces(rb)
                splitter, k = Splitter(pattern), k + 1
        if rb is not None:
            yield from pieces(rb)

    names = [*(f"{i}" for i in range(len(keep))), "part", "run", "slice", "low", "middle", "above", "pieces"]
    return common.by_arrow(docs, run, f"{schema}part int, run int, slice int, low binary, middle binary, above binary, pieces binary")


def _replayed(pieces: DataFrame, data: Broadcast, slices: int) -> DataFrame:
    """(part, run, numbers, lengths, ids) of pieces by slices: equal pieces of all parts come together, and merges are replayed on each once."""

    def run(batches):
        c = codec(data.value)
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            of: dict[bytes, int] = {}
            each = []
            for part, run_, numbers, lengths, joined in held:
                ends = np.cumsum(wide(lengths)).tolist()
                each.append((part, run_, numbers, np.array([of.setdefault(joined[a:b], len(of)) for a, b in zip([0, *ends[:-1]], ends, strict=True)])))
            ids: list[bytes] = []
            every, some, size = list(of), [], 0
            for p in every:
                some.append(p)
                size += len(p)
                if size >= PORTION:
                    ids += c.ids(some)
                    some, size = [], 0
            ids += c.ids(some)
            for part, run_, numbers, at in each:
                own = [ids[i] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run_], pa.int32()), pa.array([numbers], pa.binary()), pa.array([narrow(np.fromiter(map(len, own), np.int64, len(own)) // 4)], pa.binary()), pa.array([narrow(np.frombuffer(b"".join(own), "<u4"))], pa.binary())], names=["part", "run", "numbers", "lengths", "ids"])

        for rb in batches:
            for k, *row in zip(*(rb.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    yield from done()
                    key, held = k, []
                held.append(row)
        yield from done()

    dealt = pieces.select("slice", "part", "run", "low", "middle", "pieces").repartition(slices, "slice").sortWithinPartitions("slice", "part", "run")
    return common.by_arrow(dealt, run, "part int, run int, numbers binary, lengths binary, ids binary")


def _gathered(replayed: DataFrame, parts: int, folder: str) -> DataFrame:
    """Write a file in folder for each part that has pieces, with the lengths and ids of each run's pieces by number; (part) of the files. A task that runs again writes the same file."""

    def run(batches):
        from pyspark import TaskContext

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            rows = []
            for run_ in sorted({r for r, *_ in held}):
                own = [(np.cumsum(wide(n)), wide(le), wide(ids)) for r, n, le, ids in held if r == run_]
                number, lengths, flat = (np.concatenate(x) for x in zip(*own, strict=True))
                order = np.argsort(number)
                if not (number[order] == np.arange(len(number))).all():
                    raise RuntimeError(f"pieces of part {key} are missing")
                rows.append((run_, narrow(lengths[order]), narrow(_taken(flat, np.cumsum(lengths) - lengths, lengths, order))))
            tmp = f"{path}/_{key:08d}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(tmp) as sink, pa.ipc.new_stream(sink, _FILE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for r in rows:
                    w.write_batch(pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, _FILE, strict=True)], schema=_FILE))
            common.put_in_place(fs, tmp, f"{path}/{key:08d}")
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32())], names=["part"])

        for rb in batches:
            for part, *row in zip(*(rb.column(i).to_pylist() for i in range(5)), strict=True):
                if part != key:
                    yield from done()
                    key, held = part, []
                held.append(row)
        yield from done()

    return common.by_arrow(replayed.repartitionById(parts, "part").sortWithinPartitions("part", "run"), run, "part int")


_FILE = pa.schema([("run", pa.int32()), ("lengths", pa.large_binary()), ("ids", pa.large_binary())])


def _taken(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches of flat that at says, one after another."""
    n = lengths[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _coded(docs: DataFrame, ranks_path: str, pattern: str, text: str, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]
    keep = [c for c in docs.columns if c not in added and c != text]
    fields = list(docs.select(*keep).schema) if keep else []
    own = "".join(f"`{i}` {f.dataType.simpleString()}, " for i, f in enumerate(fields))
    src = docs.select(*(docs[c].alias(f"{i}") for i, c in enumerate(keep)), docs[text].alias("__text"))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = common.fresh_path(spark, "pieces")
    _split(src, pattern, own, keep, slices).write.option("compression", "zstd").parquet(path)
    split = spark.read.parquet(path)
    parts = (split.agg(F.max("part")).first()[0] or 0) + 1
    folder = common.fresh_path(spark, "ids")
    _gathered(_replayed(split.where("pieces IS NOT NULL"), data, slices), parts, folder).count()
    k = len(keep)

    def run(batches):
        c = codec(data.value)
        fs, base = pafs.FileSystem.from_uri(folder)
        part, runs, key = None, {}, None
        flat = lengths = starts = None
        for rb in batches:
            found: list[bytes] = []
            for part_, run_, *x in zip(*(rb.column(k + i).to_pylist() for i in range(5)), strict=True):
                if part_ != part:
                    with fs.open_input_stream(f"{base}/{part_:08d}") as source, pa.ipc.open_stream(source) as r:
                        runs = {a: (b, i) for m in r for a, b, i in zip(*(m.column(j).to_pylist() for j in range(3)), strict=True)}
                    part, key = part_, None
                if run_ != key:
                    lengths, flat = wide(runs[run_][0]), wide(runs[run_][1]).astype("<u4")
                    starts, key = np.cumsum(lengths) - lengths, run_
                found.append(_taken(flat, starts, lengths, joined(*x)).tobytes())
            out = [rb.column(i) for i in range(k)]
            out += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([_digest(c.decoded(x)) for x in found])]
            if with_ids:
                ids = np.frombuffer(b"".join(found), "<i4")
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in found)]), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[*(f"{i}" for i in range(k)), *added])

    schema = own + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    rows = split.where("pieces IS NULL").select(*(f"{i}" for i in range(k)), "part", "run", "low", "middle", "above")
    coded = common.by_arrow(rows, run, schema)
    return coded.select(*(F.col(f"`{i}`").alias(c) for i, c in enumerate(keep)), *added)


def _digest(parts: Iterator[bytes]) -> str:
    sha = hashlib.sha256()
    for p in parts:
        sha.update(p)
    return sha.hexdigest()
