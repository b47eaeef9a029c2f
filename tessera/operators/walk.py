"""Random walks over a graph whose steps are packed into some three bytes each, so that rounds exchange nothing but scores.

Nodes are ordered by a 64-bit hash of their ids, numbered in that order, and dealt into blocks by it. Each
block has files in the shared folder: its ids, their hashes, and the steps into it by the numbers of their
starts, as differences of these and places in the block, by planes of bytes. A task of a round reads the
scores of all nodes and the steps of its blocks and writes the blocks' new scores. Tasks return the names of
the files that they wrote, so what an attempt that failed has left is never read.

An end of an edge that is no node would be taken for one if their hashes are the same, which one in
2 ** 64 / nodes such ends is, at most one in 10 ** 12. Nodes with the same hash are found, and hashed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import lineage

#: Bits of a node's number, and so the nodes that a packed graph has at most: a task holds a hash or a score of each, 128 MB.
BITS = 24
PACKED_NODES = 1 << BITS
#: Nodes of a block on average, edges that are packed at once, and steps of one file; a block with more steps has several files.
BLOCK_NODES, CHUNK, FILE_STEPS = 1 << 18, 1 << 20, 1 << 21
#: Tasks of a round for each core; each reads the scores of all nodes once.
TASKS = 2
#: Bytes of a packed pair before compression: four of the difference, three of the other number.
WIDTH = 7
_MADE = "part int, nodes long, seeds long, clash long, names array<string>"


def hashed(seed: int, column: str):
    return F.xxhash64(F.lit(seed), column)


def pack(pairs: np.ndarray) -> bytes:
    """Pairs of numbers in order, each of them one number with the second in its lower bits: differences of the first ones, and the second ones."""
    first = np.diff(pairs >> BITS, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    second = (pairs & (PACKED_NODES - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.concatenate([*first.T, *second.T[:3]])
    return len(pairs).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second numbers."""
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(packed)[8:], n * WIDTH), np.uint8).reshape(WIDTH, n)

    def wide(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 4), np.uint8)
        for i, row in enumerate(rows):
            out[:, i] = row
        return out.view("<u4").ravel()

    return np.cumsum(wide(planes[:4]), dtype=np.int64), wide(planes[4:]).astype(np.int64)


class Folder:
    """Files of a folder that driver and executors share."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)

    def put(self, what: str, part: int, *data) -> str:
        from pyspark import TaskContext

        name = f"{what}_{part:06d}_{TaskContext.get().taskAttemptId()}"
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{name}") as f:
            for x in data:
                f.write(x)
        return name

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def numbers(self, names: list[str], n: int, kind: str) -> np.ndarray:
        """The n numbers that stand in these files, one after another."""
        out, at = np.empty(n, kind), 0
        for name in names:
            x = np.frombuffer(self.get(name), kind)
            out[at : at + len(x)] = x
            at += len(x)
        if at != n:
            raise RuntimeError(f"{at} of {n} numbers are there")
        return out

    def delete(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(f"{self.path}/{name}")


def _made(part: int, nodes: int = 0, seeds: int = 0, clash: int = 0, names: tuple = ()) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, nodes, seeds, clash, list(names)), kinds, strict=True)], names=["part", "nodes", "seeds", "clash", "names"])


def _by_part(batches, *columns: str) -> Iterator[tuple]:
    """Batches of one part each, of rows that come part by part; its number first."""
    for rb in batches:
        part = rb.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), rb.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(part[a]), *(rb.column(c).slice(a, b - a) for c in columns)


def _write_nodes(uri: str, batches) -> Iterator[pa.RecordBatch]:
    """Of rows (part, key, id, seed) by part, key and id: each block's ids once, with their hashes, and which are seeds."""
    folder, part, held = Folder(uri), None, []

    def done() -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        key, id_, seed = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        key, seed = key.to_numpy(), seed.to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | pa.compute.not_equal(id_[1:], id_[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        node = np.minimum.reduceat(seed, first) == 0  # a seed alone is no node
        marked = (np.maximum.reduceat(seed, first) > 0)[node]
        first = first[node]
        if not len(first):
            return
        sink = pa.BufferOutputStream()
        ids = pa.RecordBatch.from_arrays([id_.take(pa.array(first)).cast(pa.large_string())], names=["id"])
        with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(ids)
        key = key[first]
        names = folder.put("ids", part, sink.getvalue()), folder.put("keys", part, key.tobytes()), folder.put("seeds", part, marked.tobytes())
        yield _made(part, len(first), int(marked.sum()), int((np.diff(key) == 0).sum()), names)

    for p, *columns in _by_part(batches, "key", "id", "seed"):
        if p != part:
            yield from done()
            part, held = p, []
        held.append(columns)
    yield from done()


def _pack_edges(uri: str, names: list[str], ends: list[int], chunk: int, batches) -> Iterator[pa.RecordBatch]:
    """Of rows (s, t) of hashes: steps in both directions between nodes that are there, (part, steps), packed by block."""
    folder, held, rows = Folder(uri), [], 0
    offsets = np.array([0, *ends], np.int64)
    keys = folder.numbers(names, ends[-1], "<i8")

    def place(wanted: np.ndarray) -> np.ndarray:
        order = np.argsort(wanted)  # one after another they are found where the last one was
        found = np.empty(len(wanted), np.int64)
        found[order] = np.searchsorted(keys, wanted[order])
        return found

    def done() -> Iterator[pa.RecordBatch]:
        s, t = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = place(s), place(t)
        there = (keys[np.minimum(a, len(keys) - 1)] == s) & (keys[np.minimum(b, len(keys) - 1)] == t)
        a, b = a[there], b[there]
        steps = np.concatenate([a << BITS | b, b << BITS | a])
        steps.sort()
        cuts = np.searchsorted(steps, offsets << BITS)
        own = [p for p in range(len(ends)) if cuts[p + 1] > cuts[p]]
        for p in own:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack(steps[cuts[p] : cuts[p + 1]] - (offsets[p] << BITS))], pa.binary())], names=["part", "steps"])

    for rb in batches:
        for k in range(0, rb.num_rows, chunk):
            held.append([rb.column(c).slice(k, chunk).to_numpy() for c in ("s", "t")])
            rows += len(held[-1][0])
            if rows >= chunk:
                yield from done()
                held, rows = [], 0
    if held:
        yield from done()


def _write_steps(uri: str, sizes: list[int], most: int, batches) -> Iterator[pa.RecordBatch]:
    """Of rows (part, steps) by part: each block's steps in files of bounded size, and how many steps each node has."""
    folder, part, held, rows, names = Folder(uri), None, [], 0, []
    degree = np.zeros(0, np.int64)

    def flush() -> None:
        nonlocal held, rows
        steps = np.concatenate(held)
        steps.sort()  # by starts, so that scores are read in order and only the block's own are written here and there
        for k in range(0, len(steps), most):
            names.append(folder.put(f"steps{len(names)}", part, pack(steps[k : k + most])))
        np.add(degree, np.bincount(steps & (PACKED_NODES - 1), minlength=len(degree)), out=degree)
        held, rows = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if part is not None:
            if held:
                flush()
            yield _made(part, names=(folder.put("degree", part, degree.tobytes()), *names))

    for p, packed in _by_part(batches, "steps"):
        if p != part:
            yield from done()
            part, names, degree = p, [], np.zeros(sizes[p], np.int64)
        for x in packed:
            place, start = unpack(x.as_py())
            held.append(start << BITS | place)
            rows += len(place)
            if rows >= most:
                flush()
    yield from done()


def _round(uri: str, sizes: list[int], nodes: list[list[str]], steps: dict[int, list[str]], before: list[str], restart: float, seeds: int, last: bool, batches) -> Iterator[pa.RecordBatch]:
    """Of rows (part): write each block's scores after a round, for the next one divided by the steps that share them. Without scores before, where the walk begins."""
    folder, total = Folder(uri), sum(sizes)
    flow = folder.numbers(before, total, "<f8") if before else None
    for rb in batches:
        for part in rb.column("part").to_pylist():
            n, at = sizes[part], sum(sizes[:part])
            r = np.frombuffer(folder.get(nodes[part][2]), bool) / seeds if seeds else np.full(n, 1 / total)
            degree = np.frombuffer(folder.get(steps[part][0]), np.int64) if part in steps else np.zeros(n, np.int64)
            s = r
            if flow is not None:
                m = np.zeros(n)
                for name in steps.get(part, ())[1:]:
                    start, place = unpack(folder.get(name))
                    m += np.bincount(place, flow[start], n)
                # a node without steps keeps its share
                s = (1 - restart) * np.where(degree == 0, flow[at : at + n], m) + restart * r
            yield _made(part, names=(folder.put("scores", part, (s if last else s / np.maximum(degree, 1)).tobytes()),))


def _read_scores(uri: str, nodes: list[list[str]], scores: list[str], batches) -> Iterator[pa.RecordBatch]:
    folder = Folder(uri)
    for rb in batches:
        for part in rb.column("part").to_pylist():
            with pa.ipc.open_stream(folder.get(nodes[part][0])) as r:
                ids = r.read_all().column("id").combine_chunks()
            score = np.frombuffer(folder.get(scores[part]), "<f8")
            for k in range(0, len(ids), 10_000):
                yield pa.RecordBatch.from_arrays([ids[k : k + 10_000].cast(pa.string()), pa.array(score[k : k + 10_000])], names=["id", "score"])


def packed_walk(edges: DataFrame, ids: DataFrame, seeds: DataFrame, rounds: int, restart: float, rows: int) -> DataFrame:
    """(id, score) over the nodes ids (id), in so many rows, at most PACKED_NODES, with edges (source, target)."""
    spark = ids.sparkSession
    lineage.ship(spark)
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // BLOCK_NODES), -(-2 * edges.count() // FILE_STEPS), min(cores, rows // 10_000))
    uri, hash_seed = lineage.fresh_path(spark, "walk"), 0
    while True:  # until no two ids have the same hash, which they have once in 100,000 graphs
        listed = ids.select("id", F.lit(0).cast("tinyint").alias("seed")).union(seeds.select("id", F.lit(1).cast("tinyint"))).where("id IS NOT NULL").withColumn("key", hashed(hash_seed, "id"))
        part = F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * blocks), F.lit(blocks - 1)).cast("int")
        dealt = listed.select(part.alias("part"), "key", "id", "seed").repartitionById(blocks, "part").sortWithinPartitions("part", "key", "id")
        made = sorted(dealt.mapInArrow(partial(_write_nodes, uri), _MADE).collect())
        if not any(x.clash for x in made):
            break
        hash_seed += 1
    del dealt
    lineage.release(spark)
    if not made:
        return ids.select("id", F.lit(0.0).alias("score")).limit(0)
    # blocks without nodes are left out, so those that are there are counted anew
    sizes, nodes = [x.nodes for x in made], [list(x.names) for x in made]
    keys = edges.where("source != target").select(hashed(hash_seed, "source").alias("s"), hashed(hash_seed, "target").alias("t"))
    steps = keys.mapInArrow(partial(_pack_edges, uri, [x[1] for x in nodes], np.cumsum(sizes).tolist(), CHUNK), "part int, steps binary").repartitionById(len(made), "part").sortWithinPartitions("part")
    into = {x.part: list(x.names) for x in steps.mapInArrow(partial(_write_steps, uri, sizes, FILE_STEPS), _MADE).collect()}
    del steps
    folder, scores = Folder(uri), []
    every = spark.range(0, len(made), 1, min(len(made), TASKS * cores)).select(F.col("id").cast("int").alias("part"))
    for k in range(rounds + 1):
        go = partial(_round, uri, sizes, nodes, into, scores, restart, sum(x.seeds for x in made), k == rounds)
        after = [x.names[0] for x in sorted(every.mapInArrow(go, _MADE).collect())]
        folder.delete(scores)
        scores = after
        if k < 2:
            lineage.release(spark)
    out = lineage.cut(every.mapInArrow(partial(_read_scores, uri, nodes, scores), "id string, score double"))
    folder.fs.delete_dir(folder.path)
    return out
