"""Uniform shuffle into shards of exact sizes.

How many rows each input partition sends to each block of a shard is drawn from
the multivariate hypergeometric distribution, so that it is what a uniform
permutation of all rows would give. The matrix is never held: it is drawn down a
binary tree over the partitions, each node with its own seeded generator, and a
task walks from the root to its own row. A task permutes its rows locally by that
row, rows are exchanged, and each block is permuted again.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of a block: what one task permutes after the exchange.
BLOCK_BYTES = 64 << 20


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    """Counts at most one apart."""
    return [rows // n_shards + (i < rows % n_shards) for i in range(n_shards)]


def block_sizes(rows: int, n_shards: int, per_shard: int) -> list[int]:
    """Sizes of all shards' blocks in order, per_shard for each shard."""
    return [b for s in shard_sizes(rows, n_shards) for b in shard_sizes(s, per_shard)]


def _draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by halves, for totals of any size."""
    if colours.sum() < 10**9:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    if len(colours) == 1:
        return np.array([n], np.int64)
    h = len(colours) // 2
    left, right = int(colours[:h].sum()), int(colours[h:].sum())
    k = _hypergeometric(rng, left, right, n)
    return np.r_[_draw(rng, colours[:h], k), _draw(rng, colours[h:], n - k)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw of any size: numpy's own, which is exact, up to 10^9, beyond it by _by_mode, after the urn is turned so that good and n are small."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if not good or not n:
        return 0
    if n > total - n:
        return good - _hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - _hypergeometric(rng, bad, good, n)
    if good > n:
        # how many of n drawn are good is how many of good drawn are among the n
        return _hypergeometric(rng, n, total - n, good)
    return _by_mode(rng, good, bad, n)


def _by_mode(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw by inversion over the values within twelve standard deviations of the most likely one.

    Each probability follows from the one before by a ratio of whole numbers, and their
    sum scales them. What lies beyond has a chance below 10^-30, and the sums are exact to
    some 10^-10, so a draw differs from an exact one once in some billions of draws.
    """
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    step = max(64, int(12 * math.sqrt(n * (good / (good + bad)) * (bad / (good + bad))) + 64))
    values = np.arange(max(low, mode - step), min(high, mode + step) + 1, dtype=np.float64)
    k = values[:-1]
    ratio = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weights = np.exp(np.r_[0.0, np.cumsum(ratio)] - np.r_[0.0, np.cumsum(ratio)].max())
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return int(values[min(int(at), len(values) - 1)])


def row_of(matrix_seed: int, counts: list[int], sizes: list[int], partition: int) -> np.ndarray:
    """One row of the communication matrix: rows that partition sends to each block.

    Every task that asks draws the same tree, since each node's generator depends on
    the seed and the node alone.
    """
    total = [0, *accumulate(counts)]
    lo, hi, take = 0, len(counts), np.array(sizes, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([matrix_seed, lo, hi]), take, total[mid] - total[lo])
        lo, hi, take = (lo, mid, left) if partition < mid else (mid, hi, take - left)
    return take


def shuffle(df: DataFrame, n_shards: int = 24, seed: int = 0, size: str = "octet_length(text) + 8", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) added.

    The order is a uniform random one, and shard sizes are at most one apart. Rows are
    told apart by their place in the input, so repeated rows, null columns and ties
    each have a slot of their own; an empty input gives an empty result. Columns of df
    named shard or slot are replaced. size is an SQL expression for a row's bytes; null
    counts as 8. It only sets the number of blocks.

    df is read twice, once for counts, and both reads must give the same partitions in
    the same order, also when a lost task runs again. A scan of files does; anything
    with an exchange doesn't, so such input is first written to the shared folder. A
    task whose partition has another count than before fails instead of going wrong.
    """
    spark = df.sparkSession
    df = common.steady(df.drop("shard", "slot"), "shuffle")
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.expr(size), F.lit(8))).alias("bytes")).collect()
    if not parts:
        return df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    counts = [0] * (max(r.p for r in parts) + 1)
    for r in parts:
        counts[r.p] = r.n
    rows, weight = sum(counts), sum(r.bytes for r in parts)
    per_shard = max(1, -(-weight // (n_shards * block_bytes)))
    sizes = block_sizes(rows, n_shards, per_shard)
    # 8 bytes a partition and 8 a block: a petabyte in blocks of 64 MB is 16 million of them
    plan = spark.sparkContext.broadcast((np.array(counts, np.int64), np.array(sizes, np.int64)))
    names = [str(i) for i in range(len(df.columns))]

    def deal(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        counts, sizes = plan.value
        n = int(counts[p]) if p < len(counts) else 0
        goes = np.repeat(np.arange(len(sizes), dtype=np.int32), row_of(seed, counts.tolist(), sizes, p)) if n else np.zeros(0, np.int32)
        rng = np.random.default_rng([seed, 1, p])
        rng.shuffle(goes)
        at = 0
        for rb in batches:
            m = rb.num_rows
            if at + m > n:
                raise RuntimeError(f"partition {p} has more rows than the {n} counted before")
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(goes[at : at + m]), pa.array(rng.integers(-(2**63), 2**63 - 1, m)), pa.array(np.arange(at, at + m) | p << 40)], names=[*names, "__block", "__key", "__tie"])
            at += m
        if at != n:
            raise RuntimeError(f"partition {p} has {at} rows, not the {n} counted before")

    src = df.select(*(df[c].alias(n) for c, n in zip(df.columns, names, strict=True)))
    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True)), "__block int, __key long, __tie long"])
    dealt = common.by_arrow(src, deal, schema)
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__key", "__tie")).cast("long") - 1
    shard = F.floor(F.col("__block") / per_shard).cast("int")
    # where a block starts in its shard: a rule, so no table of blocks is needed
    of = F.lit(rows // n_shards) + (shard < rows % n_shards).cast("long")
    k = F.col("__block") % per_shard
    start = k * F.floor(of / per_shard) + F.least(k.cast("long"), of % per_shard)
    return dealt.select(*(F.col(f"`{n}`").alias(c) for c, n in zip(df.columns, names, strict=True)), shard.alias("shard"), (start + place).cast("long").alias("slot"))


