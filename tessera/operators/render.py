"""Parts of files to show: merged line ranges, greedy budgets, and texts of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Kinds whose nodes wrap others.
ENVELOPE_KINDS = ("file", "module", "class", "struct", "interface", "enum", "namespace", "protocol", "trait", "component")


def merged_ranges(ranges: DataFrame, gap: int, by: str = "file_path") -> DataFrame:
    """Ranges (by, start, end, importance) with those at most gap lines apart merged: start, end, the highest importance, and how many."""
    w = Window.partitionBy(by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    r = r.withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(by, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("importance").alias("importance"), F.count(F.lit(1)).alias("n")).drop("group")


def within_budget(items: DataFrame, by: str, order: list[str], size: str, most: int) -> DataFrame:
    """Items of each group taken in order while their sizes add up to at most most, with their rank among those that could fit; the first is always taken, and one that doesn't fit is passed over.

    What is taken depends on what was, so each group is folded in order, over all of its
    items as they stream by. Items without a group are left out.
    """
    names = items.columns

    def fold(batches):
        group, used, rank = None, 0, 0
        for rb in batches:
            places, ranks = [], []
            for i, (g, n) in enumerate(zip(rb.column(names.index(by)).to_pylist(), rb.column(names.index(size)).to_pylist(), strict=True)):
                if g != group:
                    group, used, rank = g, 0, 0
                if rank and (n is None or n > most):
                    continue
                rank += 1
                if rank == 1 or (used is not None and used + n <= most):
                    used = None if n is None else used + n
                    places.append(i)
                    ranks.append(rank)
            t = rb.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(ranks, pa.int32())], names=[*names, "rank"])

    dealt = items.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, *order)
    return dealt.mapInArrow(fold, T.StructType([*items.schema.fields, T.StructField("rank", T.IntegerType())]))


def numbered(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_path, start, text) of ranges: their lines (file_path, line, text) with numbers, in order."""
    hit = ranges.join(lines, "file_path").where((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end")))
    one = F.concat(F.col("line").cast("string"), F.lit("\t"), F.col("text"))
    g = hit.groupBy("file_path", "start").agg(F.array_sort(F.collect_list(F.struct("line", one.alias("t")))).alias("all"))
    return g.select("file_path", "start", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))


def skeleton(symbols: DataFrame, most: int) -> DataFrame:
    """(file_path, text): the first most signatures (start, signature) of each file; symbols without a line come last."""
    w = Window.partitionBy("file_path").orderBy(F.when(F.col("start") > 0, F.col("start")).otherwise(2**31 - 1), "signature")
    few = symbols.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    g = few.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("rank", "signature"))).alias("all"))
    return g.select("file_path", F.array_join(F.transform("all", lambda x: x["signature"]), "\n").alias("text"))


def uncovered(symbols: DataFrame, by: str = "file_path") -> DataFrame:
    """Symbols (by, start, end, whole, ...) of each file in order, without those that begin within a whole one shown before: what a skeleton lists.

    What is covered depends on what was shown, so each file is folded in order, over all
    of its symbols as they stream by. Symbols without a line come last and stay.
    """
    names = symbols.columns

    def fold(batches):
        group, until = None, 0
        for rb in batches:
            places = []
            cols = [rb.column(names.index(c)).to_pylist() for c in (by, "start", "end", "whole")]
            for i, (g, start, end, whole) in enumerate(zip(*cols, strict=True)):
                if g != group:
                    group, until = g, 0
                if start is not None and 0 < start <= until:
                    continue
                places.append(i)
                if whole:
                    until = max(until, end or 0)
            yield pa.RecordBatch.from_arrays(rb.take(pa.array(places, pa.int64())).columns, names=names)

    order = F.when(F.col("start") > 0, F.col("start")).otherwise(2**31 - 1)
    rest = [c for c in names if c not in (by, "start")]
    dealt = symbols.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, order, *rest)
    return dealt.mapInArrow(fold, symbols.schema)


def clusters(ranges: DataFrame, sizes: DataFrame, gap: int, most: int, least: int = 3) -> DataFrame:
    """Parts of files to show: (file_path, start, end, importance, rank).

    ranges (file_path, kind, start, end, importance) lose envelopes, which wrap more than
    half of their file, and those without lines; the others are merged over gaps, and
    those of some importance are taken in order while their characters fit. sizes
    (file_path, lines, ends) has a file's number of lines, and how many characters there
    are up to and with each line.
    """
    r = ranges.join(sizes, "file_path").where((F.col("start") > 0) & (F.col("end") > F.col("start")))
    r = r.where(~(F.col("kind").isin(*ENVELOPE_KINDS) & (F.col("end") - F.col("start") + 1 > F.col("lines") * 0.5)))
    m = merged_ranges(r.select("file_path", "start", "end", "importance"), gap).where(F.col("importance") >= least).join(sizes, "file_path")
    last = F.least("end", "lines")
    chars = F.element_at("ends", last) - F.when(F.col("start") > 1, F.element_at("ends", F.col("start") - 1) + 1).otherwise(0)
    return within_budget(m.where("start <= lines").select("file_path", "start", "end", "importance", chars.cast("long").alias("size")), "file_path", ["start", "end"], "size", most).select("file_path", "start", "end", "importance", "rank")


def line_sizes(files: DataFrame) -> DataFrame:
    """(file_path, lines, ends) of files (path, text): how many lines, and how many characters there are up to and with each line, without its end."""
    f = files.select(F.col("path").alias("file_path"), F.split("text", "\n").alias("all"))
    # a fold that carries the last end along: one pass over the lines
    ends = F.aggregate("all", F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0)) + F.length(x))))
    return f.select("file_path", F.size("all").alias("lines"), ends.alias("ends"))


def whole(files: DataFrame) -> DataFrame:
    """(file_path, text) of files (path, text) with a number and a tab before each line."""
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")
    return files.select(F.col("path").alias("file_path"), numbered.alias("text"))
