from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def test_slices_keep_all_rows_in_order():
    rb = pa.RecordBatch.from_arrays([pa.array(["x" * (n % 97) for n in range(500)] + ["y" * 20_000] + ["z"] * 30)], names=["t"])
    parts = list(common.slices([rb], 1_000))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == rb.column(0).to_pylist() and len(parts) > 10
    assert max(p.nbytes for p in parts if p.num_rows > 1) <= 4_000 and list(common.slices([rb.slice(0, 0)], 10))[0].num_rows == 0


def test_scans_are_told_by_their_plans(spark, tmp_path):
    path = f"{tmp_path}/Exchange"
    spark.range(10).write.parquet(path)
    df = spark.read.parquet(path)
    assert common.is_scan(df.where("id > 2").select("id")) and not common.is_scan(df.distinct()) and not common.is_scan(df.orderBy("id"))
    assert common.steady(df.repartition(2), "x").count() == 10


@pytest.mark.parametrize("keys", [1, 1000])
def test_hot_keys_join_like_others(spark, monkeypatch, keys):
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).when(F.col("id") == 299, None).otherwise(F.col("id") % 7).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low")).where("k <> 3")
    got = common.join_unique(rows, found, ["k"], "copies", 300)
    assert got.count() == 300 and sorted((r.id, r.low) for r in got.collect() if r.k == 0) == [(r.id, 0) for r in rows.where("k = 0").orderBy("id").collect()]
    assert got.where("low IS NULL").count() == rows.where("k IS NULL OR k = 3").count()


def test_a_second_attempt_finds_its_file(tmp_path):
    fs = pafs.LocalFileSystem()
    for _ in range(2):
        (tmp_path / "tmp").write_text("same")
        common.put_in_place(fs, str(tmp_path / "tmp"), str(tmp_path / "final"))
    assert (tmp_path / "final").read_text() == "same" and not (tmp_path / "tmp").exists()
