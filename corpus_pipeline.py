"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated documents go, secrets are masked, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontamination, jaccard, secrets, toxicity

#: Ids of dropped documents that are broadcast at most (16 MB); beyond that the anti join exchanges both sides.
BROADCAST_IDS = 1 << 20
#: What every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def counted(ids: DataFrame) -> DataFrame:
    """ids, written, and to be broadcast where they are few."""
    ids = common.cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't in gone (doc_id, each once); those without an id stay."""
    return docs.join(counted(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic. It learns from labels of documents of this stage's input."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document of the smallest id; documents without words or id all stay.

    A component's id is one of its documents' ids, so those are kept that bear their
    component's id. Of rows that repeat such an id one stays, the smallest.
    """
    found = common.cut(jaccard.joined(docs.select("doc_id", "text")))
    gone = found.where("n_shingles > 0 AND component_id != doc_id").select("doc_id").distinct()
    kept = without(docs, gone)
    twice = found.where("n_shingles > 0 AND component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    twice = counted(twice)
    again = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*")
    return kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    found = decontamination.contaminated(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars brought up to date."""
    return secrets.redacted(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of every document, with the digests of ids and decoded bytes."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: Classification, decoding and byte-level BPE have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.fresh_path(spark, f"stage_{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
