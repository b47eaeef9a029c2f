"""The queries op1 to op10, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chunking, decontamination, jaccard, ppm, secrets, sharding, toxicity, urls, warc
from tessera.llm.common import table


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under a public byte-level BPE vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")



def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlaps with benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links between similar shingle sets."""
    return jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a uniform shuffle over 24 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffle(docs, 24).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined fingerprints of every document and of its edited text."""
    return chunking.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by partial matching, and by a unigram model of words."""
    return ppm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archives of all pages."""
    return warc.roundtrip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document and of what is encoded in it."""
    return secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_contamination, op2_jaccard, op3_shards, op4_toxicity, op5_chunks, op6_ppm, op7_warc, op8_secrets, op9_bpe, op10_urls)}
#: SQL for the queries that it can express: the others decode, train models, draw or chunk.
ORACLES: dict[str, str] = {
    "op2_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(sha1(coalesce(html, '')), i, 1)) - 1) AS v, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: ((v[(5 * k + j) // 4 + 1] >> CAST(3 - (5 * k + j) % 4 AS INT)) & 1) << CAST(4 - j AS INT))) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, true AS intact FROM p""",
}
