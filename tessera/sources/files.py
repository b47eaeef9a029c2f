"""Source files of a tree as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import is_kept, is_source, language_of, literal, name_of

#: Files beside the sources that say what a project is built with.
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Every file under root: path relative to it, content, size, modified_at in milliseconds."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(relative(F.col("path"), root).alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))


def relative(path: Column, root: str) -> Column:
    """path without its scheme and the root that it lies under."""
    base = "/" + root.split(":", 1)[-1].strip("/") if root.startswith("file:") else root.rstrip("/")
    plain = F.regexp_replace(path, r"^file:/*", "/") if base.startswith("/") else path
    return F.regexp_replace(plain, "^" + literal(base) + "/", "")


def code_files(files: DataFrame, compatible: bool = False) -> DataFrame:
    """Files (path, ...) with a source extension that aren't excluded."""
    return files.where(is_source(F.col("path")) & is_kept(F.col("path"), compatible))


def build_files(files: DataFrame) -> DataFrame:
    """Files that show what frameworks a project uses: build files and XML."""
    return files.where((name_of(F.col("path")).isin(*BUILD_FILES) | F.col("path").endswith(".xml")) & is_kept(F.col("path")))


def wanted(files: DataFrame) -> DataFrame:
    """Sources and build files."""
    return files.where((is_source(F.col("path")) | name_of(F.col("path")).isin(*BUILD_FILES) | F.col("path").endswith(".xml")) & is_kept(F.col("path")))


def described(files: DataFrame) -> DataFrame:
    """Files (path, content, size, modified_at) with their hash, language and text."""
    return files.select("path", hashed(F.col("content")).alias("content_hash"), language_of(F.col("path")).alias("language"), "size", "modified_at", F.col("content").cast("string").alias("text"))


def hashed(content: Column) -> Column:
    return F.sha2(content, 256)


def source_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """(path, content_hash, language, size, modified_at, text) of source files under root that aren't excluded; paths are relative to it."""
    out = described(code_files(listed(spark, root)))
    return out if with_content else out.drop("text")


def read(files: DataFrame, path: str) -> DataFrame:
    """(text) of one file (path, text); no row without it."""
    return files.where(F.col("path") == path).select("text")


def lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text) from 1 on."""
    return files.select(F.col("path").alias("file_path"), F.posexplode(F.split("text", "\n"))).select("file_path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def java_projects(files: DataFrame) -> DataFrame:
    """(is_java): whether files (path) have a build file at the top, or a Java file at most two directories down. One row."""
    depth = F.size(F.split("path", "/"))
    hit = (name_of(F.col("path")).isin(*BUILD_FILES) & (depth == 1)) | (F.col("path").endswith(".java") & (depth <= 3))
    return files.agg(F.coalesce(F.max(hit), F.lit(False)).alias("is_java"))


def is_java_project(files: DataFrame) -> bool:
    return java_projects(files).first().is_java
