"""A source tree on disk as a table (SRC1-SRC4, SRC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import BINARY_SUFFIXES, TEXT_SUFFIXES, extension, in_ignored_dir, language, normal_path


def listing(spark: SparkSession, root: str) -> DataFrame:
    """SRC1: (path, extension, size) of all files, without ignored directories; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") if "://" in root or root.startswith("file:") else "file:" + root.rstrip("/")
    path = F.expr(f"substring(path, {len(base) + 2})")
    return f.select(path.alias("path"), "length").where(~in_ignored_dir(F.col("path"))).select("path", extension(F.col("path")).alias("extension"), F.col("length").alias("size"))


def contents(spark: SparkSession, root: str, max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """SRC2, SRC12: (path, language, content_hash, raw_text) of the files that are indexed.

    Invalid bytes become the replacement character. A file is indexed if it is not binary by its extension, within the size (which the reader filters by), and of a known language, or text by extension, or without extension and NUL bytes.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = "file:" + root.rstrip("/") if "://" not in root and not root.startswith("file:") else root.rstrip("/")
    rows = f.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), "content").where(~in_ignored_dir(F.col("path")))
    ext = F.lower(extension(F.col("path")))
    lang = language(F.col("path"))
    text = lang.isNotNull() | ext.isin(*TEXT_SUFFIXES) | ((ext == "") & ~F.contains(F.col("content"), F.unhex(F.lit("00"))))
    kept = rows.where(~ext.isin(*BINARY_SUFFIXES) & text)
    return kept.select("path", lang.alias("language"), F.sha2("content", 256).alias("content_hash"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("raw_text"))


def file_content(files: DataFrame, branch_id: str, path: str) -> DataFrame:
    """SRC13: (path, raw_text) of a file of a branch; paths outside the stored tree name nothing."""
    return files.where((F.col("branch_id") == branch_id) & (normal_path(F.col("path")) == path.replace("\\", "/"))).select("path", "raw_text")
