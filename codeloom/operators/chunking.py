"""Chunks of files (CH1-CH2, SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import strip, uuid5


def text_windows(texts: DataFrame, lines: int = DEFAULT.chunk_lines, windows: int = DEFAULT.chunk_windows, chars: int = DEFAULT.chunk_chars) -> DataFrame:
    """CH1: (branch_id, path, start_line, end_line, text): windows of lines, stripped and cut; empty ones are dropped before the limit.

    The windows are cut from the split text within a row, so nothing is shuffled.
    """
    cut = F.split("raw_text", "\n")
    starts = F.sequence(F.lit(0), F.size(cut) - 1, F.lit(lines))
    one = lambda a: F.struct((a + 1).alias("start_line"), F.least(a + lines, F.size(cut)).alias("end_line"), strip(F.array_join(F.slice(cut, a + 1, lines), "\n")).alias("text"))
    kept = F.slice(F.filter(F.transform(starts, one), lambda w: w["text"] != ""), 1, windows)
    rows = texts.where(F.col("raw_text").isNotNull()).select("branch_id", "path", F.explode(kept).alias("w"))
    return rows.select("branch_id", "path", "w.start_line", "w.end_line", F.substring("w.text", 1, chars).alias("text"))


def file_chunks(files: DataFrame) -> DataFrame:
    """CH2: (branch_id, path, type, name, start_line, end_line, text) of functions, class stubs, blocks, and windows of files without functions and classes."""
    f = files.where(F.col("analysis").isNotNull()).select("branch_id", "path", "analysis")
    fn = f.select("branch_id", "path", F.explode("analysis.functions").alias("x")).select("branch_id", "path", F.lit("function").alias("type"), "x.name", "x.start_line", "x.end_line", F.col("x.code").alias("text"))
    loc = lambda k: F.try_element_at("analysis.class_locations", F.col("c"))[k]
    cl = f.select("branch_id", "path", "analysis", F.explode("analysis.classes").alias("c")).select(
        "branch_id", "path", F.lit("class").alias("type"), F.col("c").alias("name"), loc("start_line").alias("start_line"), loc("end_line").alias("end_line"), F.concat(F.lit("Class: "), "c").alias("text")
    )
    bl = f.select("branch_id", "path", F.explode("analysis.blocks").alias("x")).select("branch_id", "path", "x.type", "x.name", "x.start_line", "x.end_line", F.col("x.code").alias("text"))
    none = lambda c: F.coalesce(F.size(f"analysis.{c}"), F.lit(0)) <= 0
    plain = f.where(none("functions") & none("classes")).select("branch_id", "path", F.col("analysis.raw_text").alias("raw_text"))
    tx = text_windows(plain).select("branch_id", "path", F.lit("text").alias("type"), F.col("path").alias("name"), "start_line", "end_line", "text")
    return fn.unionByName(cl).unionByName(bl).unionByName(tx)


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """SNK3: the deterministic id; null parts are written None, as a missing start line is."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    name = F.concat_ws(":", part("branch_id"), part("path"), part("type"), part("name"), part("start_line"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return chunks.withColumn("chunk_id", uuid5(name))


def prefixed_text(chunks: DataFrame) -> DataFrame:
    """FN11: what is embedded."""
    return chunks.withColumn("document_text", F.concat(F.lit("File: "), "path", F.lit("\n"), "text"))
