"""Building a branch: full or incremental, and what is stored (§ build, ST3-ST7, CP1-CP6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.embed import embed
from codeloom.operators import chunking, history
from codeloom.session import materialize
from codeloom.sources.analysis import analysed
from codeloom.sources.tables import REPORTS, BranchTable

FILES = "path string, content_hash string, raw_text string, branch_id string"
CHUNKS = "chunk_id string, path string, type string, name string, start_line int, end_line int, text string, branch_id string"
BUILT = "last_commit_sha string, mode string, indexed_at timestamp, branch_id string"
VECTORS = "chunk_id string, path string, embedding array<float>, branch_id string"


class Workspace:
    """Files, chunks and vectors of all branches under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.files = BranchTable(spark, f"{root}/files", FILES)
        self.chunks = BranchTable(spark, f"{root}/chunks", CHUNKS)
        self.vectors = BranchTable(spark, f"{root}/vectors", VECTORS)
        self.reports = BranchTable(spark, f"{root}/reports", REPORTS)
        self.built = BranchTable(spark, f"{root}/built", BUILT)

    def _chunks(self, files: DataFrame) -> DataFrame:
        """CH2: code by functions, classes and blocks, whole; windows, with their limit, of files without functions and classes."""
        return chunking.with_chunk_id(chunking.file_chunks(materialize(analysed(files), "build-analysis"))).dropDuplicates(["chunk_id"])

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        made = embed(chunking.prefixed_text(chunks), "chunk_id", "document_text")
        return made.join(chunks.select("chunk_id", "path", "branch_id"), "chunk_id")

    def clear(self, branch_id: str) -> None:
        """Drops all that is stored of a branch."""
        for t in (self.files, self.chunks, self.vectors, self.reports, self.built):
            t.clear(branch_id)

    def build(self, scan: DataFrame, branch_id: str, previous_sha: str | None = None, sha: str | None = None) -> dict:
        """Stores a scan (path, content_hash, raw_text) of a branch and then, as its stamp, the commit and the time; returns the numbers of the build.

        Only changed files are chunked and embedded again unless there is nothing sound to compare with.
        """
        numbers = self._build(scan, branch_id, previous_sha)
        stamp = self.spark.createDataFrame([(sha, numbers["mode"], branch_id)], "last_commit_sha string, mode string, branch_id string").withColumn("indexed_at", F.current_timestamp())
        self.built.replace(stamp)
        return numbers

    def _build(self, scan: DataFrame, branch_id: str, previous_sha: str | None) -> dict:
        now = scan.select("path", "content_hash", "raw_text").withColumn("branch_id", F.lit(branch_id))
        old = self.files.read().where(F.col("branch_id") == branch_id)
        mode = history.build_mode(previous_sha, old.count(), old.where("content_hash is null").count())
        total = now.count()
        if mode == "full":
            self.files.replace(now, ["path"])
            chunks = materialize(self._chunks(now), "build-chunks")
            self.chunks.replace(chunks)
            self.vectors.replace(self._vectors(chunks))
            return {"mode": mode, "files_changed": total, "files_deleted": 0, "files_unchanged": 0}
        diff = materialize(history.snapshot_diff(old, now, "path", "content_hash"), "build-diff")
        changed = now.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi").select(*now.columns)
        gone = diff.select("path")
        n_deleted, n_changed = diff.where("change = 'deleted'").count(), diff.where("change <> 'deleted'").count()
        if n_deleted + n_changed:
            chunks = materialize(self._chunks(changed), "build-chunks")
            self.files.merge(changed, branch_id, gone)
            self.chunks.merge(chunks, branch_id, gone)
            self.vectors.merge(self._vectors(chunks), branch_id, gone)
        return {"mode": mode, "files_changed": n_changed, "files_deleted": n_deleted, "files_unchanged": max(0, total - n_changed)}


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Makes query results temporary views, so that they can be asked by SQL."""
    from codeloom.plans import registry

    done = []
    for name in names or sorted(registry.QUERIES):
        registry.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
        done.append(name)
    return done
