"""Which files changed since their branch's last successful run (problem 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.merkle import MerkleStore
from codeloom.session import shared_dir, table


def last_states(file_log: DataFrame, build_runs: DataFrame) -> DataFrame:
    """The last recorded state per (branch_id, path): (branch_id, path, file_op, content_hash).

    The state is the log row of the built run with the latest ``finished_at``; a missing end sorts
    first, and equal ends are decided by run_id, then log_id. Rows of other runs don't count.
    One aggregation, combined before its shuffle.
    """
    built = build_runs.where(F.col("status") == "built").select("run_id", "finished_at").distinct()
    order = F.struct("finished_at", "run_id", "log_id")
    return (
        file_log.join(built, "run_id")
        .groupBy("branch_id", "path")
        .agg(F.max(F.struct(order.alias("o"), "file_op", F.lower("content_hash").alias("content_hash"))).alias("s"))
        .select("branch_id", "path", "s.file_op", "s.content_hash")
    )


def changed_files(files: DataFrame, file_log: DataFrame, build_runs: DataFrame) -> DataFrame:
    """Files to process: (id, branch_id, path, content_hash, change).

    The state that the log tells is adopted by a store, with its tree; the scan is compared with that tree.
    """
    now = files.select("id", "branch_id", "path", F.lower("content_hash").alias("content_hash"))
    # A deleted path has no state to compare with, and neither has one logged without a hash.
    saved = last_states(file_log, build_runs).where("file_op != 'deleted'").select("branch_id", "path", "content_hash")
    store = MerkleStore(files.sparkSession, f"{shared_dir(files.sparkSession)}/recorded-{uuid.uuid4().hex}")
    store.adopt(saved, ["branch_id", "path"], "content_hash")
    return store.pending(now, "content_hash")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, log, runs = (table(spark, sf_dir, t) for t in ("files", "file_log", "build_runs"))
    return changed_files(files, log, runs).select(F.col("id").alias("file_id")).distinct()


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed files per branch."""
    files, log, runs = (table(spark, sf_dir, t) for t in ("files", "file_log", "build_runs"))
    return changed_files(files, log, runs).groupBy("branch_id", "change").agg(F.count_distinct("id").alias("n_files"))


_STATES = """
with built as (select distinct run_id, finished_at from build_runs where status = 'built'),
ranked as (
  select l.branch_id, l.path, l.file_op, lower(l.content_hash) as h,
         row_number() over (partition by l.branch_id, l.path
           order by b.finished_at desc nulls last, l.run_id desc, l.log_id desc) as rn
  from file_log l join built b on l.run_id = b.run_id),
f as (select distinct id, branch_id, path, lower(content_hash) as h from files),
x as (
  select f.id, f.branch_id, f.h, s.file_op, s.h as sh, (s.path is null or s.file_op = 'deleted') as fresh
  from f left join ranked s on s.rn = 1 and s.branch_id = f.branch_id and s.path = f.path)
"""

QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p6_found": _STATES + "select distinct id as file_id from x where fresh or h is null or sh is null or h <> sh",
    "p6_counts": _STATES
    + """select branch_id, case when fresh then 'added' else 'changed' end as change, count(distinct id) as n_files
    from x where fresh or h is null or sh is null or h <> sh group by 1, 2""",
}
