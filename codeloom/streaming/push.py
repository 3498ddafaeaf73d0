"""Push events as a stream (ST1-ST7, FN12-FN13, SRC22, SNK9)."""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import branch_of_ref, normal_url
from codeloom.session import shared_dir, table

PAYLOAD = "struct<ref: string, after: string, repository: struct<clone_url: string>>"


def signature_of(secret: str, body: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def verified(secret: str | None):
    """FN13: a column function (body, signature) -> boolean; a missing secret or signature is never right."""

    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([bool(secret and s and b is not None and hmac.compare_digest(signature_of(secret, b), s)) for b, s in zip(body, signature)])

    return check


def pushes(events: DataFrame, secret: str | None, repositories: DataFrame | None = None) -> DataFrame:
    """ST1: (repo, branch, sha, ts) of events (body, signature, ts): signed, of a branch, and of a known repository if a table of them (url) is given."""
    p = events.where(verified(secret)(F.col("body"), F.col("signature"))).select(F.from_json("body", PAYLOAD).alias("p"), "ts")
    rows = p.select(normal_url(F.col("p.repository.clone_url")).alias("repo"), branch_of_ref(F.col("p.ref")).alias("branch"), F.col("p.after").alias("sha"), "ts")
    rows = rows.where("repo is not null and repo <> '' and branch is not null")
    if repositories is not None:
        rows = rows.join(repositories.select(normal_url(F.col("url")).alias("repo")).distinct(), "repo", "left_semi")
    return rows


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """ST2: the newest event of each key; earlier ones are superseded, so the last state is never lost."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("o")).select(*keys, value, *[F.col(f"o.{c}").alias(c) for c in order])


def run(stream: DataFrame, handle, checkpoint: str):
    """ST3: hands each micro-batch to ``handle(batch, id)`` until what is available now is used up; the checkpoint makes a restart go on where it stopped."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rebuild(workspace, checkout):
    """ST3, ST6: a handler for :func:`run` that brings the newest state of every pushed branch into a workspace.

    ``checkout(repo, branch, sha)`` gives the scan (path, content_hash, raw_text) and the commit built before, or None. A batch names few branches, one row each; a repeated batch finds nothing changed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        for r in latest(batch, ["repo", "branch"], "sha", ["ts"]).collect():
            scan, before = checkout(r["repo"], r["branch"], r["sha"])
            workspace.build(scan, f"{r['repo']}@{r['branch']}", before, r["sha"])

    return handle


def push_stream(spark, d):
    """The newest purchase of each user, from a stream over the events."""
    static = table(spark, d, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    out = f"{shared_dir(spark)}/push-{uuid.uuid4().hex}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch overwrites its own folder, so an event is never counted twice.
        latest(batch.where("event_type = 'purchase'"), ["user_id"], "event_id", ["ts", "event_id"]).drop("event_id").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run(stream.select("event_id", "ts", "user_id", "event_type"), handle, f"{out}-checkpoint")
    rows = spark.read.parquet(f"{out}/batch=*")
    return rows.groupBy("user_id").agg(F.max("ts").alias("ts"))


def graph_events(branches: DataFrame) -> DataFrame:
    """ST6: what a listener is told."""
    return branches.select(F.lit("graph_updated").alias("type"), "repo", "branch", "sha")



QUERIES = {"push_stream": push_stream}
SQL = {"push_stream": "select user_id, max(ts) as ts from events where event_type = 'purchase' group by 1"}
