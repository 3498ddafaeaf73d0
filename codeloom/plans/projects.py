"""Queries: history, builds, snapshots, manifests, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import history
from codeloom.session import table

def _log(spark, d):
    return table(spark, d, "file_log").distinct()


def churn_hotspots(spark, d):
    """The paths changed most in the last 90 days of the log that the scan still holds."""
    c = history.churn(_log(spark, d), ["branch_id", "path"], "logged_at")
    return history.hotspots(c, table(spark, d, "files").select("branch_id", "path"), ["branch_id", "path"])


def churn_events(spark, d):
    return history.churn(table(spark, d, "events"), ["user_id"], "ts", 7)


def file_history(spark, d):
    rows = history.history_of(_log(spark, d), ["branch_id", "path"], [F.desc("logged_at"), F.desc("log_id")], 5)
    return rows.select("branch_id", "path", "log_id", "file_op", "nth")


def dependency_dedupe(spark, d):
    p = table(spark, d, "part").withColumn("k", F.lower("p_brand"))
    return history.first_per(p, ["k", "p_type"], ["p_partkey"]).select("p_partkey", "k", "p_type")


def advisory_join(spark, d):
    """Parts as dependencies, with advisories derived from large parts."""
    p = table(spark, d, "part")
    deps = p.select("p_partkey", F.col("p_brand").alias("name"), F.col("p_type").alias("version"))
    adv = p.where("p_size >= 48").select(F.col("p_brand").alias("name"), F.col("p_type").alias("version"), F.concat(F.lit("V-"), F.col("p_size").cast("string")).alias("vuln_id"))
    return history.with_advisories(deps, adv).select("p_partkey", F.array_join("ids", ",").alias("ids"), F.size("ids").alias("n_ids"))


def _versions(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 10 <> 0")
    new = docs.where("doc_id % 11 <> 0").select("doc_id", altered.alias("text"))
    return old.withColumn("digest", F.sha2("text", 256)), new.withColumn("digest", F.sha2("text", 256))


def snapshot_diff(spark, d):
    old, new = _versions(spark, d)
    return history.snapshot_diff(old, new, "doc_id", "digest")


def incremental_merge(spark, d):
    old, new = _versions(spark, d)
    return history.merge_changes(old, new, history.snapshot_diff(old, new, "doc_id", "digest"), "doc_id").select("doc_id", "digest")


def branch_status(spark, d):
    b = table(spark, d, "branches").select(F.col("id").alias("branch_id"), "repository_id", "name", "is_default", "last_commit_sha", "indexed_at").distinct()
    r = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "status").distinct()
    return b.join(r, "repository_id", "left").select("branch_id", "name", "status", F.coalesce("is_default", F.lit(False)).alias("is_default"), F.col("last_commit_sha").isNotNull().alias("indexed"))


def latest_built(spark, d):
    """SNK12: what a restart would load: the repository built last and its branch indexed last."""
    r = table(spark, d, "repositories").where("status = 'built' and built_at is not null").orderBy(F.desc("built_at"), "id").limit(1).select(F.col("id").alias("repository_id"))
    b = table(spark, d, "branches").join(r, "repository_id").where("indexed_at is not null").orderBy(F.desc("indexed_at"), "id").limit(1)
    return b.select("repository_id", F.col("id").alias("branch_id"))


def build_stats(spark, d):
    runs = table(spark, d, "build_runs").distinct()
    return runs.groupBy("branch_id", "mode", "status").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("files_changed").cast("long").alias("files_changed"))


def collection_size(spark, d):
    return table(spark, d, "chunks").groupBy("branch_id", "type").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def symbol_index(spark, d):
    f = table(spark, d, "files").where("analysis is not null").select("path", "id", F.explode("analysis.functions").alias("x")).select("path", "id", F.col("x.name").alias("name")).distinct()
    return history.symbol_index(f.select("name", "path", F.concat_ws("|", "path", "id").alias("o")), "o")


def import_index(spark, d):
    f = table(spark, d, "files").where("analysis is not null").select("id", F.explode("analysis.imports").alias("statement")).distinct()
    return f.groupBy("statement").agg(F.count(F.lit(1)).alias("n_files"))


def report_findings(spark, d):
    """AG20: the stored reports' findings, per severity and category."""
    kind = "struct<by_file: map<string, array<struct<id: string, severity: string, category: string>>>>"
    r = table(spark, d, "reports").where("issues_report is not null").select("branch_id", "issues_report").distinct().select("branch_id", F.from_json("issues_report", kind).alias("r"))
    f = r.select("branch_id", F.explode("r.by_file").alias("path", "x")).select("branch_id", F.explode("x").alias("f"))
    return f.groupBy("branch_id", "f.severity", "f.category").agg(F.count(F.lit(1)).alias("n_findings"))


QUERIES = {f.__name__: f for f in (churn_hotspots, churn_events, file_history, dependency_dedupe, advisory_join, snapshot_diff, incremental_merge, branch_status, latest_built, build_stats, collection_size, symbol_index, import_index, report_findings)}
_VERSIONS = """with o as (select doc_id, sha256(coalesce(text, '')) as a from documents where doc_id % 10 <> 0),
n as (select doc_id, sha256(case when doc_id % 7 = 0 then coalesce(text, '') || '!' else coalesce(text, '') end) as b from documents where doc_id % 11 <> 0)
"""


SQL = {
    "churn_hotspots": "with l as (select distinct * from file_log), c as (select branch_id, path, count(*) as churn from l where logged_at >= (select max(logged_at) from l) - interval 90 day group by 1, 2) select * from c where exists (select 1 from files f where f.branch_id = c.branch_id and f.path = c.path) order by churn desc, branch_id, path limit 20",
    "churn_events": "select user_id, count(*) as churn from events where ts >= (select max(ts) from events) - interval 7 day group by 1",
    "file_history": "select branch_id, path, log_id, file_op, nth::int as nth from (select *, row_number() over (partition by branch_id, path order by logged_at desc, log_id desc) as nth from (select distinct * from file_log)) where nth <= 5",
    "dependency_dedupe": "select p_partkey, k, p_type from (select p_partkey, lower(p_brand) as k, p_type, row_number() over (partition by lower(p_brand), p_type order by p_partkey) as r from part) where r = 1",
    "advisory_join": "with a as (select p_brand, p_type, list_sort(list(distinct 'V-' || p_size)) as ids from part where p_size >= 48 group by 1, 2) select p_partkey, coalesce(array_to_string(ids, ','), '') as ids, coalesce(len(ids), 0)::int as n_ids from part left join a using (p_brand, p_type)",
    "snapshot_diff": _VERSIONS + "select doc_id, case when a is null then 'added' when b is null then 'deleted' else 'changed' end as change from o full join n using (doc_id) where a is distinct from b",
    "incremental_merge": _VERSIONS + "select doc_id, b as digest from n",
    "branch_status": "select b.id as branch_id, b.name, r.status, coalesce(b.is_default, false) as is_default, b.last_commit_sha is not null as indexed from (select distinct * from branches) b left join (select distinct id, status from repositories) r on r.id = b.repository_id",
    "latest_built": "select b.repository_id, b.id as branch_id from branches b where b.repository_id = (select id from repositories where status = 'built' and built_at is not null order by built_at desc, id limit 1) and indexed_at is not null order by indexed_at desc, id limit 1",
    "build_stats": "select branch_id, mode, status, count(*) as n_runs, sum(files_changed)::bigint as files_changed from (select distinct * from build_runs) group by 1, 2, 3",
    "collection_size": "select branch_id, type, count(distinct chunk_id) as n_chunks from chunks group by 1, 2",
    "symbol_index": "with f as (select distinct path, id, x.name as name from (select path, id, unnest(analysis.functions) as x from files where analysis is not null)) select name, arg_max(path, path || '|' || id) as path, count(*) as n from f group by 1",
    "import_index": "select statement, count(distinct id) as n_files from (select id, unnest(analysis.imports) as statement from files where analysis is not null) group by 1",
    "report_findings": """with r as (select distinct branch_id, json_extract(issues_report, '$.by_file') as j from reports where issues_report is not null),
f as (select branch_id, unnest(from_json(v, '["json"]')) as x from (select branch_id, unnest(map_values(j::map(varchar, json))) as v from r))
select branch_id, x->>'severity' as severity, x->>'category' as category, count(*) as n_findings from f group by 1, 2, 3""",
}
