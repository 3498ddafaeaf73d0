"""Queries: reports over stored analyses, whole searches and what an answer is given to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph, history, impact, issues, reports, retrieval
from codeloom.plans import scanning, search
from codeloom.session import materialize, table


def _files(spark, d):
    return reports.once(table(spark, d, "files"))


def _found(spark, d):
    return issues.findings(table(spark, d, "files"))


def stored_calls(spark, d):
    """Call edges of all branches, resolved where a symbol of the name is defined."""
    return reports.stored_calls(_files(spark, d))


def call_nodes(spark, d):
    f = _files(spark, d)
    return reports.call_nodes(f, reports.stored_calls(f))


def function_calls(spark, d):
    """What the first function of the alphabet that calls anything calls, in every branch."""
    calls = materialize(stored_calls(spark, d), "stored-calls")
    name = calls.agg(F.min(F.regexp_extract("src", "::([^:]*)$", 1)).alias("n")).first()["n"]
    return reports.calls_of(calls, name or "")


def dead_symbols(spark, d):
    """Python symbols of stored analyses that nothing in their branch calls."""
    f = _files(spark, d)
    return reports.dead_symbols(f, reports.stored_calls(f))


def dead_code_report(spark, d):
    return reports.dead_code_report(table(spark, d, "files"), dead_symbols(spark, d))


def stored_imports(spark, d):
    return reports.stored_imports(_files(spark, d))


def architecture_nodes(spark, d):
    return reports.architecture(table(spark, d, "files"), stored_imports(spark, d), "src/")


def _architecture(spark, d):
    edges = materialize(stored_imports(spark, d), "stored-imports")
    return reports.architecture_health(reports.architecture(table(spark, d, "files"), edges), edges)


def architecture_health(spark, d):
    return _architecture(spark, d)["summary"]


def issue_report(spark, d):
    return reports.issue_report(table(spark, d, "files"), _found(spark, d))


def issue_explained(spark, d):
    return reports.explained(_found(spark, d)).groupBy("id", "message", "solution").agg(F.count(F.lit(1)).alias("n_findings"))


def finding_groups(spark, d):
    """Files with security findings of each branch, riskiest first."""
    return reports.finding_groups(_found(spark, d), category="security")


def _manifests(spark, d):
    f = table(spark, d, "files").where(F.lower(T.base_name(F.col("path"))).isin("requirements.txt", "package.json", "pyproject.toml"))
    return f.select("branch_id", "path", F.col("analysis.raw_text").alias("content")).dropDuplicates(["branch_id", "path"])


def manifest_parse(spark, d):
    """Dependencies of all manifests among the files."""
    return history.dependencies(_manifests(spark, d).select("path", "content"))


def _inputs(spark, d):
    found = materialize(_found(spark, d).select("branch_id", "severity", "category"), "findings")
    files = table(spark, d, "files")
    churned = history.churn(table(spark, d, "file_log").distinct(), ["branch_id", "path"], "logged_at")
    none = spark.createDataFrame([], "branch_id string, vulnerable_count long")
    branches = files.select("branch_id").unionByName(table(spark, d, "branches").select(F.col("id").alias("branch_id"))).distinct()
    return found, reports.health_inputs(branches, found, dead_code_report(spark, d), architecture_health(spark, d), none, churned)


def health_score(spark, d):
    """The score of every branch, from its findings, unreferenced symbols, file graph and churn."""
    return reports.health(_inputs(spark, d)[1])


def health_deductions(spark, d):
    found, inputs = _inputs(spark, d)
    return reports.deductions(inputs, found)


def _scope(spark, d):
    return table(spark, d, "documents").agg(F.min("repository_id").alias("r")).first()["r"]


def hybrid_search(spark, d):
    """Words and vectors over the documents of one repository, fused; the vectors are those of the table ``embeddings``."""
    docs = table(spark, d, "documents").where(F.col("repository_id") == F.lit(_scope(spark, d))).select("doc_id", F.coalesce("text", F.lit("")).alias("document")).dropDuplicates(["doc_id"])
    vectors = table(spark, d, "embeddings")
    query = [float(x) for x in vectors.where("vec_id = 0").first()["embedding"]]
    return retrieval.hybrid_search(docs, vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", search.QUESTION, query).select("doc_id", "rank", F.round("rrf", 8).alias("rrf"), F.round("score", 4).alias("score"), F.array_join("methods", ",").alias("methods"), "exact_match")


def _asked(spark, d):
    """(results, calls, functions) of the searches in ``search_hits``, each result in the branch of its chunk."""
    top = retrieval.filter_results(search._with_chunk(spark, d, search._fused(spark, d)), ["query_id"])
    chunks = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("branch_id").alias("branch_id"), F.min("text").alias("text"))
    results = materialize(top.join(chunks, "chunk_id", "left"), "asked")
    f = _files(spark, d)
    return results, materialize(reports.stored_calls(f), "stored-calls"), reports.symbols(f)


def ask_expansion(spark, d):
    results, calls, functions = _asked(spark, d)
    return reports.expansions(results, calls, functions, ["query_id"]).select("query_id", "path", "name", "nth", F.md5("text").alias("digest"))


def ask_context(spark, d):
    """What each query's answer is given to read: the results with what they call and are called by, then the sources of their neighbours."""
    results, calls, functions = _asked(spark, d)
    key = lambda c: F.concat("branch_id", F.lit(":"), c)
    said = impact.relations(calls.select(key("src").alias("src"), key("dst").alias("dst")))
    more = reports.expansions(results, calls, functions, ["query_id"])
    rows = results.select("query_id", "branch_id", "path", "name", "type", "start_line", "end_line", "text", F.col("position").alias("nth"), F.lit(0).alias("part"))
    rows = rows.unionByName(more.select("query_id", "branch_id", "path", "name", F.lit("function").alias("type"), "start_line", "end_line", "text", "nth", F.lit(1).alias("part")))
    return retrieval.context_blocks(rows.withColumn("node", key(F.concat("path", F.lit("::"), "name"))).join(said, "node", "left"), ["query_id"]).select("query_id", F.md5("context").alias("digest"), F.length("context").alias("n_chars"))


QUERIES = {f.__name__: f for f in (stored_calls, call_nodes, function_calls, dead_symbols, dead_code_report, stored_imports, architecture_nodes, architecture_health, issue_report, issue_explained, finding_groups, manifest_parse, health_score, health_deductions, hybrid_search, ask_expansion, ask_context)}

_F = "fa as (select distinct id, branch_id, path, analysis as a from files where analysis is not null)"
_SYMBOLS = _F + """, s0 as (select branch_id, path, x.name as name, 'function' as type, x.start_line as line, x.end_line as end_line, x.code as code from (select branch_id, path, unnest(a.functions) as x from fa) where x.name is not null
 union all select branch_id, path, c, 'class', cl[c].start_line, cl[c].end_line, null from (select branch_id, path, unnest(a.classes) as c, a.class_locations as cl from fa) where c is not null)"""
_CALLS = _SYMBOLS + """, ge as (select branch_id, path, unnest(map_entries(a.graph)) as e from fa),
c0 as (select distinct branch_id, path, e.key as caller, unnest(e.value) as name from ge),
own as (select distinct branch_id, path, name from s0), fst as (select branch_id, name, min(path) as first from own group by 1, 2),
k as (select distinct c0.branch_id, c0.path || '::' || c0.caller as src, case when o.name is not null then c0.path else t.first end || '::' || c0.name as dst
  from c0 left join own o on o.branch_id = c0.branch_id and o.path = c0.path and o.name = c0.name left join fst t on t.branch_id = c0.branch_id and t.name = c0.name)"""
_DEAD = _CALLS + """, dd as (select branch_id, path, name, type, line from (select *, row_number() over (partition by branch_id, path, name order by type desc, line desc nulls last) as rn from s0 where ends_with(path, '.py')) where rn = 1),
dead as (select * from dd where not regexp_full_match(name, 'main|__init__|test_.*|.*_test') and not exists (select 1 from k where k.branch_id = dd.branch_id and k.dst = dd.path || '::' || dd.name)),
dr as (select b.branch_id, coalesce(n, 0) as total_dead, python_files from (select branch_id, count(distinct path) filter (ends_with(path, '.py')) as python_files from files group by 1) b left join (select branch_id, count(*) as n from dead group by 1) using (branch_id))"""
_P = "replace(path, chr(92), '/')"
_IMPORTS = f"""i0 as (select branch_id, {_P} as src, regexp_extract(s, '^\\s*(?:from|import)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1) as m from (select branch_id, path, unnest(a.imports) as s from fa where ends_with(path, '.py'))),
i1 as (select distinct branch_id, {_P} as dst, replace(regexp_replace({_P}, '\\.py$', ''), '/', '.') as m from fa where ends_with(path, '.py')),
e as (select distinct i0.branch_id, src, dst from i0 join i1 on i0.branch_id = i1.branch_id and i0.m = i1.m where src <> dst)"""
_NODES = f"""n0 as (select branch_id, path, {scanning._lang_sql('path')} as language from (select distinct branch_id, {_P} as path from files)),
nodes as (select n0.*, not exists (select 1 from e where e.branch_id = n0.branch_id and (e.src = n0.path or e.dst = n0.path)) as isolated from n0 where language is not null)"""
_LAYER = "case " + " ".join(f"when regexp_matches('/' || lower({{0}}) || '/', '/(?:{'|'.join(dirs)})/') then {i}" for i, (_, dirs) in enumerate(T.LAYERS)) + " end"
_HEALTH = f"""r as (select branch_id, src, dst from e union select r.branch_id, r.src, e.dst from r join e on e.branch_id = r.branch_id and e.src = r.dst),
cy as (select a.branch_id, a.src as node, min(least(a.src, a.dst)) as component from r a join r b on a.branch_id = b.branch_id and a.src = b.dst and a.dst = b.src group by 1, 2),
v as (select branch_id, count(*) as n from (select branch_id, {_LAYER.format('src')} as s, {_LAYER.format('dst')} as t from e) where t < s or t > s + 1 group by 1),
cc as (select branch_id, count(distinct component) as n from cy group by 1), en as (select branch_id, count(*) as n from e group by 1),
hc as (select branch_id, count(*) as n from (select branch_id, node from (select branch_id, src as node from e union all select branch_id, dst from e) group by 1, 2 having count(*) >= 8) group by 1),
ah as (select b.branch_id, n_nodes, coalesce(en.n, 0) as n_edges, coalesce(v.n, 0) as layer_violations, coalesce(cc.n, 0) as circular_dependencies, coalesce(hc.n, 0) as high_coupling_modules
  from (select branch_id, count(*) as n_nodes from nodes group by 1) b left join en using (branch_id) left join v using (branch_id) left join cc using (branch_id) left join hc using (branch_id))"""
_COUNTS = ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in issues.SEVERITIES)
_PTS = "case severity " + " ".join(f"when '{s}' then {p}" for s, p in history.SEVERITY_POINTS.items()) + " else 1.0 end"
_BOUND = "greatest(0.0, least(100.0, round_even(({0})::double, 0)))"
_RISK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_INPUTS = (
    scanning._FOUND.replace("with ", "with recursive ", 1) + ", " + _DEAD + ",\n" + _IMPORTS + ",\n" + _NODES + ",\n" + _HEALTH + f""",
lg as (select distinct * from file_log), ch as (select branch_id, path, count(*) as churn from lg where logged_at >= (select max(logged_at) from lg) - interval 90 day group by 1, 2),
hs as (select branch_id, least(40, sum(churn - 4))::double as points, count(*) as n from (select *, row_number() over (partition by branch_id order by churn desc, path) as rr from ch) where rr <= 20 and churn >= 5 group by 1),
fp as (select branch_id, sum(case when category = 'security' then {_PTS} else 0 end)::double as s, sum(case when category = 'quality' then {_PTS} else 0 end)::double as q from found group by 1),
inp as (select b.branch_id, coalesce(s, 0) as s, coalesce(q, 0) as q, coalesce(total_dead, 0) as dead, coalesce(layer_violations, 0) as lv, coalesce(circular_dependencies, 0) as cd, coalesce(high_coupling_modules, 0) as hm, coalesce(points, 0) as hp, coalesce(hs.n, 0) as hn
  from (select branch_id from files union select id from branches) b left join fp using (branch_id) left join dr using (branch_id) left join ah using (branch_id) left join hs using (branch_id))"""
)


def _values(rows):
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_ASKED = search._FUSED + ", ty as (select chunk_id, min(type) as type from search_hits group by 1), ck as (select chunk_id, min(branch_id) as branch_id, min(text) as text from chunks group by 1), res as (select t.query_id, ck.branch_id, t.path, t.name, ty.type, t.start_line, t.end_line, ck.text, t.rank, t.position as nth from t join ty using (chunk_id) left join ck using (chunk_id) where position <= 5),\n" + _CALLS + """,
w0 as (select query_id, res.branch_id, k.dst as key, rank, 0 as side from res join k on k.branch_id = res.branch_id and k.src = res.path || '::' || res.name where type in ('function', 'class') and k.dst is not null
  union all select query_id, res.branch_id, k.src, rank, 1 from res join k on k.branch_id = res.branch_id and k.dst = res.path || '::' || res.name where type in ('function', 'class')),
w1 as (select *, row_number() over (partition by query_id, branch_id, key order by rank, side) as rn from w0),
cd as (select branch_id, key, line, end_line, code from (select branch_id, path || '::' || name as key, line, end_line, code, row_number() over (partition by branch_id, path, name order by line nulls first, end_line nulls first, code) as rn from s0 where type = 'function' and code is not null) where rn = 1),
ex as (select query_id, w1.branch_id, string_split(key, '::')[1] as path, string_split(key, '::')[2] as name, line as start_line, end_line, code as text, row_number() over (partition by query_id order by rank, side, key) as nth
  from w1 join cd using (branch_id, key) where w1.rn = 1 and not exists (select 1 from res where res.query_id = w1.query_id and res.branch_id = w1.branch_id and res.path || '::' || res.name = w1.key))"""
SQL = {
    "stored_calls": f"with {_CALLS} select * from k",
    "call_nodes": f"with {_CALLS} select n.branch_id, n.node, coalesce(a.n, 0) as n_calls, coalesce(b.n, 0) as n_called_by from (select distinct branch_id, path || '::' || name as node from s0) n left join (select branch_id, src as node, count(*) as n from k group by 1, 2) a using (branch_id, node) left join (select branch_id, dst as node, count(*) as n from k where dst is not null group by 1, 2) b using (branch_id, node)",
    "function_calls": f"with {_CALLS}, m as (select min(regexp_extract(src, '::([^:]*)$', 1)) as name from k), h as (select k.* from k, m where ends_with(src, '::' || name)) select * from h where src = (select min(src) from h h2 where h2.branch_id = h.branch_id)",
    "dead_symbols": f"with {_DEAD} select branch_id, path, name, type, line from dead",
    "dead_code_report": f"with {_DEAD} select * from dr",
    "stored_imports": f"with {_F}, {_IMPORTS} select * from e",
    "architecture_nodes": f"with {_F}, {_IMPORTS}, {_NODES} select * from nodes where starts_with(path, 'src')",
    "architecture_health": f"with recursive {_F}, {_IMPORTS}, {_NODES}, {_HEALTH} select * from ah",
    "issue_report": scanning._FOUND + f", l as (select branch_id, count(distinct path) as total_files_scanned from files group by 1), c as (select branch_id, count(*) as total_findings, {_COUNTS} from found group by 1) select l.branch_id, total_files_scanned, coalesce(total_findings, 0) as total_findings, " + ", ".join(f"coalesce({s}, 0) as {s}" for s in issues.SEVERITIES) + " from l left join c using (branch_id)",
    "issue_explained": scanning._FOUND + f", x(id, message, solution) as (values {_values(reports.EXPLAINED)}) select id, message, solution, count(*) as n_findings from found join x using (id) group by 1, 2, 3",
    "finding_groups": scanning._FOUND + f" select branch_id, path, count(*) as n_findings, sum({_RISK})::bigint as risk_score, arg_max(severity, {_RISK}) as worst from found where category = 'security' group by 1, 2",
    "health_score": _INPUTS + f", z as (select branch_id, {_BOUND.format('100 - s')} as security, {_BOUND.format(_BOUND.format('100 - q') + ' - least(25.0, 1.5 * dead)')} as maintainability, {_BOUND.format('100 - 6 * lv - 15 * cd - 3 * hm')} as architecture, 100.0::double as dependencies, {_BOUND.format('100 - hp')} as change_risk from inp), y as (select *, {_BOUND.format('security * 0.25::double + maintainability * 0.2::double + architecture * 0.25::double + dependencies * 0.15::double + change_risk * 0.15::double')} as overall from z) select *, case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' else 'F' end as grade from y",
    "health_deductions": _INPUTS + f""" select branch_id, case when category = 'quality' then 'maintainability' else category end as category, count(*) || ' ' || severity || ' ' || category || ' finding(s)' as reason, round(sum({_PTS})::double, 2) as points from found where category in ('security', 'quality') group by branch_id, found.category, severity
union all select branch_id, 'maintainability', dead || ' potentially unreferenced symbol(s)', least(25.0, 1.5 * dead)::double from inp where dead > 0
union all select branch_id, 'architecture', lv || ' layer violation(s)', (6.0 * lv)::double from inp where lv > 0
union all select branch_id, 'architecture', cd || ' dependency cycle(s)', (15.0 * cd)::double from inp where cd > 0
union all select branch_id, 'architecture', hm || ' highly coupled module(s)', (3.0 * hm)::double from inp where hm > 0
union all select branch_id, 'change_risk', hn || ' high-churn file(s)', hp::double from inp where hn > 0""",
    "hybrid_search": "with lex as (select doc_id, 'lexical' as m, score as s, exact_match as e from (" + search._bm25_sql("select distinct doc_id, coalesce(text, '') as document from documents where repository_id = (select min(repository_id) from documents)", "doc_id").replace("round(score, 6) as score", "y.score as score") + """)),
sem as (select vec_id as doc_id, 'semantic' as m, s, false as e from (select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from embeddings where vec_id in (select doc_id from documents where repository_id = (select min(repository_id) from documents))) order by s desc, vec_id limit 30),
h as (select *, row_number() over (partition by m order by s desc, doc_id) as r from (select * from lex union all select * from sem)),
u as (select doc_id, sum(case m when 'semantic' then 0.6 else 0.4 end / (60 + r)) as rrf, array_to_string(list_sort(list(distinct m)), ',') as methods, bool_or(e) as exact_match from h group by 1),
o as (select *, row_number() over (order by rrf desc, doc_id) as rank, rrf / max(rrf) over () as score from u)
select doc_id, rank::int as rank, round(rrf, 8) as rrf, round(score, 4) as score, methods, exact_match from o where rank <= 5""",
    "ask_expansion": _ASKED + " select query_id, path, name, nth::int as nth, md5(text) as digest from ex where nth <= 5",
    "ask_context": _ASKED + """, al as (select query_id, branch_id, path, name, type, start_line, end_line, text, nth, 0 as part from res union all select query_id, branch_id, path, name, 'function', start_line, end_line, text, nth, 1 from ex where nth <= 5),
ko as (select branch_id, src as node, string_agg(n, ', ' order by n) as x from (select distinct branch_id, src, string_split(dst, '::')[2] as n from k where dst is not null) group by 1, 2),
kb as (select branch_id, dst as node, string_agg(n, ', ' order by n) as x from (select distinct branch_id, dst, string_split(src, '::')[2] as n from k where dst is not null) group by 1, 2),
bl as (select query_id, part, nth, 'SOURCE [' || coalesce(al.path, 'unknown') || case when coalesce(start_line, 0) = 0 then '' else ':' || start_line || case when coalesce(end_line, 0) = 0 or end_line = start_line then '' else '-' || end_line end end || '] (' || coalesce(type, 'code') || ' ' || coalesce(al.name, '') || ')' || chr(10) || coalesce(al.text, '')
  || case when type in ('function', 'class') and (ko.x is not null or kb.x is not null) then chr(10) || concat_ws(chr(10), 'Calls: ' || ko.x, 'Called by: ' || kb.x) else '' end as b
  from al left join ko on ko.branch_id = al.branch_id and ko.node = al.path || '::' || al.name left join kb on kb.branch_id = al.branch_id and kb.node = al.path || '::' || al.name),
cx as (select query_id, string_agg(b, chr(10) || chr(10) order by part, nth) as context from bl group by 1)
select query_id, md5(context) as digest, length(context)::int as n_chars from cx""",
}
