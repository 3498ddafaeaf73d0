"""Queries: retrieval and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, ranked, retrieval
from codeloom.session import table

QUESTION = "merge the session shelf"
RRF_WEIGHTS = {"semantic": 0.6, "lexical": 0.4}


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("document"))


def bm25_topk(spark, d):
    """BM25 over all documents, as in the search over chunks."""
    return retrieval.bm25(_documents(spark, d), "doc_id", QUESTION).withColumn("score", F.round("score", 6))


def bm25_chunks(spark, d):
    """BM25 over chunks whose path and name count twice."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    n = F.coalesce("name", F.lit(""))
    return retrieval.bm25(c.select("chunk_id", F.concat_ws(" ", "path", n, "path", n, "text").alias("document")), "chunk_id", QUESTION).withColumn("score", F.round("score", 6))


def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    query = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    return retrieval.dense_topk(v, "vec_id", query).withColumn("score", F.round("score", 4))


def _method_hits(spark, d):
    h = table(spark, d, "search_hits").dropDuplicates(["hit_id"]).select("query_id", "chunk_id", "path", "name", "type", "start_line", "end_line", F.explode("retrieval_methods").alias("m"), F.col("retrieval_score").alias("score"), F.coalesce("exact_match", F.lit(False)).alias("exact"))
    return h.withColumn("method", F.when(F.col("m") == "dense", "semantic").otherwise(F.col("m")))


def _fused(spark, d):
    h = _method_hits(spark, d).groupBy("query_id", "chunk_id", "method").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
    return retrieval.fuse(h, ["query_id"], "chunk_id", RRF_WEIGHTS)


def _with_chunk(spark, d, df):
    c = _method_hits(spark, d).groupBy("chunk_id").agg(F.min("path").alias("path"), F.min("name").alias("name"), F.min("type").alias("type"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return df.join(c, "chunk_id")


def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "rank", F.round("rrf", 8).alias("rrf"), F.round("score", 4).alias("score"), F.array_join("methods", ",").alias("methods"), "exact_match")


def filter_results(spark, d):
    return retrieval.filter_results(_with_chunk(spark, d, _fused(spark, d)), ["query_id"]).select("query_id", "chunk_id", "position")


def evidence(spark, d):
    top = retrieval.filter_results(_with_chunk(spark, d, _fused(spark, d)), ["query_id"])
    return retrieval.evidence(top).select("query_id", "chunk_id", "citation", "relevance")


def confidence(spark, d):
    top = retrieval.filter_results(_with_chunk(spark, d, _fused(spark, d)), ["query_id"])
    return retrieval.confidence(top, ["query_id"]).withColumn("best", F.round("best", 6))


def _edges(spark, d):
    """Purchases of users in turn as edges."""
    e = ranked.lead_in_order(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", "user_id", "dst")
    return e.where("event_type = 'purchase' and dst is not null and user_id <> dst").select(F.col("user_id").alias("src"), "dst").distinct()


def graph_edges(spark, d):
    return _edges(spark, d)


def degree_coupling(spark, d):
    return graph.degrees(_edges(spark, d), 3)


def scc_cycles(spark, d):
    return graph.strong_components(_edges(spark, d))


def _seed(edges):
    return edges.agg(F.min("dst").alias("node")).where("node is not null")


def bfs_callers(spark, d):
    e = _edges(spark, d)
    return graph.reach(e, _seed(e), 4)


def change_impact_score(spark, d):
    """Direct and further callers of the seed, with the score and risk of changing it."""
    r = bfs_callers(spark, d)
    n = r.agg(F.sum((F.col("depth") == 1).cast("long")).alias("a"), F.sum((F.col("depth") > 1).cast("long")).alias("b"))
    n = n.select(F.coalesce("a", F.lit(0)).alias("direct"), F.coalesce("b", F.lit(0)).alias("transitive"))
    score, risk = graph.impact(F.col("direct"), F.col("transitive"), F.lit(0), F.lit(0))
    return n.select("direct", "transitive", score.alias("score"), risk.alias("risk"))


def graph_neighbours(spark, d):
    e = _edges(spark, d)
    return graph.neighbours(e, _seed(e))


def graph_expand(spark, d):
    """Neighbours of the ten users with the most edges."""
    e = _edges(spark, d)
    top = graph.degrees(e).orderBy(F.desc("coupling"), "node").limit(10).select("node", "coupling")
    ranked = top.select("node", (-F.col("coupling")).alias("rank"))
    return graph.expand(e, ranked, 25)


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_chunks, dense_topk, rrf_fusion, filter_results, evidence, confidence, graph_edges, degree_coupling, scc_cycles, bfs_callers, change_impact_score, graph_neighbours, graph_expand)}

_TOK = "list_transform(regexp_extract_all(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z][A-Za-z0-9_]*|[0-9]+'), lambda x: lower(x))"


def _bm25_sql(corpus, key):
    return f"""with c as ({corpus}), t as (select {key}, document, {_TOK.format('document')} as tk from c),
s as (select count(*) as n, greatest(avg(len(tk)), 1) as al from t),
q as (select unnest({_TOK.format("'" + QUESTION + "'")}) as term),
p as (select t.{key}, q.term, len(list_filter(t.tk, lambda x: x = q.term)) as tf, len(t.tk) as l from t cross join q),
df as (select term, count(*) filter (tf > 0) as df from (select distinct {key}, term, tf from p) group by 1),
x as (select p.{key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) as s from p join df using (term) cross join s group by 1),
y as (select t.{key}, coalesce(x.s, 0) + case when contains(lower(document), '{QUESTION}') then 2.0 else 0 end as score, contains(lower(document), '{QUESTION}') as exact_match from t left join x using ({key}))
select {key}, round(score, 6) as score, exact_match from y where score > 0 order by y.score desc, {key} limit 30"""


_FUSED = """with h as (select query_id, chunk_id, case when m = 'dense' then 'semantic' else m end as m, max(retrieval_score) as s, bool_or(coalesce(exact_match, false)) as e
  from (select distinct hit_id, query_id, chunk_id, retrieval_score, exact_match, unnest(retrieval_methods) as m from search_hits) group by 1, 2, 3),
r as (select *, row_number() over (partition by query_id, m order by s desc, chunk_id) as r from h where m in ('semantic', 'lexical') and s is not null),
f as (select query_id, chunk_id, sum(case m when 'semantic' then 0.6 else 0.4 end / (60 + r)) as rrf, array_to_string(list_sort(list(distinct m)), ',') as methods, bool_or(e) as exact_match from r group by 1, 2),
g as (select *, row_number() over (partition by query_id order by rrf desc, chunk_id) as rank, rrf / max(rrf) over (partition by query_id) as score from f),
c as (select chunk_id, min(path) as path, min(name) as name, min(start_line) as start_line, max(end_line) as end_line from search_hits group by 1),
d as (select g.*, c.path, c.name, c.start_line, c.end_line, row_number() over (partition by query_id, c.path, c.name order by rank) as fst from g join c using (chunk_id)),
t as (select *, row_number() over (partition by query_id order by rank) as position from d where fst = 1)
"""
_E = "e0 as (select user_id, event_type, lead(user_id) over (order by event_id) as dst from events), e as (select distinct user_id as src, dst from e0 where event_type = 'purchase' and dst is not null and user_id <> dst)"
_BFS = f"with recursive {_E}, seed as (select min(dst) as node from e), b as (select node, 0 as depth from seed union select e.src, b.depth + 1 from b join e on e.dst = b.node where b.depth < 4), m as (select node, min(depth)::int as depth from b where node not in (select node from seed) group by 1)"
SQL = {
    "bm25_topk": _bm25_sql("select doc_id, coalesce(text, '') as document from documents", "doc_id"),
    "bm25_chunks": _bm25_sql("select distinct chunk_id, concat_ws(' ', path, coalesce(name, ''), path, coalesce(name, ''), text) as document from chunks", "chunk_id"),
    "dense_topk": "select vec_id, round(score, 4) as score from (select vec_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as score from embeddings) order by 2 desc, 1 limit 30",
    "rrf_fusion": _FUSED + "select query_id, chunk_id, rank::int as rank, round(rrf, 8) as rrf, round(score, 4) as score, methods, exact_match from g",
    "filter_results": _FUSED + "select query_id, chunk_id, position::int as position from t where position <= 5",
    "evidence": _FUSED + "select query_id, chunk_id, path || case when start_line is null then '' when end_line is null then ':' || start_line else ':' || start_line || '-' || end_line end as citation, round(score, 3) as relevance from t where position <= 5 and path <> ''",
    "confidence": _FUSED + """, m as (select query_id, count(distinct x)::int as nm from (select query_id, unnest(string_split(methods, ',')) as x from t where position <= 5) group by 1),
 a as (select query_id, count(*) as n_results, sum(exact_match::int)::bigint as n_exact, max(score) as best from t where position <= 5 group by 1),
 z as (select a.query_id, n_results, nm as n_methods, n_exact, round(best, 6) as best, least(95.0, round_even((30 + least(n_results, 5) * 7 + nm * 8 + n_exact * 6 + best * 10)::double, 0))::double as confidence from a join m using (query_id))
 select *, case when confidence >= 75 then 'high' when confidence >= 50 then 'medium' else 'low' end as label from z""",
    "graph_edges": f"with {_E} select * from e",
    "degree_coupling": f"with {_E}, x as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) select node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out, (sum(i) + sum(o))::bigint as coupling from x group by 1 having sum(i) + sum(o) >= 3",
    "bfs_callers": _BFS + " select node, depth from m",
    "change_impact_score": _BFS + ", n as (select count(*) filter (depth = 1) as a, count(*) filter (depth > 1) as b from m) select a as direct, b as transitive, least(100, 10 + 10 * a + 5 * b) as score, case when least(100, 10 + 10 * a + 5 * b) >= 70 then 'high' when least(100, 10 + 10 * a + 5 * b) >= 35 then 'medium' else 'low' end as risk from n",
    "graph_neighbours": f"with {_E}, s as (select min(dst) as node from e) select distinct node from (select dst as node from e join s on src = s.node union all select src from e join s on dst = s.node)",
    "graph_expand": f"with {_E}, x as (select src as node from e union all select dst from e), t as (select node, -count(*) as rank from x group by 1 order by 2, 1 limit 10), c as (select dst as node, rank, 0 as side, dst as k from e join t on t.node = src union all select src, rank, 1, src from e join t on t.node = dst), m as (select node, min(row(rank, side, k)) as o, arg_min(rank, row(rank, side, k)) as fr, arg_min(side, row(rank, side, k)) as sd from c where node not in (select node from t) group by 1) select node, fr::bigint as from_rank, sd::int as side from m order by o limit 25",
}
