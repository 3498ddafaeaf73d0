"""One ranking from several differently-scaled scores (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.ranked import grouped_rank
from codeloom.session import table

#: The methods a chunk can be found by, and other names in use for them.
METHODS = ("semantic", "lexical", "graph", "churn")
ALIASES = {"dense": "semantic"}
#: Percentile of a chunk that a method found with a null score.
UNKNOWN = 0.5e-9
#: Rows of a query above which it is split.
HOT_ROWS = 1_000_000


def hit_rows(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, method, s, e) of the hits, one row per method named; rows without query or chunk are ignored."""
    rows = hits.where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()).select(
        "query_id", "chunk_id", F.explode("retrieval_methods").alias("method"), F.col("retrieval_score").cast("double").alias("s"), F.coalesce("exact_match", F.lit(False)).alias("e")
    )
    rows = rows.withColumn("method", F.lower(F.trim("method")))
    for other, name in ALIASES.items():
        rows = rows.withColumn("method", F.when(F.col("method") == other, F.lit(name)).otherwise(F.col("method")))
    # NaN says as little as null.
    return rows.withColumn("s", F.when(~F.isnan("s"), F.col("s")))


def method_scores(rows: DataFrame) -> DataFrame:
    """One row per (query_id, chunk_id, method): (score, exact).

    Repeated rows collapse; the larger score holds where a method found a chunk twice.
    ``score`` is null only where every score was.
    """
    return rows.groupBy("query_id", "chunk_id", "method").agg(F.max("s").alias("score"), F.max("e").alias("exact"))


def _percentiles(scores: DataFrame, split: bool) -> DataFrame:
    """(query_id, chunk_id, exact, p); ``split`` cuts a query's scores into value ranges instead of ranking them in one task."""
    if split:
        ranked = grouped_rank(scores.where(F.col("score").isNotNull()), ["query_id", "method"], "score", spread=F.col("chunk_id"))
    else:
        w = Window.partitionBy("query_id", "method")
        known = scores.where(F.col("score").isNotNull())
        ranked = known.withColumn("rank", F.rank().over(w.orderBy("score"))).withColumn("total", F.count(F.lit(1)).over(w))
    known = ranked.select("query_id", "chunk_id", "exact", (F.col("rank") / F.col("total")).alias("p"))
    unknown = scores.where(F.col("score").isNull()).select("query_id", "chunk_id", "exact", F.lit(UNKNOWN).alias("p"))
    return known.unionByName(unknown)


def _vectors(rows: DataFrame, methods: tuple[str, ...], split: bool) -> DataFrame:
    scores = method_scores(rows.where(F.col("method").isin(*methods)))
    return (
        _percentiles(scores, split)
        .groupBy("query_id", "chunk_id")
        .agg(F.collect_list("p").alias("v"), F.max("exact").alias("exact"))
        .select(
            "query_id",
            "chunk_id",
            F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(len(methods)) - F.size("v")))).alias("vector"),
            "exact",
        )
    )


def leximin_vectors(hits: DataFrame, methods: tuple[str, ...] = METHODS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, chunk_id, vector, exact): each chunk's percentiles over all methods, ascending.

    A score's percentile is its rank among the query's scores by that method, ties sharing the lowest,
    divided by their number, in (0, 1]. A chunk found with a null score gets less than any score,
    since it was found; a method that did not find it counts 0.
    Methods outside ``methods`` are ignored.

    A query of up to ``hot_rows`` rows is ranked where its rows are gathered, in one shuffle for everything. Larger ones are
    split by score ranges; both ways give the same vectors.
    """
    rows = hit_rows(hits)
    hot = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("query_id")
    # At most one query per ``hot_rows`` rows is hot.
    n_hot = hot.count()
    if not n_hot:
        return _vectors(rows.repartition("query_id"), methods, False)
    few = F.broadcast(hot) if n_hot <= 100_000 else hot
    usual = _vectors(rows.join(few, "query_id", "left_anti").repartition("query_id"), methods, False)
    return usual.unionByName(_vectors(rows.join(few, "query_id", "left_semi"), methods, True))


def leximin_rank(hits: DataFrame, top: int | None = None, methods: tuple[str, ...] = METHODS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, chunk_id, vector, exact, rank): the ranking of each query's chunks.

    Vectors are compared from their smallest entry up, larger first, so that a chunk's weakest method
    decides and no single method lifts it. Ties go to an exact match, then to the smaller chunk_id,
    so the order is total. With ``top``, only that many chunks per query are kept, and Spark drops the others before
    the shuffle. Rows without a query or chunk are ignored; an empty table gives no rows.
    """
    v = leximin_vectors(hits, methods, hot_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("vector"), F.desc("exact"), F.asc("chunk_id"))
    ranked = v.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top else ranked


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin_rank(table(spark, sf_dir, "search_hits"), top=3).select("query_id", "chunk_id")


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
with h as (
  select query_id, chunk_id, case when m = 'dense' then 'semantic' else m end as m,
         max(retrieval_score) as s, bool_or(coalesce(exact_match, false)) as e
  from (select *, unnest(retrieval_methods) as m from search_hits) group by 1, 2, 3),
r as (
  select query_id, chunk_id, m, s, e,
         rank() over (partition by query_id, m, s is null order by s)::double
         / count(*) over (partition by query_id, m, s is null) as p
  from h where m in ('semantic', 'lexical', 'graph', 'churn')),
v as (
  select query_id, chunk_id, bool_or(e) as e,
         list_sort(list_concat(list(case when s is null then 0.5e-9 else p end), list_value(0.0, 0.0, 0.0, 0.0)[1:4 - count(*)])) as v
  from r group by 1, 2),
k as (select *, row_number() over (partition by query_id order by v desc, e desc, chunk_id) as rn from v)
select query_id, chunk_id from k where rn <= 3""",
}
