"""Hybrid retrieval: BM25, vectors, rank fusion, evidence, confidence (TK1-TK7, JN9, JN11, FN16-FN18, AG10-AG13)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import tokenize
from codeloom.session import materialize

K1, B, PHRASE_BOOST = 1.2, 0.75, 2.0


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(corpus: DataFrame, key: str, query: str, top: int | None = DEFAULT.candidates) -> DataFrame:
    """TK1: (key, score, exact_match, rank) of documents that score above 0.

    Query tokens count as often as they occur. Statistics are over the whole corpus; term frequencies of the query's tokens are counted within each
    document's token array, so only one row a document is made and nothing but three totals is shuffled.
    Null documents count as empty. Ties go to the smaller key.
    """
    spark = corpus.sparkSession
    wanted = spark.range(1).select(tokenize(F.lit(query)).alias("q")).first()["q"]
    terms = sorted(set(wanted))
    docs = corpus.select(key, F.coalesce("document", F.lit("")).alias("document"))
    tf = [F.size(F.filter("tokens", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = docs.select(key, "document", tokenize(F.col("document")).alias("tokens")).select(key, F.size("tokens").alias("len"), F.lower("document").contains(query.lower().strip()).alias("exact_match"), *tf)
    # Texts are tokenised once; what is kept is a few numbers a document.
    counted = materialize(counted, "bm25-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    # One row of totals comes to the driver and goes back as literals, so that the documents are joined with nothing.
    total = stats.first()
    length = K1 * (1 - B + B * F.col("len") / F.lit(max(float(total["avg_len"] or 0), 1.0)))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df = total[f"df{i}"] or 0
        idf = math.log(1 + (total["n"] - df + 0.5) / (df + 0.5))
        score = score + F.lit(wanted.count(t) * idf) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + length)
    scored = counted.select(key, (score + F.when(F.col("exact_match"), PHRASE_BOOST).otherwise(0.0)).alias("score"), "exact_match").where(F.col("score") > 0)
    if top is not None:
        scored = scored.orderBy(F.desc("score"), key).limit(top)
    return scored


def dense_topk(vectors: DataFrame, key: str, query: list[float], top: int = DEFAULT.candidates) -> DataFrame:
    """TK2: (key, score) of the nearest vectors by cosine, exactly; zero and null vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    length = sum(x * x for x in query) ** 0.5
    scored = vectors.where(F.size("embedding") == len(query)).select(key, (dot / F.nullif(norm * length, F.lit(0.0))).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(top)


def fuse(hits: DataFrame, groups: list[str], item: str, weights: dict[str, float], k: int = DEFAULT.rrf_k) -> DataFrame:
    """TK3: reciprocal rank fusion of (groups, item, method, score, exact): (groups, item, rrf, score, methods, exact_match, rank).

    Ranks are by score within group and method, ties to the smaller item; ``score`` is relative to the group's best.
    """
    w = Window.partitionBy(*groups, "method").orderBy(F.desc("score"), item)
    ranked = hits.where(F.col("method").isin(*weights) & F.col("score").isNotNull()).withColumn("r", F.row_number().over(w))
    part = F.coalesce(*[F.when(F.col("method") == m, F.lit(x) / (F.lit(k) + F.col("r"))) for m, x in weights.items()])
    fused = ranked.groupBy(*groups, item).agg(F.sum(part).alias("rrf"), F.sort_array(F.collect_set("method")).alias("methods"), F.max("exact").alias("exact_match"))
    g = Window.partitionBy(*groups)
    order = g.orderBy(F.desc("rrf"), item)
    return fused.withColumn("rank", F.row_number().over(order)).withColumn("score", F.col("rrf") / F.max("rrf").over(g))


def filter_results(results: DataFrame, groups: list[str], top: int = DEFAULT.results) -> DataFrame:
    """TK7: the first of each (path, name) in rank order, ``top`` per group."""
    first = results.withColumn("f", F.row_number().over(Window.partitionBy(*groups, "path", "name").orderBy("rank"))).where("f = 1").drop("f")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy("rank"))).where(F.col("position") <= top)


def evidence(results: DataFrame) -> DataFrame:
    """FN16: a citation per result; rows without a path are left out."""
    span = F.when(F.col("start_line").isNull(), F.lit("")).when(F.col("end_line").isNull(), F.concat(F.lit(":"), "start_line")).otherwise(F.concat(F.lit(":"), "start_line", F.lit("-"), "end_line"))
    return results.where(F.col("path").isNotNull() & (F.col("path") != "")).withColumn("citation", F.concat("path", span)).withColumn("relevance", F.round("score", 3))


def confidence(results: DataFrame, groups: list[str]) -> DataFrame:
    """AG13: (groups, n_results, n_methods, n_exact, best, confidence, label)."""
    agg = results.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_results"), F.size(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("n_methods"), F.sum(F.coalesce(F.col("exact_match"), F.lit(False)).cast("long")).alias("n_exact"), F.max("score").alias("best")
    )
    raw = (30 + F.least(F.col("n_results"), F.lit(5)) * 7 + F.col("n_methods") * 8 + F.col("n_exact") * 6 + F.col("best") * 10)
    c = F.least(F.lit(95.0), F.bround(raw))
    return agg.withColumn("confidence", c).withColumn("label", F.when(c >= 75, "high").when(c >= 50, "medium").otherwise("low"))


def hybrid_search(corpus: DataFrame, vectors: DataFrame, key: str, query: str, query_vector: list[float], candidates: int = DEFAULT.candidates, top: int = DEFAULT.results) -> DataFrame:
    """TK4: (key, rrf, methods, exact_match, rank, score) of the ``top`` documents by words and vectors together.

    ``corpus`` (key, document) is what is searched, already filtered to a branch; vectors of other documents don't count. Each channel gives its ``candidates``, by their own order; the rest is
    fusion of at most twice as many rows.
    """
    words = bm25(corpus, key, query, candidates).select(key, F.lit("lexical").alias("method"), "score", F.col("exact_match").alias("exact"))
    near = dense_topk(vectors.join(corpus.select(key).distinct(), key, "left_semi"), key, query_vector, candidates).select(key, F.lit("semantic").alias("method"), "score", F.lit(False).alias("exact"))
    weights = {"semantic": DEFAULT.semantic_weight, "lexical": DEFAULT.lexical_weight}
    fused = fuse(words.unionByName(near).withColumn("__q", F.lit(0)), ["__q"], key, weights)
    return fused.where(F.col("rank") <= top).drop("__q")


def context_blocks(results: DataFrame, groups: list[str]) -> DataFrame:
    """FN18: the text a question is answered from: results (part 0) in order, then their neighbours (part 1), each with what it calls and is called by where ``relations`` says so."""
    end = F.when((F.coalesce("end_line", F.lit(0)) != 0) & (F.col("end_line") != F.col("start_line")), F.concat(F.lit("-"), "end_line")).otherwise("")
    span = F.when(F.coalesce("start_line", F.lit(0)) != 0, F.concat(F.lit(":"), "start_line", end)).otherwise("")
    said = F.when(F.col("type").isin("function", "class") & F.col("relations").isNotNull(), F.concat(F.lit("\n"), "relations")).otherwise("")
    block = F.concat(F.lit("SOURCE ["), F.coalesce("path", F.lit("unknown")), span, F.lit("] ("), F.coalesce("type", F.lit("code")), F.lit(" "), F.coalesce("name", F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")), said)
    rows = results.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("part", "nth", block.alias("b")))).alias("x"))
    return rows.select(*groups, F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("context"))
