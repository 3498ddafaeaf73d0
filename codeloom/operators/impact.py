"""What a change reaches (GR9-GR12, FN17, JN12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import ENTRY_DECORATORS, is_test
from codeloom.operators import graph
from codeloom.session import materialize


def seeds(nodes: DataFrame, target: str) -> DataFrame:
    """GR9: (node) that a target names: the exact key, else the key in any case, else the symbols of a file, else the symbols of a short name in any case.

    All four are tried in one scan, and the first kind that any node meets counts.
    """
    low = target.lower()
    key = F.lower("node")
    path, name = F.regexp_replace("node", "::[^:]*$", ""), F.lower(F.regexp_extract("node", "::([^:]*)$", 1))
    tier = F.when(F.col("node") == target, 0).when(F.lit("::" in target) & (key == low), 1).when(path == target.replace("\\", "/"), 2).when(name == low.split("::")[-1], 3)
    met = nodes.select("node").distinct().withColumn("tier", tier).where("tier is not null")
    least = met.agg(F.min("tier").alias("least"))
    return met.join(F.broadcast(least), F.col("tier") == F.col("least")).select("node")


def change_impact(calls: DataFrame, file_edges: DataFrame, definitions: DataFrame, target: str, depth: int = DEFAULT.impact_depth) -> dict[str, DataFrame]:
    """GR12: tables ``symbols`` (node, depth, line, reason, is_test, is_endpoint), ``modules`` (node, depth) and ``summary`` (one row with the score).

    ``calls`` and ``file_edges`` are (src, dst), ``definitions`` (node, line, decorators). Depth is held within 1 and 8. A target that nothing
    is named by has no rows and score 0.
    """
    depth = max(1, min(8, depth))
    nodes = calls.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(definitions.select("node"))
    start = materialize(seeds(nodes.where("node is not null"), target), "impact-seeds")
    callers = graph.reach(calls.where("dst is not null").select("src", "dst"), start, depth)
    hit = start.withColumn("depth", F.lit(0)).unionByName(callers).join(definitions, "node", "left")
    endpoint = F.coalesce(F.arrays_overlap("decorators", F.array(*[F.lit(d) for d in ENTRY_DECORATORS])), F.lit(False))
    reason = F.when(F.col("depth") == 0, "changed target").otherwise(F.concat(F.lit("transitive caller at depth "), "depth"))
    symbols = hit.select("node", "depth", "line", reason.alias("reason"), is_test(F.col("node")).alias("is_test"), endpoint.alias("is_endpoint"))
    paths = start.select(F.regexp_replace("node", "::[^:]*$", "").alias("node")).unionByName(
        file_edges.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node") == target.replace("\\", "/"))
    )
    modules = graph.reach(file_edges, paths, depth)
    n = symbols.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("depth") == 1).cast("long")).alias("direct"), F.sum((F.col("depth") > 1).cast("long")).alias("transitive"), F.sum(F.col("is_endpoint").cast("long")).alias("endpoints")
    )
    n = n.withColumn("modules", F.lit(modules.count())).fillna(0)
    score, _ = graph.impact(F.col("direct"), F.col("transitive"), F.col("modules"), F.col("endpoints"))
    total = F.when((F.col("n") > 0) | (F.col("modules") > 0), score).otherwise(F.lit(0))
    risk = F.when(total >= 70, "high").when(total >= 35, "medium").otherwise("low")
    return {"symbols": symbols, "modules": modules, "summary": n.select("direct", "transitive", "modules", "endpoints", total.alias("score"), risk.alias("risk"))}


def relations(calls: DataFrame) -> DataFrame:
    """FN17: (node, relations): what a symbol calls and what calls it, as text, from resolved edges."""
    known = calls.where("dst is not null").select("src", "dst").distinct()
    name = lambda c: F.regexp_extract(c, "::([^:]*)$", 1)
    out = known.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set(name("dst"))), ", ").alias("calls"))
    back = known.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_set(name("src"))), ", ").alias("called_by"))
    both = out.join(back, "node", "full")
    return both.select("node", F.concat_ws("\n", F.concat(F.lit("Calls: "), "calls"), F.concat(F.lit("Called by: "), "called_by")).alias("relations"))
