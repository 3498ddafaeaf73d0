"""Graph operators on edge tables (src, dst): degrees, bounded search, strong components, unreferenced nodes (GR7-GR15, AG5, AG17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import layer, layer_rank
from codeloom.session import materialize


def degrees(edges: DataFrame, least: int = 0) -> DataFrame:
    """AG5: (node, fan_in, fan_out, coupling), coupling from ``least``; one aggregation over both ends, combined before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    d = ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return d.withColumn("coupling", F.col("fan_in") + F.col("fan_out")).where(F.col("coupling") >= least)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = True) -> DataFrame:
    """GR10-GR11: (node, depth) of nodes within ``max_depth`` steps, seeds excluded, with their least depth.

    Each round joins the frontier with the edges and drops what was seen; the rounds are bounded by the depth, and each
    frontier is materialised so that the plan does not grow. Cycles end by the visited set.
    """
    step = materialize(edges.select(F.col("dst" if reverse else "src").alias("at"), F.col("src" if reverse else "dst").alias("node")).distinct(), "reach-edges")
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("node").alias("at")).join(step, "at").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def _spread(edges: DataFrame, labels: DataFrame, label: str, at: str, to: str) -> DataFrame:
    """Labels with the smallest one taken from ``at`` to ``to`` along the edges until it settles."""
    while True:
        pushed = edges.join(labels.withColumnRenamed("node", at), at).select(F.col(to).alias("node"), label)
        new = materialize(labels.unionByName(pushed).groupBy("node").agg(F.min(label).alias(label)), "scc-labels")
        settled = new.join(labels, ["node", label], "left_anti").isEmpty()
        labels = new
        if settled:
            return labels


def strong_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """GR7: (node, component) of nodes on a cycle; a component is named by its smallest node, self-loops count.

    Repeats: trim nodes that have no edge in or no edge out; spread the smallest label forward and backward until both settle. Where both are
    equal, the node reaches the label's and is reached by it: these are whole components, at least that of the smallest node, and are removed. Edges between nodes of
    unlike labels lie on no cycle and are removed too. Ends when no edge is left; with ``max_rounds``, an error says so if edges are left.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    parts = []
    while True:
        while True:
            n = left.count()
            both = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            trimmed = left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
            left = materialize(trimmed, "scc-edges")
            if left.count() == n:
                break
        if left.isEmpty():
            break
        if max_rounds is not None and len(parts) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        own = left.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
        forward = _spread(left, own, "label", "src", "dst")
        backward = _spread(left, own.withColumnRenamed("label", "back"), "back", "dst", "src")
        labels = materialize(forward.join(backward, "node"), "scc-found")
        parts.append(labels.where("label = back").select("node", "label"))
        rest = labels.where("label <> back")
        a, b = (rest.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"), F.col("back").alias(f"b_{c}")) for c in ("src", "dst"))
        left = materialize(left.join(a, "src").join(b, "dst").where("l_src = l_dst and b_src = b_dst").select("src", "dst"), "scc-edges")
    out = None
    for p in parts:
        rows = p.select("node", F.col("label").alias("component"))
        out = rows if out is None else out.unionByName(rows)
    single = loops.select("node", F.col("node").alias("component"))
    if out is None:
        return single
    # A root whose component is itself alone lies on no cycle.
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    cyclic = out.join(sizes, "component", "left_semi").select("node", "component")
    return cyclic.unionByName(single.join(cyclic, "node", "left_anti"))


def layer_violations(edges: DataFrame) -> DataFrame:
    """GR8: edges that go up a layer or skip one; endpoints outside the layers are left out."""
    e = edges.withColumn("src_layer", layer(F.col("src"))).withColumn("dst_layer", layer(F.col("dst"))).where("src_layer is not null and dst_layer is not null")
    s, d = layer_rank(F.col("src_layer")), layer_rank(F.col("dst_layer"))
    return e.withColumn("kind", F.when(d < s, "reverse").when(d > s + 1, "skipped")).where("kind is not null")


def unreferenced(definitions: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """JN8: definitions that nothing calls."""
    return definitions.join(calls.select(key).distinct(), key, "left_anti")


def neighbours(edges: DataFrame, items: DataFrame) -> DataFrame:
    """GR15: nodes one step from the given ones, in both directions."""
    i = items.select("node").distinct()
    out = edges.join(i.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    back = edges.join(i.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"))
    return out.unionByName(back).distinct()


def expand(edges: DataFrame, ranked: DataFrame, top: int = DEFAULT.expansion_results) -> DataFrame:
    """GR14: (node, position) of what the ranked nodes call, then what calls them, in order, without the nodes themselves."""
    calls = edges.join(ranked.select(F.col("node").alias("src"), "rank"), "src").select(F.col("dst").alias("node"), F.struct("rank", F.lit(0).alias("side"), F.col("dst").alias("k")).alias("o"))
    back = edges.join(ranked.select(F.col("node").alias("dst"), "rank"), "dst").select(F.col("src").alias("node"), F.struct("rank", F.lit(1).alias("side"), F.col("src").alias("k")).alias("o"))
    first = calls.unionByName(back).groupBy("node").agg(F.min("o").alias("o")).join(ranked.select("node"), "node", "left_anti")
    return first.orderBy("o").limit(top).select("node", F.col("o.rank").alias("from_rank"), F.col("o.side").alias("side"))


def impact(direct: F.Column, transitive: F.Column, modules: F.Column, endpoints: F.Column) -> tuple[F.Column, F.Column]:
    """AG17: (score, risk)."""
    score = F.least(F.lit(100), 10 + 10 * direct + 5 * transitive + 4 * modules + 10 * endpoints)
    return score, F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")
