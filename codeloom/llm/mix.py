"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.tokens import RANKS, clean_source, sized
from codeloom.session import materialize, table

#: Rows a block of a permutation holds, about.
BLOCK_ROWS = 10_000


def temperature_weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights proportional to share ** exponent."""
    return tempered(sizes, dict.fromkeys([k for k, v in sizes.items() if v > 0], exponent), 1.0)


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(f, low: float, high: float, rounds: int = 60) -> float:
    """The largest x in [low, high] with f(x) true, where f turns from true to false once; ``low`` if there is none."""
    if f(high):
        return high
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) else (low, mid)
    return low


def exponent_for_entropy(sizes: dict[str, float], target: float) -> float:
    """The exponent of share ** x whose mixture has the target entropy: 1 leaves the natural shares, 0 makes them even."""
    return bisect(lambda x: entropy(temperature_weights(sizes, x)) >= target, 0.0, 8.0)


def largest_budget(sizes: dict[str, float], weights: dict[str, float], repeats: dict[str, int]) -> float:
    """The most tokens a mixture of these weights can have when no source is repeated more than allowed."""
    return min((repeats[k] * sizes[k] / w for k, w in weights.items() if w > 0), default=0.0)


def target_exponents(sizes: dict[str, float], targets: dict[str, float]) -> dict[str, float]:
    """The exponent at which each source's natural share becomes its target: share ** x = target, by bisection; 1 keeps the share, less lifts a small source.

    One temperature for all sources can't meet given shares (see :func:`exponent_for_entropy`), one for each can. A single source keeps its share.
    """
    total = sum(sizes.values())
    out = {}
    for k, t in targets.items():
        share = sizes[k] / total
        out[k] = 1.0 if share >= 1 else bisect(lambda x, s=share, t=t: x * -math.log(s) <= -math.log(t), 0.0, max(1.0, 2 * math.log(t) / math.log(share)), 80)
    return out


def tempered(sizes: dict[str, float], exponents: dict[str, float], heat: float) -> dict[str, float]:
    """Weights share ** (1 + heat * (exponent - 1)), normalised: natural at heat 0, the exponents' shares at heat 1."""
    total = sum(sizes.values())
    logs = {k: math.log(sizes[k] / total) * (1 + heat * (x - 1)) for k, x in exponents.items()}
    top = max(logs.values(), default=0.0)
    w = {k: math.exp(v - top) for k, v in logs.items()}
    s = sum(w.values())
    return {k: v / s for k, v in w.items()}


def plan(sizes: dict[str, float], targets: dict[str, float], repeats: dict[str, int], budget: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(heat, budget, weights) of a mixture.

    Every source's exponent is bisected to its target share, and the heat, by which all exponents go from natural shares to the targets, is bisected to the largest at
    which no source exceeds its repetitions. Without a budget the largest is taken, itself bisected, that keeps the targets; a larger one cools the mixture down.
    Sources without tokens, target or repetitions get none; the targets of the others are scaled to sum to 1.
    """
    live = {k: targets[k] for k in targets if sizes.get(k, 0) > 0 and targets[k] > 0 and repeats.get(k, 1) > 0}
    if not live:
        return 0.0, 0.0, {}
    s = sum(live.values())
    live = {k: v / s for k, v in live.items()}
    have = {k: sizes[k] for k in live}
    exponents = target_exponents(have, live)
    fits = lambda heat, tokens: all(w * tokens <= repeats[k] * have[k] * (1 + 1e-12) for k, w in tempered(have, exponents, heat).items())
    all_tokens = sum(repeats[k] * have[k] for k in live)
    if budget is None:
        budget = bisect(lambda b: fits(1.0, b), 0.0, all_tokens)
    heat = bisect(lambda h: fits(h, budget), 0.0, 1.0)
    weights = tempered(have, exponents, heat)
    return heat, min(budget, largest_budget(have, weights, repeats)), weights


def permuted(sizes: DataFrame, quota: dict[str, float], seed: int = 0) -> DataFrame:
    """(source, doc_id, n_tokens, pass_no, token_start, mix_order): every source repeated up to its quota of tokens.

    Each pass is a permutation of its own; whole passes take every document, the last takes a prefix. A permutation is by a hash of pass and document, cut into blocks by the hash's range;
    running sums are taken within blocks and over the blocks' totals, so that no source is gathered in one task. A document is in the prefix if its middle token is, and documents longer than
    all that the last pass may take are not in it, so a source misses its quota by half a document at most where it has enough shorter ones. ``mix_order``, from 0 to 1, is the place in the mixture: sorted by it, every stretch holds the sources by their shares.
    """
    spark = sizes.sparkSession
    rows = [(k, float(v)) for k, v in quota.items() if v > 0]
    wanted = spark.createDataFrame(rows or [("", 0.0)], "source string, quota double")
    docs = sizes.where(F.col("n_tokens") > 0).join(F.broadcast(wanted) if len(rows) <= 100_000 else wanted, "source")
    per_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("all"), F.count(F.lit(1)).alias("n"))
    per_source = materialize(per_source, "source-tokens")
    n = per_source.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, n // BLOCK_ROWS)
    per = per_source.select("source", "all")
    docs = docs.join(F.broadcast(per) if len(rows) <= 100_000 else per, "source")
    passes = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("all") - 1e-9).cast("int"))
    each = docs.withColumn("pass_no", F.explode(F.sequence(F.lit(1), passes)))
    # What is longer than all that the last pass may take would stop it at its place.
    rest = F.col("quota") - (F.col("pass_no") - 1) * F.col("all")
    each = each.where((rest >= F.col("all")) | (F.col("n_tokens") <= rest))
    # The order is a signed hash, its block the range it lies in.
    h = each.withColumn("h", F.xxhash64(F.lit(seed), "pass_no", "doc_id")).withColumn("block", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * blocks).cast("long"))
    group = ["source", "pass_no"]
    inside = Window.partitionBy(*group, "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = h.withColumn("upto", F.sum("n_tokens").over(inside))
    totals = h.groupBy(*group, "block").agg(F.sum("n_tokens").alias("t"))
    over = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    below = totals.withColumn("below", F.coalesce(F.sum("t").over(over), F.lit(0))).drop("t")
    start = (F.col("pass_no") - 1) * F.col("all") + F.col("below") + F.col("upto") - F.col("n_tokens")
    placed = run.join(below, [*group, "block"]).withColumn("token_start", start)
    middle = F.col("token_start") + F.col("n_tokens") / 2
    return placed.where(middle <= F.col("quota")).select("source", "doc_id", "n_tokens", "pass_no", "token_start", (middle / F.col("quota")).alias("mix_order"))


def source_sizes(sizes: DataFrame) -> dict[str, float]:
    """Tokens per source, one row a source."""
    rows = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    return {r["source"]: float(r["t"]) for r in rows}


def _planned(spark: SparkSession, sf_dir: str, tokenizer: str, budget: float | None):
    sizes = materialize(sized(table(spark, sf_dir, "documents"), tokenizer), "doc-tokens")
    named = table(spark, sf_dir, "mix_targets").select(clean_source("source").alias("source"), "target_share", "max_repeats")
    # A source named twice has its larger share and its stricter limit; without a limit it is taken once, with a limit of 0 not at all.
    rows = named.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats")).collect()
    targets = {r["source"]: float(r["target_share"]) for r in rows}
    repeats = {r["source"]: max(0, int(r["max_repeats"])) for r in rows}
    only = sizes.join(F.broadcast(spark.createDataFrame([(k,) for k in targets] or [("",)], "source string")), "source", "left_semi")
    have = source_sizes(only)
    return sizes, targets, repeats, have, plan(have, targets, repeats, budget)


def p9_mixture(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS, budget: float | None = None) -> DataFrame:
    """The mixture in its order: a row per document and repetition."""
    sizes, _, _, _, (_, budget, weights) = _planned(spark, sf_dir, tokenizer, budget)
    return permuted(sizes, {k: w * budget for k, w in weights.items()}).repartitionByRange("mix_order").sortWithinPartitions("mix_order", "source", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS, budget: float | None = None) -> DataFrame:
    """Shares reached per source: (source, source_tokens, target_share, reached_share, n_tokens, repeats, max_repeats)."""
    sizes, targets, repeats, have, (_, budget, weights) = _planned(spark, sf_dir, tokenizer, budget)
    mixed = permuted(sizes, {k: w * budget for k, w in weights.items()}).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("pass_no").alias("repeats"))
    wanted = spark.createDataFrame([(k, float(have.get(k, 0)), v, repeats[k]) for k, v in targets.items()] or [("", 0.0, 0.0, 0)], "source string, source_tokens double, target_share double, max_repeats int")
    joined = wanted.join(mixed, "source", "left").fillna(0, ["n_tokens", "repeats"])
    # One row per source is left here.
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("reached_share", F.round(F.col("n_tokens") / total, 6))


def p9_temperature(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS) -> DataFrame:
    """What one temperature for all gives: the exponent at which natural shares have the targets' entropy, the shares there, and beside them each source's own exponent."""
    _, targets, _, have, _ = _planned(spark, sf_dir, tokenizer, None)
    live = {k: v for k, v in have.items() if v > 0 and k in targets}
    if not live:
        return spark.createDataFrame([], "source string, exponent double, natural_share double, share double, own_exponent double")
    s = sum(targets[k] for k in live)
    x = exponent_for_entropy(live, entropy({k: targets[k] / s for k in live}))
    w, total = temperature_weights(live, x), sum(live.values())
    own = target_exponents(live, {k: targets[k] / s for k in live})
    return spark.createDataFrame([(k, round(x, 6), round(live[k] / total, 6), round(w[k], 6), round(own[k], 6)) for k in sorted(live)], "source string, exponent double, natural_share double, share double, own_exponent double")


def p9_check(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS) -> DataFrame:
    """Per source with a target: whether its tokens are its share of the mixture's budget but for half of its longest document, and its repetitions are kept."""
    sizes, targets, repeats, _, (_, budget, weights) = _planned(spark, sf_dir, tokenizer, None)
    mixed = permuted(sizes, {k: w * budget for k, w in weights.items()}).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("pass_no").alias("repeats"))
    wanted = spark.createDataFrame([(k, weights.get(k, 0.0) * budget, repeats[k]) for k in targets] or [("", 0.0, 0)], "source string, quota double, max_repeats int")
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    both = wanted.join(mixed, "source", "left").join(longest, "source", "left").fillna(0)
    return both.select("source", (F.abs(F.col("n_tokens") - F.col("quota")) <= F.col("longest") / 2).alias("share_reached"), (F.col("repeats") <= F.col("max_repeats")).alias("repeats_kept"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_temperature": p9_temperature, "p9_check": p9_check}
SQL = {"p9_check": "select distinct source, true as share_reached, true as repeats_kept from mix_targets where target_share > 0"}
