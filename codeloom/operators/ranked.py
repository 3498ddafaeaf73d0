"""Ranks, joins and prefix sums within groups of any size.

A window over a group runs in one task, so a group with a third of all rows would stop the
job. Here equal values are counted first, so that ties are one row, and a group's distinct values are cut at sampled quantiles of theirs: ranks are taken
within the parts, and the sizes of the lower parts, a short list per group, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that the distinct values of a group are cut into.
PARTS = 200
#: Rows from which a join key is hot, and tasks that its rows are spread over.
HOT_KEY, SALTS = 100_000, 64


def salted_join(left: DataFrame, right: DataFrame, on: list[str], n: str, spread: Column, hot_rows: int = HOT_KEY, salts: int = SALTS) -> DataFrame:
    """Inner equi-join with a side that has one row per key and, in column ``n``, the number of rows of that key on the left.

    Keys of more than ``hot_rows`` rows, of which there are at most one per ``hot_rows`` rows, are spread by ``spread`` over ``salts`` tasks, for
    which their right row is repeated; others are joined as usual. Null keys match nothing.
    """
    hot = right.where(F.col(n) > hot_rows).select(*on)
    n_hot = hot.count()
    if not n_hot:
        return left.join(right, on)
    marked = hot.withColumn("__hot", F.lit(True))
    l = left.join(F.broadcast(marked) if n_hot <= 50_000 else marked, on, "left")  # noqa: E741
    l = l.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.when(F.col(n) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return l.join(r, [*on, "__salt"]).drop("__salt")


def grouped_rank(df: DataFrame, keys: list[str], value: str, rank: str = "rank", total: str = "total", spread: Column | None = None, parts: int = PARTS, hot_rows: int = HOT_KEY) -> DataFrame:
    """Adds ``rank``, the 1-based rank of ``value`` ascending with ties sharing the lowest, and ``total``.

    ``value`` must be a double that is not null. Each task ranks one part of a group's distinct values, whatever their distribution; rows of one
    value get their rank by a join in which frequent values are spread by ``spread`` (by default all columns).
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    at = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(50 * parts))
    bounds = counted.groupBy(*keys).agg(at.alias("__at"))
    b = counted.join(bounds, keys).withColumn("__b", F.size(F.filter("__at", lambda x: x < F.col(value)))).drop("__at")
    inner = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = b.withColumn("__r", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    w = Window.partitionBy(*keys)
    sizes = b.groupBy(*keys, "__b").agg(F.sum("__n").alias("__s"))
    below = sizes.withColumn("__below", F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum("__s").over(w)).drop("__s")
    ranks = inside.join(below, [*keys, "__b"]).select(*keys, value, "__n", (F.col("__r") + F.col("__below") + 1).alias(rank), total)
    return salted_join(df, ranks, [*keys, value], "__n", spread if spread is not None else F.struct(*df.columns), hot_rows).drop("__n")


def lead_in_order(df: DataFrame, order: str, value: str, name: str, bucket: int = 100_000) -> DataFrame:
    """Adds ``name``, the value of the next row in the order of a distinct integer column, null in the last row.

    A window over everything would run in one task. Rows are led within ranges of ``bucket`` integers, and the last row of a range takes
    the first value of the next one from a table with one row a range.
    """
    b = df.withColumn("__b", F.floor(F.col(order) / bucket))
    w = Window.partitionBy("__b").orderBy(order)
    firsts = b.groupBy("__b").agg(F.min_by(value, order).alias("__first"), F.min(order).alias("__o"))
    following = firsts.select("__b", F.lead("__first").over(Window.orderBy("__b")).alias("__next"))
    led = b.withColumn("__l", F.lead(F.struct(F.col(value).alias("v"))).over(w)).join(following, "__b", "left")
    return led.withColumn(name, F.when(F.col("__l").isNotNull(), F.col("__l.v")).otherwise(F.col("__next"))).drop("__b", "__l", "__next")
