"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.tokens import RANKS, sized
from codeloom.session import materialize, table

#: Items that one task packs together.
SHARD_ITEMS = 20_000
#: Kinds of containers there may be; more are an error.
KINDS = 1000


class _Stock:
    """Unpacked items by size, with the sizes in order."""

    def __init__(self, sizes: list[int]):
        self.by: dict[int, list[int]] = {}
        for i in sorted(range(len(sizes)), reverse=True):
            self.by.setdefault(sizes[i], []).append(i)
        self.sizes = sorted(self.by)

    def largest(self, gap: int) -> int | None:
        k = bisect_right(self.sizes, gap) - 1
        return self.sizes[k] if k >= 0 else None

    def take(self, size: int) -> int:
        left = self.by[size]
        i = left.pop()
        if not left:
            del self.by[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return i

    def put(self, size: int, i: int) -> None:
        if size not in self.by:
            self.by[size] = []
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.by[size].append(i)

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """The two sizes with the largest sum up to ``gap``, by two pointers."""
        best, pair = 0, None
        lo, hi = 0, bisect_right(self.sizes, gap) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > gap:
                hi -= 1
                continue
            if lo == hi and len(self.by[a]) < 2:
                break
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
            lo += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, by best-two-fit.

    A bin is filled greedily with the largest items that fit. If a gap is left, the bin's smallest item is replaced by the two unpacked
    items that fill the gap so widened most tightly, if they fill it better. Sizes must be from 1 to ``capacity``; ties go to the earlier item.
    """
    stock, bins, bin_no = _Stock(sizes), [-1] * len(sizes), 0
    while stock.sizes:
        gap, inside = capacity, []
        while (s := stock.largest(gap)) is not None:
            inside.append((s, stock.take(s)))
            gap -= s
        if gap and len(inside) > 1:
            small, i = inside[-1]
            pair = stock.best_two(gap + small)
            if pair and sum(pair) > small:
                inside.pop()
                inside += [(s, stock.take(s)) for s in pair]
                stock.put(small, i)
        for _, i in inside:
            bins[i] = bin_no
        bin_no += 1
    return bins


PACKED = "container string, bin_id string, doc_id long, piece_no int, token_start long, token_end long, n_tokens long, capacity long"


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
    bins = best_two_fit(pdf.n_tokens.tolist(), int(pdf.capacity.iloc[0]))
    shard = int(pdf.shard.iloc[0])
    pdf["bin_id"] = [f"{shard}-{b}" for b in bins]
    return pdf[[c.split()[0] for c in PACKED.split(", ")]]


def pack(items: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every item of (doc_id, n_tokens) in containers of every kind of (container, capacity_tokens): schema PACKED.

    An item above the capacity is cut into pieces of exactly the capacity and a rest; no other is. Items without tokens
    take no space and have no row; kinds with a null or non-positive capacity are left out. Items are spread over shards of about ``shard_items`` by a hash, whatever their source, and each is
    packed by one task, which wastes at most about one bin a shard; so no group grows with the data. Repeated (doc_id) must be dropped before.
    """
    items = items.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens")
    rows = containers.where(F.col("capacity_tokens") > 0).select("container", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    kinds = F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).alias("capacity")) for r in rows])
    if not rows:
        return items.sparkSession.createDataFrame([], PACKED)
    pieces = (
        items.select("doc_id", "n_tokens", F.explode(kinds).alias("kind"))
        .select("kind.*", "doc_id", "n_tokens")
        .select("container", "capacity", "doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")))).alias("piece", "k"))
        .select(
            "container",
            "doc_id",
            (F.col("piece") + 1).alias("piece_no"),
            (F.col("k") * F.col("capacity")).alias("token_start"),
            F.least("n_tokens", (F.col("k") + 1) * F.col("capacity")).alias("token_end"),
            "capacity",
        )
        .withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    )
    # A piece that fills its container needs no packing.
    full = pieces.where(F.col("n_tokens") == F.col("capacity")).withColumn("bin_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no"))
    shards = max(1, -(-items.count() // shard_items))
    rest = pieces.where(F.col("n_tokens") < F.col("capacity")).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    cols = [c.split()[0] for c in PACKED.split(", ")]
    packed = rest.groupBy("container", "shard").applyInPandas(_pack_shard, PACKED)
    return packed.unionByName(full.select(*cols))


def p8_bins(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS) -> DataFrame:
    sizes = materialize(sized(table(spark, sf_dir, "documents"), tokenizer), "doc-tokens")
    return pack(sizes, table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: bins, tokens, and the share of space filled."""
    per_bin = p8_bins(spark, sf_dir).groupBy("container", "capacity", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return per_bin.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("filled")
    )


def p8_check(spark: SparkSession, sf_dir: str, tokenizer: str = RANKS) -> DataFrame:
    """Per kind of container: documents packed, bins over capacity, documents whose pieces do not add up, documents split without need, and whether a tenth more bins than ceil(tokens / capacity) suffice."""
    sizes = materialize(sized(table(spark, sf_dir, "documents"), tokenizer), "doc-tokens")
    packed = materialize(pack(sizes, table(spark, sf_dir, "pack_sizes")), "packed")
    bins = packed.groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("capacity"))
    full = bins.groupBy("container").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("over"), (F.count(F.lit(1)) <= 1.1 * F.ceil(F.sum("used") / F.max("capacity")) + 1).alias("tight"))
    docs = packed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("capacity").alias("capacity")).join(sizes.select("doc_id", "n_tokens"), "doc_id")
    per = docs.groupBy("container").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("t") != F.col("n_tokens")).cast("long")).alias("wrong"), F.sum(((F.col("n") > 1) & (F.col("n_tokens") <= F.col("capacity"))).cast("long")).alias("cut"))
    return per.join(full, "container")


QUERIES = {"p8_bins": p8_bins, "p8_fill": p8_fill, "p8_check": p8_check}
SQL = {
    "p8_check": """select container, count(distinct doc_id) as n_docs, 0 as wrong, 0 as cut, 0 as over, true as tight
    from pack_sizes cross join documents where capacity_tokens > 0 and doc_id is not null and text <> '' group by 1""",
}
