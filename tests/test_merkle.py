"""Merkle change detection against brute force, and a store that survives failures."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators.merkle import MerkleStore, changed_records, leaf_depth

SCHEMA = "a string, b string, v string"


def brute(cur, old):
    known = {(a, b): v for a, b, v in old}
    return sorted({(a or "", b or "", v or "") for a, b, v in cur if (a, b) not in known or v is None or known[a, b] is None or known[a, b] != v})


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [(f"k{rng.randrange(40)}", rng.choice(["x", "y", None])) for _ in range(300)]
    cur = list({k: (*k, rng.choice(["1", "2", None])) for k in keys}.values())
    old = list({k: (*k, rng.choice(["1", "2", None])) for k in keys[:200] + [("gone", "x")]}.values())
    got = changed_records(spark.createDataFrame(cur + cur[:20], SCHEMA), spark.createDataFrame(old, SCHEMA), ["a", "b"], "v", n_rows=5000)
    assert sorted((r.a or "", r.b or "", r.v or "") for r in got.collect()) == brute(cur, old)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", "b", "1")], SCHEMA).withColumn("change", F.lit("old")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert changed_records(none, none, ["a", "b"], "v").count() == 0
    assert [r.change for r in changed_records(one, none, ["a", "b"], "v").collect()] == ["added"]
    assert changed_records(one, one.select("a", "b", "v"), ["a", "b"], "v").count() == 0


def test_depth():
    assert leaf_depth(10) == 1 and leaf_depth(10**6) > 2


def test_store_publishes_output_and_tree_together(spark, tmp_path):
    store = MerkleStore(spark, f"file://{tmp_path}/store")
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store.run(df([("a", "1", "x"), ("b", "1", "y")]), ["a", "b"], "v", lambda t: t)
    assert store.output().count() == 2
    now = df([("a", "1", "x"), ("b", "1", "z"), ("c", "1", "w")])

    def fails(todo):
        todo.count()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(now, ["a", "b"], "v", fails)
    # The failed run left nothing: the next one has the same work.
    work = []

    def keeps(todo):
        work.append(sorted(r.a for r in todo.collect()))
        return todo

    store.run(now, ["a", "b"], "v", keeps)
    assert sorted((r.a, r.v) for r in store.output().collect()) == [("a", "x"), ("b", "z"), ("c", "w")]
    store.run(df([("a", "1", "x"), ("c", "1", "w")]), ["a", "b"], "v", keeps)
    # What was processed earlier still counts, what is gone does not.
    assert sorted((r.a, r.v) for r in store.output().collect()) == [("a", "x"), ("c", "w")]
    assert [r.a for r in store.gone().collect()] == ["b"]
    assert work == [["b", "c"], []]


def test_records_that_arrive_during_a_run_are_left_to_the_next(spark, tmp_path):
    """The source grows and changes between the scan and the processing: nothing is skipped, nothing stale is recorded."""
    at = f"file://{tmp_path}/source"
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    df([("a", "1", "x"), ("b", "1", "y"), ("n", "1", None)]).write.parquet(at)
    store = MerkleStore(spark, f"file://{tmp_path}/store")
    seen = []

    def arrives(todo):
        seen.append(sorted((r.a, r.v) for r in todo.collect()))
        df([("late", "1", "z")]).write.mode("append").parquet(at)
        return todo

    read = lambda: spark.read.schema(SCHEMA).parquet(at)
    store.run(read(), ["a", "b"], "v", arrives)
    store.run(read(), ["a", "b"], "v", lambda t: seen.append(sorted((r.a, r.v) for r in t.collect())) or t)
    # A null value never equals anything, so that record is processed again.
    assert seen[0] == [("a", "x"), ("b", "y"), ("n", None)] and seen[1] == [("late", "z"), ("n", None)]
    assert sorted(r.a for r in store.output().collect()) == ["a", "b", "late", "n"]


def test_only_changed_ranges_are_read(spark, tmp_path):
    """One changed record of 20,000: the leaves read hold a small share of the rows, and the plan stays small."""
    rows = [(f"k{i}", "", "1") for i in range(20_000)]
    store = MerkleStore(spark, f"file://{tmp_path}/store")
    store.adopt(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "v")
    got = store.pending(spark.createDataFrame([(a, b, "2" if a == "k77" else v) for a, b, v in rows], SCHEMA), "v")
    assert [(r.a, r.change) for r in got.collect()] == [("k77", "changed")]
    plan = got._jdf.queryExecution().toString()
    assert plan.count("Exchange") < 20 and "StringStartsWith" in plan
