"""Processing only new or changed records, by a Merkle tree over key ranges.

A snapshot is a table of keys and values, sorted by a 60-bit hash of the key. A node of level L is the range of keys that share
the first L hex digits of the hash; a leaf's digest is a hash of the order-free sum over its rows, and an inner node's digest the sum of its
children's. The tree of a snapshot is stored beside it, a folder a level. Two trees are compared from the root: of each level only the children of
nodes that differ are read, and of both snapshots only the key ranges of leaves that differ are compared row by row.

Failure safety: :class:`MerkleStore` writes snapshot, tree and output of a run into one new version folder and then moves a
pointer by an atomic rename. A run that dies before the rename leaves nothing that a later run reads, so no record is
skipped or processed twice. What is processed is derived from what was written, so a record that arrives meanwhile is left to the next run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import materialize, shared_dir

DIGITS = 15
#: Rows a leaf should hold; the depth follows from it and the number of rows.
LEAF_ROWS = 16
#: Levels that the descent takes at once: 256 children of a node that differs are compared.
STEP = 2
#: Hex digits by which files of a snapshot are skipped: at most 256 prefixes are asked for.
PREFIX = 2
#: Bytes up to which a list of nodes is sent to every executor.
BROADCAST_BYTES = 8_000_000
_NODE_BYTES = 48


def key_hash(*keys: Column) -> Column:
    """Fifteen hex digits that place a row in the key space; a null key is a key of its own."""
    return F.substring(F.sha1(F.concat_ws("\u0000", *[F.coalesce(k.cast("string"), F.lit("\u0001")) for k in keys])), 1, DIGITS)


def leaf_depth(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Hex digits that name a leaf, so that a leaf holds about ``leaf_rows`` rows."""
    depth = 1
    while depth < 8 and rows > leaf_rows * 16**depth:
        depth += 1
    return depth


def tree(snapshot: DataFrame, depth: int) -> DataFrame:
    """(level, node, digest, n_rows) of a snapshot (key_hash, row_digest), from the root, level 0, to the leaves.

    Digests are sums of 64-bit hashes in decimal arithmetic, so they depend neither on the order of rows nor on partitions, and partial sums
    combine before the shuffle. An empty snapshot has no nodes.
    """
    wide = lambda *c: F.xxhash64(*c).cast("decimal(38,0)")
    rows = snapshot.groupBy(F.substring("key_hash", 1, depth).alias("leaf")).agg(F.sum(wide("key_hash", "row_digest")).alias("d"), F.count(F.lit(1)).alias("n_rows"))
    leaves = rows.select("leaf", wide("leaf", F.col("d").cast("string")).alias("d"), "n_rows")
    each = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "leaf", "d", "n_rows")
    return each.groupBy("level", F.expr("substring(leaf, 1, level)").alias("node")).agg(F.sum("d").alias("digest"), F.sum("n_rows").alias("n_rows"))


def _few(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() * _NODE_BYTES <= BROADCAST_BYTES else nodes


def changed_leaves(now: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """(node) of the leaves that differ between two stored trees, found by descending only below nodes that differ.

    Nodes on one side only differ. The descent takes STEP levels at once. Each level's open nodes are written, so a level's plan reads that level's folder and nothing above.
    Equal trees give no rows after one comparison of the roots.
    """
    open_nodes: DataFrame | None = None
    above = 0
    for level in sorted({0, *range(depth, 0, -STEP)}):
        side = lambda t, c: t.where(F.col("level") == level).select("node", F.col("digest").alias(c))  # noqa: B023, E731
        a, b = side(now, "a"), side(saved, "b")
        if open_nodes is not None:
            up = _few(open_nodes.select(F.col("node").alias("up")))
            a, b = (x.join(up, F.expr(f"substring(node, 1, {above})") == F.col("up"), "left_semi") for x in (a, b))
        open_nodes = materialize(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "open-nodes")
        if open_nodes.isEmpty():
            break
        above = level
    return open_nodes


class _Stored:
    """A snapshot and its tree in a folder, as written by :func:`_store`."""

    def __init__(self, spark: SparkSession, at: str, depth: int):
        self.rows, self.nodes, self.depth = spark.read.parquet(f"{at}/snapshot"), spark.read.schema("node string, digest decimal(38,0), n_rows long, level int").parquet(f"{at}/tree"), depth

    def leaves(self, open_leaves: DataFrame) -> DataFrame:
        """The rows of some leaves. The snapshot's files are sorted by key_hash, so those of other prefixes are skipped by their statistics."""
        prefixes = [r["p"] for r in open_leaves.select(F.substring("node", 1, PREFIX).alias("p")).distinct().collect()]
        rows = self.rows
        if len(prefixes) < 16 ** min(PREFIX, self.depth):
            asked = F.lit(False)
            for p in prefixes:
                asked = asked | F.col("key_hash").startswith(p)
            rows = rows.where(asked)
        return rows.join(_few(open_leaves), F.substring("key_hash", 1, self.depth) == F.col("node"), "left_semi")


def _digest(value: str, side: str) -> Column:
    # A null value never equals anything, so it gets a digest of its own side.
    return F.coalesce(F.col(value).cast("string"), F.lit(f"\u0001{side}"))


def _store(rows: DataFrame, at: str, keys: list[str], value: str, side: str, depth: int | None = None) -> tuple[_Stored, int]:
    """Writes a snapshot, sorted by key hash and without repeated rows, and its tree; returns it with its number of rows."""
    spark = rows.sparkSession
    hashed = rows.withColumn("key_hash", key_hash(*[F.col(k) for k in keys])).withColumn("row_digest", _digest(value, side))
    # Rows are unique within the ranges, so they move once.
    unique = ["key_hash", *[f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and f.name != "key_hash"]]
    hashed.repartitionByRange("key_hash").dropDuplicates(unique).sortWithinPartitions("key_hash").write.parquet(f"{at}/snapshot")
    n = spark.read.parquet(f"{at}/snapshot").count()
    depth = depth or leaf_depth(n)
    tree(spark.read.parquet(f"{at}/snapshot").select("key_hash", "row_digest"), depth).write.partitionBy("level").parquet(f"{at}/tree")
    return _Stored(spark, at, depth), n


def _difference(now: _Stored, saved: _Stored, keys: list[str], value: str, kept: list[str]) -> DataFrame:
    """(kept, change) of the rows of ``now`` that are new or differ, from the leaves that differ."""
    leaves = changed_leaves(now.nodes, saved.nodes, now.depth)
    c = now.leaves(leaves)
    s = saved.leaves(leaves).select("key_hash", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__saved"), F.lit(True).alias("__known"))
    on = [c["key_hash"] == s["key_hash"], *[c[k].eqNullSafe(s[f"__k{i}"]) for i, k in enumerate(keys)]]
    joined = c.join(s, on, "left")
    same = F.col("__known").isNotNull() & F.coalesce(c[value] == F.col("__saved"), F.lit(False))
    return joined.where(~same).select(*[c[k] for k in kept], F.when(F.col("__known").isNull(), "added").otherwise("changed").alias("change"))


def changed_records(current: DataFrame, saved: DataFrame, keys: list[str], value: str, n_rows: int | None = None) -> DataFrame:
    """Rows of ``current`` that are new or differ from ``saved``.

    Both have the columns ``keys`` and ``value``; ``saved`` holds one row per key. Rows of
    ``current`` whose key is not in ``saved``, whose value differs, or where either value is null
    are returned with all of ``current``'s columns and ``change`` = 'added' or 'changed'.
    Rows only in ``saved`` are not returned. A null key is a key of its own. Empty ``current``
    gives no rows, empty ``saved`` returns all. Repeated rows of ``current`` come out once;
    columns ``change``, ``key_hash`` and ``row_digest`` that it already has are replaced or left out.

    ``n_rows``, if given, sets the depth of the trees instead of the number of rows saved. Both sides are stored with their trees first; where a side is stored already, as in :class:`MerkleStore`, it is not built again.
    """
    at = f"{shared_dir(current.sparkSession)}/merkle-{uuid.uuid4().hex}"
    rows = current.drop("change", "key_hash", "row_digest")
    old, _ = _store(saved.select(*keys, value), f"{at}/saved", keys, value, "saved", leaf_depth(n_rows) if n_rows else None)
    now, _ = _store(rows, f"{at}/now", keys, value, "now", old.depth)
    return _difference(now, old, keys, value, rows.columns)


class MerkleStore:
    """Versions of (snapshot, tree, output) in a folder, each published as a whole.

    ``CURRENT`` names the version that counts. ``run`` processes the records that changed since that version and publishes the next one;
    if anything fails before the pointer moves, the next run starts from the old version again. One run at a time may write.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict | None:
        """The published version: its name, number, depth of tree, and the versions whose output may still count."""
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT").first()[0])

    def version(self) -> str | None:
        s = self.state()
        return s["version"] if s else None

    def saved(self) -> DataFrame | None:
        """The published snapshot: keys, value, and ``run_no``, the run that processed the record."""
        s = self.state()
        return self.spark.read.parquet(f"{self.root}/{s['version']}/snapshot").drop("key_hash", "row_digest") if s else None

    def output(self) -> DataFrame | None:
        """The output that counts: of each record in the snapshot, what its last processing gave. Output of records changed since or gone is left out."""
        s = self.state()
        if s is None:
            return None
        per_run = None
        for no, v in s["runs"]:
            rows = self.spark.read.parquet(f"{self.root}/{v}/output").withColumn("run_no", F.lit(no))
            per_run = rows if per_run is None else per_run.unionByName(rows, allowMissingColumns=True)
        known = self.spark.read.parquet(f"{self.root}/{s['version']}/snapshot").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(s["keys"])], F.col("run_no").alias("__no")).distinct()
        on = [F.col("run_no") == F.col("__no"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(s["keys"])]]
        return per_run.join(known, on, "left_semi").drop("run_no")

    def gone(self) -> DataFrame | None:
        """Keys that the last run no longer found."""
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/{v}/gone") if v else None

    def run(self, current: DataFrame, keys: list[str], value: str, process: Callable[[DataFrame], DataFrame]) -> str:
        """Processes new and changed rows with ``process(DataFrame) -> DataFrame``, whose result must keep ``keys``; returns the version.

        ``current`` is first reduced to a written snapshot, and what changed is found from that. The rows to process are then read again and taken only
        where their value is still the snapshot's, and written; only they count as processed. So a record that arrives or
        changes meanwhile is neither skipped nor recorded with a value that was not processed.
        """
        before = self.state()
        no = (before["no"] if before else 0) + 1
        version = f"v-{uuid.uuid4().hex}"
        at, aside = f"{self.root}/{version}", f"{self.root}/{version}/scan"
        if before:
            old = _Stored(self.spark, f"{self.root}/{before['version']}", before["depth"])
        else:
            empty = current.select(*keys, value).limit(0).withColumn("run_no", F.lit(0))
            old, _ = _store(empty, f"{at}/none", keys, value, "saved")
        now, _ = _store(current.select(*keys, value), aside, keys, value, "now", old.depth)
        todo = materialize(_difference(now, old, keys, value, [*keys, value]), "todo")
        cols = current.columns
        wanted = todo.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, value])])
        still = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, value])]
        current.join(wanted, still, "left_semi").select(*cols).dropDuplicates([*keys, value]).write.parquet(f"{at}/input")
        taken = self.spark.read.schema(current.schema).parquet(f"{at}/input")
        process(taken).write.parquet(f"{at}/output")
        # Kept: what is still there as it was. Its run stays the one that processed it.
        o = old.rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "run_no")
        at_key = lambda left: [left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        t = todo.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        kept = now.rows.join(t, at_key(now.rows), "left_anti")
        kept = kept.join(o, at_key(kept), "left").select(*keys, value, "run_no")
        snapshot = kept.unionByName(taken.select(*keys, value).distinct().withColumn("run_no", F.lit(no)))
        final, n = _store(snapshot, f"{at}/next", keys, value, "saved")
        n_keys = now.rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        old.rows.join(n_keys, at_key(old.rows), "left_anti").select(*keys).write.parquet(f"{at}/gone")
        for part in ("snapshot", "tree"):
            self._fs.rename(self._path(f"{at}/next/{part}"), self._path(f"{at}/{part}"))
        for part in ("scan", "none", "next", "input"):
            self._fs.delete(self._path(f"{at}/{part}"), True)
        self._point({"version": version, "no": no, "depth": final.depth, "keys": keys, "n_rows": n, "runs": [*(before["runs"] if before else []), [no, version]]})
        return version

    def adopt(self, rows: DataFrame, keys: list[str], value: str) -> str:
        """Publishes a known state (keys, value), such as one that a log tells, as if a run had processed it, without output."""
        before = self.state()
        version = f"v-{uuid.uuid4().hex}"
        final, n = _store(rows.select(*keys, value).withColumn("run_no", F.lit(0)), f"{self.root}/{version}", keys, value, "saved")
        self._point({"version": version, "no": before["no"] if before else 0, "depth": final.depth, "keys": keys, "n_rows": n, "runs": before["runs"] if before else []})
        return version

    def pending(self, current: DataFrame, value: str) -> DataFrame:
        """Rows of ``current`` that the published version does not have or has with another value, with ``change``; nothing is published."""
        s = self.state()
        if s is None:
            return current.withColumn("change", F.lit("added"))
        rows = current.drop("change", "key_hash", "row_digest")
        old = _Stored(self.spark, f"{self.root}/{s['version']}", s["depth"])
        now, _ = _store(rows, f"{shared_dir(self.spark)}/merkle-{uuid.uuid4().hex}", s["keys"], value, "now", s["depth"])
        return _difference(now, old, s["keys"], value, rows.columns)

    def _point(self, state: dict) -> None:
        tmp, to = self._path(f"{self.root}/.CURRENT-{state['version']}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(options, 1)
        flags[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        context.rename(tmp, to, flags)
