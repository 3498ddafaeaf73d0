"""Change history, snapshots, manifests, scores (SRC14-17, TK8, AG14-AG19, DEP1-DEP6, SC1-SC3, ST4, SNK2)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import base_name, clean_npm_version, clean_pyproject_version


def churn(changes: DataFrame, keys: list[str], time: str, days: int = DEFAULT.churn_days) -> DataFrame:
    """AG7: (keys, churn): changes within ``days`` of the newest one."""
    newest = changes.agg(F.max(time).alias("newest")).first()["newest"]
    # As a literal the bound reaches the reader, which skips older row groups.
    recent = changes.where(F.col(time) >= F.lit(newest - timedelta(days=days)).cast(changes.schema[time].dataType)) if newest is not None else changes.limit(0)
    return recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("churn"))


def hotspots(churned: DataFrame, current: DataFrame, keys: list[str], top: int = DEFAULT.churn_top) -> DataFrame:
    """TK8: the most changed of the paths that still exist."""
    return churned.join(current.select(*keys).distinct(), keys, "left_semi").orderBy(F.desc("churn"), *keys).limit(top)


def history_of(changes: DataFrame, keys: list[str], order: list, top: int = DEFAULT.history_commits) -> DataFrame:
    """SRC14: the newest ``top`` changes of each key."""
    return changes.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= top)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """ST4, JN10: (key, change) of keys added, deleted or changed; a null digest always counts as changed."""
    a, b = old.select(key, F.col(digest).alias("a"), F.lit(1).alias("o")), new.select(key, F.col(digest).alias("b"), F.lit(1).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.coalesce(F.col("a") != F.col("b"), F.lit(True)), "changed")
    return a.join(b, key, "full").withColumn("change", kind).where("change is not null").select(key, "change")


def merge_changes(old: DataFrame, new: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """SNK2: the stored rows after a diff: unchanged ones stay, changed and added ones come from ``new``."""
    kept = old.join(diff.select(key), key, "left_anti")
    return kept.unionByName(new.join(diff.where("change <> 'deleted'").select(key), key, "left_semi"))


def build_mode(previous_sha: str | None, n_rows: int, n_unhashed: int) -> str:
    """ST4: a full build where there is nothing sound to compare with."""
    return "full" if not previous_sha or not n_rows or n_unhashed else "incremental"


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """AG18: the first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def requirements(manifests: DataFrame) -> DataFrame:
    """DEP1: (path, name, version, ecosystem, ord) of requirements.txt files (path, content)."""
    lines = manifests.where(base_name(F.col("path")) == "requirements.txt").select("path", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line"))
    t = F.regexp_replace(F.split("line", ";")[0], r"^\s+|\s+$", "")
    # Fixed value: the form of a requirement.
    pattern = r"^\s*([A-Za-z0-9_.\-]+)\s*(==|>=|<=|~=|>|<)?\s*([A-Za-z0-9_.\-]*)"
    rows = lines.withColumn("t", t).where("t <> '' and not startswith(t, '#') and not startswith(t, '-')")
    name = F.regexp_extract("t", pattern, 1)
    return rows.where(name != "").select("path", name.alias("name"), F.nullif(F.regexp_extract("t", pattern, 3), F.lit("")).alias("version"), F.lit("PyPI").alias("ecosystem"), "ord")


def package_json(manifests: DataFrame) -> DataFrame:
    """DEP2: dependencies, then development ones; broken JSON gives none."""
    parsed = manifests.where(base_name(F.col("path")) == "package.json").select("path", F.from_json("content", "struct<dependencies: map<string, string>, devDependencies: map<string, string>>").alias("j"))
    one = lambda c, k: parsed.select("path", F.posexplode(F.map_entries(f"j.{c}")).alias("p", "e")).select("path", F.col("e.key").alias("name"), clean_npm_version(F.col("e.value")).alias("version"), F.lit("npm").alias("ecosystem"), (F.col("p") + k).alias("ord"))
    return one("dependencies", 0).unionByName(one("devDependencies", 100_000))


# Keys of a pyproject file that are no dependencies.
PYPROJECT_KEYS = ("python", "name", "version", "description", "readme", "license", "authors")


def pyproject(manifests: DataFrame) -> DataFrame:
    """DEP3: every line ``key = "string"`` but for the ignored keys."""
    lines = manifests.where(base_name(F.col("path")) == "pyproject.toml").select("path", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line"))
    # Fixed value: the form of a dependency's line.
    pattern = r"""^\s*([A-Za-z0-9_.\-]+)\s*=\s*["']([^"']+)["']"""
    name = F.regexp_extract("line", pattern, 1)
    rows = lines.where((name != "") & ~F.lower(name).isin(*PYPROJECT_KEYS))
    return rows.select("path", name.alias("name"), clean_pyproject_version(F.regexp_extract("line", pattern, 2)).alias("version"), F.lit("PyPI").alias("ecosystem"), "ord")


def dependencies(manifests: DataFrame) -> DataFrame:
    """DEP4: unique dependencies of all manifests, the first of each name and ecosystem."""
    rows = requirements(manifests).unionByName(package_json(manifests)).unionByName(pyproject(manifests))
    return first_per(rows, [F.lower("name"), "ecosystem"], ["path", "ord"]).select("name", "version", "ecosystem", "path")


def with_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """JN7, DEP6: each dependency with the sorted ids of its advisories."""
    a = advisories.groupBy("name", "version").agg(F.sort_array(F.collect_set("vuln_id")).alias("ids"))
    return deps.join(a, ["name", "version"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


# Points that a finding of each severity costs, and the weights of the scores.
SEVERITY_POINTS = {"critical": 20.0, "high": 10.0, "medium": 4.0, "low": 1.0, "info": 0.25}
SCORE_WEIGHTS = {"security": 0.25, "maintainability": 0.20, "architecture": 0.25, "dependencies": 0.15, "change_risk": 0.15}


def symbol_index(symbols: DataFrame, order: str) -> DataFrame:
    """AG19: the last path of each name."""
    return symbols.groupBy("name").agg(F.max_by("path", order).alias("path"), F.count(F.lit(1)).alias("n"))
