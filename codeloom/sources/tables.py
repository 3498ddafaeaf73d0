"""Tables by branch: replacing a branch, some of its paths, its reports (SNK1-SNK8, ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import materialize


class BranchTable:
    """A Parquet table partitioned by branch_id; writes replace whole partitions, so readers of other branches are not touched."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001 - the table does not exist yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def replace(self, rows: DataFrame, key: list[str] | None = None) -> None:
        """SNK1: replaces the partitions that ``rows`` has; repeated keys are written once."""
        rows = rows.dropDuplicates(key) if key else rows
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch_id").parquet(self.path)

    def merge(self, rows: DataFrame, branch_id: str, removed: DataFrame | None = None, key: str = "path") -> None:
        """SNK2, SNK5: replaces the branch's rows of the keys in ``rows`` and drops those of ``removed``."""
        gone = rows.select(key).distinct()
        if removed is not None:
            gone = gone.unionByName(removed.select(key)).distinct()
        kept = self.read().where(F.col("branch_id") == branch_id).join(gone, key, "left_anti")
        # What is read is also overwritten, so the new rows are written aside first.
        self.replace(materialize(kept.select(*rows.columns).unionByName(rows), "merge"))

    def size(self, branch_id: str) -> int:
        """SNK8."""
        return self.read().where(F.col("branch_id") == branch_id).count()

    def clear(self, branch_id: str) -> None:
        """SNK4: drops a branch's partition; a branch that is not there is no error."""
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(branch_id)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/branch_id={name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


REPORTS = "issues_report string, dependency_report string, hotspots_report string, health_score_report string, updated_at timestamp, branch_id string"


def upsert_report(reports: BranchTable, branch_id: str | None, **fields: str) -> None:
    """SNK6: sets some of a branch's reports and the time of it; the others stay. Without a branch nothing is written."""
    if not branch_id:
        return
    known = [f.name for f in reports.spark.createDataFrame([], REPORTS).schema][:4]
    if unknown := set(fields) - set(known):
        raise ValueError(f"no reports: {sorted(unknown)}")
    old = reports.read().where(F.col("branch_id") == branch_id)
    one = reports.spark.createDataFrame([(branch_id,)], "branch_id string").join(old, "branch_id", "left")
    for k, v in fields.items():
        one = one.withColumn(k, F.lit(v))
    reports.replace(materialize(one.withColumn("updated_at", F.current_timestamp()).select(*known, "updated_at", "branch_id"), "report"))


def resolve_branch(branches: DataFrame, repository_id: str, name: str | None = None) -> DataFrame:
    """SNK10: (branch_id) of a repository's branch by name, or without one of its default branch, else of the one indexed last. A name that is not there gives no row and is not added."""
    mine = branches.where(F.col("repository_id") == repository_id)
    if name is not None:
        mine = mine.where(F.col("name") == name)
    return mine.orderBy(F.desc(F.coalesce("is_default", F.lit(False))), F.desc_nulls_last("indexed_at"), "id").limit(1).select(F.col("id").alias("branch_id"))


def require_index(rows: DataFrame) -> DataFrame:
    """CP4: the rows, or an error where nothing is indexed."""
    if rows.isEmpty():
        raise LookupError("nothing is indexed")
    return rows
