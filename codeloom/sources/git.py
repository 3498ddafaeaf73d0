"""Version history of a local checkout as tables (SRC14-SRC17), through the git command line."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

LOG = "sha string, author string, committed timestamp, message string, path string"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, errors="replace").stdout


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("repo", path).load()``: a row per commit and path, newest commits first."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _GitLogReader(self.options["repo"], self.options.get("since"))


class _GitLogReader(DataSourceReader):
    def __init__(self, repo: str, since: str | None):
        self.repo, self.since = repo, since

    def read(self, partition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        args = ["log", "--name-only", "--pretty=format:%x01%H%x02%an%x02%ct%x02%s"] + ([f"--since={self.since}"] if self.since else [])
        for block in _git(self.repo, *args).split("\x01")[1:]:
            head, _, rest = block.partition("\n")
            sha, author, ts, message = head.split("\x02")
            for path in filter(None, rest.split("\n")):
                yield sha, author, datetime.fromtimestamp(int(ts), timezone.utc), message, path


def git_log(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    r = spark.read.format("gitlog").option("repo", repo)
    return (r.option("since", since) if since else r).load()


def git_changes(repo: str, old: str, new: str) -> tuple[set[str], set[str]]:
    """SRC16: (changed, deleted) paths between two commits; a rename deletes the old path and changes the new one."""
    changed, deleted = set(), set()
    for line in _git(repo, "diff", "--name-status", "-M", old, new).splitlines():
        status, *paths = line.split("\t")
        if status.startswith("R"):
            deleted.add(paths[0])
            changed.add(paths[-1])
        elif status == "D":
            deleted.add(paths[0])
        else:
            changed.add(paths[-1])
    return changed, deleted


def git_branches(repo: str) -> list[str]:
    """SRC17: local branches and those of origin, without its HEAD."""
    local = _git(repo, "for-each-ref", "--format=%(refname:short)", "refs/heads").split()
    remote = _git(repo, "for-each-ref", "--format=%(refname)", "refs/remotes/origin").split()
    names = {r.removeprefix("refs/remotes/origin/") for r in remote}
    return sorted(set(local) | (names - {"HEAD"}))
