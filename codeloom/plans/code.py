"""Queries on code: symbols, call graph, import graph, Docker."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.text import is_entrypoint
from codeloom.operators import graph, impact
from codeloom.session import materialize, table
from codeloom.sources import code, docker, lexical


def _symbols(spark, d):
    return materialize(code.symbols(table(spark, d, "files")), "symbols")


def python_definitions(spark, d):
    return code.definitions(_symbols(spark, d))


def python_calls(spark, d):
    """The call graph's edges, resolved or not."""
    return code.call_edges(_symbols(spark, d))


def python_local_calls(spark, d):
    """Each Python function's callees in order."""
    return code.local_calls(materialize(code.symbols(table(spark, d, "files"), local=True), "symbols"))


def dead_code(spark, d):
    """GR13: Python functions and classes that are no entry points and that nothing calls."""
    rows = _symbols(spark, d)
    defs = code.definitions(rows).withColumn("dst", F.concat("path", F.lit("::"), "name"))
    calls = code.call_edges(rows).where("dst is not null").select("branch_id", "dst").distinct()
    return defs.where(~is_entrypoint(F.col("name"), F.col("decorators"))).join(calls, ["branch_id", "dst"], "left_anti").select("branch_id", "path", "name", "type", "line")


def function_references(spark, d):
    """Call sites of ``len``."""
    return code.references(_symbols(spark, d), "len", table(spark, d, "files"))


def import_edges(spark, d):
    """GR4: edges between files of a branch, Python and JavaScript."""
    files = table(spark, d, "files")
    return code.python_import_edges(_symbols(spark, d), files).unionByName(code.js_import_edges(files))


def js_import_edges(spark, d):
    return code.js_import_edges(table(spark, d, "files"))


def layer_violations(spark, d):
    return graph.layer_violations(import_edges(spark, d)).select("branch_id", "src", "dst", "kind")


def code_items(spark, d):
    """Functions, classes and imports of files in any known language, per branch."""
    rows = lexical.items(table(spark, d, "files"))
    return rows.groupBy("branch_id", "kind").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.length("code")).alias("n_chars"))


def _calls(spark, d):
    rows = _symbols(spark, d)
    key = lambda c: F.concat("branch_id", F.lit(":"), c)
    calls = materialize(code.call_edges(rows).select(key("src").alias("src"), key("dst").alias("dst")), "calls")
    defs = code.definitions(rows).select(F.concat("branch_id", F.lit(":"), "path", F.lit("::"), "name").alias("node"), "line", "decorators")
    return rows, calls, defs


def call_impact(spark, d):
    """What changing the most called symbol of all branches reaches."""
    rows, calls, defs = _calls(spark, d)
    top = calls.where("dst is not null").groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).collect()
    files = code.python_import_edges(rows, table(spark, d, "files")).select(F.concat("branch_id", F.lit(":"), "src").alias("src"), F.concat("branch_id", F.lit(":"), "dst").alias("dst"))
    return impact.change_impact(calls, files, defs, top[0]["dst"] if top else "")["summary"]


def symbol_relations(spark, d):
    """What each Python symbol calls and is called by."""
    return impact.relations(_calls(spark, d)[1])


def docker_instructions(spark, d):
    return docker.instructions(table(spark, d, "files"))


def docker_stages(spark, d):
    return docker.stages(materialize(docker_instructions(spark, d), "docker")).drop("no")


def docker_images(spark, d):
    return docker.images(materialize(docker_instructions(spark, d), "docker"))


def compose_services(spark, d):
    """Services of the files' Compose files."""
    return docker.services(table(spark, d, "files"))


QUERIES = {f.__name__: f for f in (python_definitions, python_calls, python_local_calls, dead_code, function_references, import_edges, js_import_edges, layer_violations, code_items, call_impact, symbol_relations, docker_instructions, docker_stages, docker_images, compose_services)}
SQL: dict[str, str] = {}
