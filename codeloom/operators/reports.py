"""Reports over stored analyses: call graph, file graph, architecture, dead code, issues, dependencies, health (GR3-GR8, AG4-AG9, TK9-TK12, IX2, DEP6, SC1-SC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import bounded, dotted_module, in_folder, is_entrypoint, language, normal_path
from codeloom.operators import graph, history, issues

# Message and remedy of each rule.
EXPLAINED = (
    ("hardcoded-aws-key", "Hardcoded AWS access key ID.", "Revoke this key in the AWS IAM console immediately, then load credentials from environment variables or a secrets manager (e.g. AWS Secrets Manager)."),
    ("hardcoded-private-key", "Private key committed to the repository.", "Remove the key from version control and git history, rotate/reissue it, and load it from a secure secret store or mounted volume instead."),
    ("hardcoded-github-token", "Hardcoded GitHub token.", "Revoke the token in GitHub Settings → Developer settings, then load it from an environment variable or CI secret."),
    ("hardcoded-slack-token", "Hardcoded Slack token.", "Revoke the token in your Slack app settings and load it from an environment variable instead."),
    ("hardcoded-secret-assignment", "Possible hardcoded credential or secret.", "Move this value out of source control into an environment variable (.env, untracked) or a secrets manager, then rotate the exposed value."),
    ("eval-usage", "Use of eval() can execute arbitrary code.", "Replace eval() with a safe parser (e.g. json.loads for data) or an explicit allow-list of operations."),
    ("exec-usage", "Use of exec() can execute arbitrary code.", "Avoid exec() on dynamic/user-controlled input; refactor to explicit function dispatch instead."),
    ("shell-true", "subprocess call with shell=True risks shell injection.", "Pass the command as a list (subprocess.run([...])) and drop shell=True; if a shell is unavoidable, sanitize input with shlex.quote()."),
    ("os-system", "os.system() is prone to shell injection; prefer subprocess with an argument list.", "Replace with subprocess.run([...]) using an argument list, which avoids shell interpretation entirely."),
    ("pickle-load", "Deserializing with pickle can execute arbitrary code from untrusted input.", "Only unpickle data you fully trust, or switch to a safe serialization format like JSON."),
    ("yaml-unsafe-load", "yaml.load without SafeLoader can execute arbitrary code.", "Use yaml.safe_load(...) or pass Loader=yaml.SafeLoader explicitly."),
    ("disabled-tls-verify-py", "TLS certificate verification disabled.", "Re-enable verification (verify=True) and fix the underlying certificate/trust issue instead of bypassing it."),
    ("disabled-tls-verify-js", "TLS certificate verification disabled.", "Remove the override and fix the certificate chain (e.g. via NODE_EXTRA_CA_CERTS) instead of disabling verification."),
    ("wildcard-cors", "Wildcard CORS origin allows any site to call this API.", "Restrict Access-Control-Allow-Origin to an explicit allow-list of trusted origins."),
    ("dangerously-set-innerhtml", "Assigning raw HTML can introduce XSS if the value includes user input.", "Sanitize the HTML first (e.g. with DOMPurify) or avoid raw HTML injection in favor of text content / safe templating."),
    ("sql-string-building", "Possible SQL built via string concatenation/f-string; use parameterized queries.", "Use parameterized queries or an ORM (e.g. cursor.execute(query, params)) instead of concatenating user input into SQL."),
    ("debug-true", "Debug mode enabled; should be off in production.", "Load this flag from an environment variable and default it to False in production."),
    ("todo-comment", "Unresolved TODO/FIXME left in code.", "Resolve it now or file a tracked issue and reference it in the comment."),
    ("console-log", "Leftover console.log/debug statement.", "Remove the statement or gate it behind a debug flag / proper logger."),
    ("debugger-statement", "Leftover debugger statement.", "Remove the debugger statement before committing."),
    ("large-file", "Large file — consider splitting it up for readability.", "Split this file into smaller, single-responsibility modules to make it easier to review and test."),
)


def once(files: DataFrame) -> DataFrame:
    """Files with an analysis, each id once."""
    return files.where(F.col("analysis").isNotNull()).dropDuplicates(["id"])


def symbols(files: DataFrame) -> DataFrame:
    """(branch_id, path, name, type, line, end_line, code) of the functions and classes in stored analyses; null names are left out."""
    f = files.select("branch_id", "path", "analysis")
    fn = f.select("branch_id", "path", F.explode("analysis.functions").alias("x")).select("branch_id", "path", F.col("x.name").alias("name"), F.lit("function").alias("type"), F.col("x.start_line").alias("line"), F.col("x.end_line").alias("end_line"), F.col("x.code").alias("code"))
    cl = f.select("branch_id", "path", "analysis.class_locations", F.explode("analysis.classes").alias("name"))
    at = lambda k: F.col("class_locations")[F.col("name")][k]
    cl = cl.select("branch_id", "path", "name", F.lit("class").alias("type"), at("start_line").alias("line"), at("end_line").alias("end_line"), F.lit(None).cast("string").alias("code"))
    return fn.unionByName(cl).where(F.col("name").isNotNull())


def stored_calls(files: DataFrame) -> DataFrame:
    """GR5-GR6: (branch_id, src, dst) between symbol keys ``path::name``, from the graphs in stored analyses; dst is null where nothing of that name is defined.

    A name resolves in its own file first, else to the first path of the branch that defines it: two equi-joins.
    """
    g = files.select("branch_id", "path", F.explode("analysis.graph").alias("caller", "callees"))
    calls = g.select("branch_id", "path", "caller", F.explode("callees").alias("name")).distinct()
    defs = symbols(files).select("branch_id", "path", "name").distinct()
    own = defs.withColumn("here", F.lit(True))
    first = defs.groupBy("branch_id", "name").agg(F.min("path").alias("first"))
    c = calls.join(own, ["branch_id", "path", "name"], "left").join(first, ["branch_id", "name"], "left")
    dst = F.when(F.col("here"), F.concat("path", F.lit("::"), "name")).otherwise(F.concat("first", F.lit("::"), "name"))
    return c.select("branch_id", F.concat("path", F.lit("::"), "caller").alias("src"), dst.alias("dst")).distinct()


def call_nodes(files: DataFrame, calls: DataFrame) -> DataFrame:
    """GR5: (branch_id, node, n_calls, n_called_by) of every defined symbol."""
    nodes = symbols(files).select("branch_id", F.concat("path", F.lit("::"), "name").alias("node")).distinct()
    out = calls.groupBy("branch_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_calls"))
    back = calls.where("dst is not null").groupBy("branch_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_called_by"))
    return nodes.join(out, ["branch_id", "node"], "left").join(back, ["branch_id", "node"], "left").fillna(0, ["n_calls", "n_called_by"])


def calls_of(calls: DataFrame, name: str) -> DataFrame:
    """TK10: what the function of a name calls; the first key that ends in it counts, per branch."""
    met = calls.where(F.col("src").endswith(f"::{name}"))
    first = met.groupBy("branch_id").agg(F.min("src").alias("src"))
    return met.join(first, ["branch_id", "src"], "left_semi").select("branch_id", "src", "dst")


def dead_symbols(files: DataFrame, calls: DataFrame) -> DataFrame:
    """GR13, TK9: (branch_id, path, name, type, line) of Python symbols that are no entry points and that nothing calls, in order of path and line."""
    defs = symbols(files).where(F.col("path").endswith(".py")).groupBy("branch_id", "path", "name").agg(F.max(F.struct("type", "line")).alias("d"))
    defs = defs.where(~is_entrypoint(F.col("name"), F.array().cast("array<string>"))).withColumn("dst", F.concat("path", F.lit("::"), "name"))
    called = calls.where("dst is not null").select("branch_id", "dst").distinct()
    return defs.join(called, ["branch_id", "dst"], "left_anti").select("branch_id", "path", "name", "d.type", "d.line").orderBy("branch_id", "path", "line", "name")


def dead_code_report(files: DataFrame, dead: DataFrame) -> DataFrame:
    """AG8: (branch_id, total_dead, python_files) of every branch."""
    per = files.groupBy("branch_id").agg(F.count_distinct(F.when(F.col("path").endswith(".py"), F.col("path"))).alias("python_files"))
    return per.join(dead.groupBy("branch_id").agg(F.count(F.lit(1)).alias("total_dead")), "branch_id", "left").fillna(0, ["total_dead"])


def stored_imports(files: DataFrame) -> DataFrame:
    """GR1: (branch_id, src, dst) between Python files, from the import statements in stored analyses; modules outside the branch are left out."""
    py = files.where(F.col("path").endswith(".py"))
    said = py.select("branch_id", normal_path(F.col("path")).alias("src"), F.explode("analysis.imports").alias("s")).select("branch_id", "src", F.regexp_extract("s", r"^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)", 1).alias("module"))
    known = py.select("branch_id", normal_path(F.col("path")).alias("dst")).distinct()
    known = known.select("branch_id", "dst", dotted_module(F.col("dst")).alias("module"))
    return said.join(known, ["branch_id", "module"]).where("src <> dst").select("branch_id", "src", "dst").distinct()


def architecture(files: DataFrame, edges: DataFrame, folder: str | None = None) -> DataFrame:
    """GR3-GR4, SO1: (branch_id, path, language, isolated): every file of a known language, edges' ends and isolated ones alike, within a folder."""
    nodes = files.select("branch_id", normal_path(F.col("path")).alias("path")).distinct()
    if folder:
        nodes = nodes.where(in_folder(F.col("path"), folder))
    nodes = nodes.withColumn("language", language(F.col("path"))).where("language is not null")
    ends = edges.select("branch_id", F.explode(F.array("src", "dst")).alias("path")).distinct().withColumn("linked", F.lit(True))
    return nodes.join(ends, ["branch_id", "path"], "left").select("branch_id", "path", "language", F.col("linked").isNull().alias("isolated"))


_SEPARATOR = "\u0000"


def architecture_health(nodes: DataFrame, edges: DataFrame, threshold: int = DEFAULT.high_coupling) -> dict[str, DataFrame]:
    """GR8, AG6: tables ``violations`` (branch_id, src, dst, kind, message), ``cycles`` (branch_id, nodes, size), ``coupled`` (branch_id, path, fan_in, fan_out, coupling) and ``summary`` with the counts of every branch."""
    v = graph.layer_violations(edges)
    said = F.when(F.col("kind") == "reverse", F.concat("src_layer", F.lit(" depends upward on "), "dst_layer")).otherwise(F.concat("src_layer", F.lit(" bypasses "), "dst_layer", F.lit(" boundaries")))
    violations = v.select("branch_id", "src", "dst", "kind", said.alias("message"))
    key = lambda c: F.concat_ws(_SEPARATOR, "branch_id", c)
    keyed = edges.select(key("src").alias("src"), key("dst").alias("dst"))
    part = lambda c, i: F.split(c, _SEPARATOR)[i]
    members = graph.strong_components(keyed)
    cycles = members.groupBy("component").agg(F.sort_array(F.collect_set(part("node", 1))).alias("nodes")).select(part("component", 0).alias("branch_id"), "nodes", F.size("nodes").alias("size"))
    coupled = graph.degrees(keyed, threshold).select(part("node", 0).alias("branch_id"), part("node", 1).alias("path"), "fan_in", "fan_out", "coupling").orderBy("branch_id", F.desc("coupling"), "path")
    summary = nodes.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    for df, name in ((edges, "n_edges"), (violations, "layer_violations"), (cycles, "circular_dependencies"), (coupled, "high_coupling_modules")):
        summary = summary.join(df.groupBy("branch_id").agg(F.count(F.lit(1)).alias(name)), "branch_id", "left").fillna(0, [name])
    return {"violations": violations, "cycles": cycles, "coupled": coupled, "summary": summary}


def issue_report(files: DataFrame, found: DataFrame) -> DataFrame:
    """RS3, AG1, AG4: per branch, files listed (those that are skipped too), findings, and findings per severity; a branch without findings has zeros."""
    listed = files.groupBy("branch_id").agg(F.count_distinct("path").alias("total_files_scanned"))
    s = issues.summary(found).withColumnRenamed("total", "total_findings")
    return listed.join(s, "branch_id", "left").fillna(0)


def explained(found: DataFrame) -> DataFrame:
    """RS1: findings with message and remedy."""
    texts = F.create_map(*[x for i, m, r in EXPLAINED for x in (F.lit(i), F.struct(F.lit(m).alias("message"), F.lit(r).alias("solution")))])
    return found.withColumn("__t", texts[F.col("id")]).withColumn("message", F.col("__t.message")).withColumn("solution", F.col("__t.solution")).drop("__t")


def finding_groups(found: DataFrame, severity: str | None = None, category: str | None = None, words: str | None = None) -> DataFrame:
    """TK12, AG21: (branch_id, path, n_findings, risk_score, worst) of files with findings that meet the filters, riskiest first."""
    f = found
    if severity:
        f = f.where(F.col("severity") == severity)
    if category:
        f = f.where(F.col("category") == category)
    if words:
        f = f.where(F.contains(F.lower(F.concat_ws(" ", "path", "id", "snippet")), F.lit(words.lower())))
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(issues.SEVERITIES)])
    per = f.groupBy("branch_id", "path").agg(F.count(F.lit(1)).alias("n_findings"), F.sum(issues.risk()).cast("long").alias("risk_score"), F.min_by("severity", rank).alias("worst"))
    return per.orderBy("branch_id", F.desc("risk_score"), "path")


def dependency_report(manifests: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEP4-DEP6, AG9: the dependencies in order of name with their advisories and what to do, and one row of counts with the list of manifests."""
    deps = history.with_advisories(history.dependencies(manifests), advisories)
    todo = F.concat(F.lit("Upgrade "), "name", F.lit(" past the version(s) named in "), F.array_join("ids", ", "), F.lit(" — check the advisory on osv.dev for the first patched release."))
    rows = deps.withColumn("ids", F.when(F.col("version").isNull(), F.array().cast("array<string>")).otherwise(F.col("ids"))).withColumn("solution", F.when(F.size("ids") > 0, todo))
    read = manifests.where(F.col("content").isNotNull()).agg(F.sort_array(F.collect_set("path")).alias("manifests")).first()["manifests"]
    counts = rows.agg(F.count(F.lit(1)).alias("total_dependencies"), F.coalesce(F.sum((F.size("ids") > 0).cast("long")), F.lit(0)).alias("vulnerable_count"))
    return rows.orderBy(F.lower("name"), "ecosystem"), counts.withColumn("manifests", F.array(*[F.lit(p) for p in read]).cast("array<string>"))


def health_inputs(branches: DataFrame, found: DataFrame, dead: DataFrame, architecture_summary: DataFrame, vulnerable: DataFrame, churned: DataFrame, top: int = DEFAULT.churn_top) -> DataFrame:
    """One row per branch with the five reports' figures; a branch that a report says nothing of has zeros.

    ``dead`` (branch_id, total_dead), ``architecture_summary`` as in :func:`architecture_health`, ``vulnerable`` (branch_id, vulnerable_count), ``churned`` (branch_id, path, churn).
    """
    points = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in history.SEVERITY_POINTS.items()], F.lit(1.0))
    of = lambda c: F.sum(F.when(F.col("category") == c, points).otherwise(0.0))
    f = found.groupBy("branch_id").agg(of("security").alias("security_points"), of("quality").alias("quality_points"))
    # The score sees the most changed paths of each branch.
    hot = history.history_of(churned, ["branch_id"], [F.desc("churn"), F.asc("path")], top).where("churn >= 5")
    hot = hot.groupBy("branch_id").agg(F.least(F.lit(40), F.sum(F.col("churn") - 4)).cast("double").alias("hotspot_points"), F.count(F.lit(1)).alias("n_hotspots"))
    out = branches.select("branch_id").distinct()
    for df in (f, dead.select("branch_id", "total_dead"), architecture_summary.select("branch_id", "layer_violations", "circular_dependencies", "high_coupling_modules"), vulnerable.select("branch_id", "vulnerable_count"), hot):
        out = out.join(df, "branch_id", "left")
    return out.fillna(0)


def health(inputs: DataFrame) -> DataFrame:
    """SC1-SC3, AG14-AG16: the scores of the five categories, the overall score and the grade, from :func:`health_inputs`."""
    dead = F.least(F.lit(25.0), 1.5 * F.col("total_dead"))
    scored = inputs.select(
        "branch_id",
        bounded(100 - F.col("security_points")).alias("security"),
        bounded(bounded(100 - F.col("quality_points")) - dead).alias("maintainability"),
        bounded((100 - 6 * F.col("layer_violations") - 15 * F.col("circular_dependencies") - 3 * F.col("high_coupling_modules")).cast("double")).alias("architecture"),
        bounded(100 - F.least(F.lit(100.0), 12.0 * F.col("vulnerable_count"))).alias("dependencies"),
        bounded(100 - F.col("hotspot_points")).alias("change_risk"),
    )
    overall = bounded(sum((F.col(k) * w for k, w in history.SCORE_WEIGHTS.items()), F.lit(0.0)))
    out = scored.withColumn("overall", overall)
    return out.withColumn("grade", F.when(F.col("overall") >= 90, "A").when(F.col("overall") >= 80, "B").when(F.col("overall") >= 70, "C").when(F.col("overall") >= 60, "D").otherwise("F"))


def deductions(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """AG14: (branch_id, category, reason, points) of everything that costs a branch points."""
    points = F.coalesce(*[F.when(F.col("severity") == s, F.lit(p)) for s, p in history.SEVERITY_POINTS.items()], F.lit(1.0))
    by = found.where("category in ('security', 'quality')").groupBy("branch_id", "category", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("points"))
    label = F.concat(F.col("n").cast("string"), F.lit(" "), "severity", F.lit(" "), "category", F.lit(" finding(s)"))
    first = by.select("branch_id", F.when(F.col("category") == "quality", "maintainability").otherwise(F.col("category")).alias("category"), label.alias("reason"), F.round("points", 2).alias("points"))
    kinds = (
        ("maintainability", "total_dead", " potentially unreferenced symbol(s)", F.least(F.lit(25.0), 1.5 * F.col("total_dead"))), ("architecture", "layer_violations", " layer violation(s)", 6.0 * F.col("layer_violations")),
        ("architecture", "circular_dependencies", " dependency cycle(s)", 15.0 * F.col("circular_dependencies")), ("architecture", "high_coupling_modules", " highly coupled module(s)", 3.0 * F.col("high_coupling_modules")),
        ("dependencies", "vulnerable_count", " vulnerable dependency/dependencies", F.least(F.lit(100.0), 12.0 * F.col("vulnerable_count"))), ("change_risk", "n_hotspots", " high-churn file(s)", F.col("hotspot_points")),
    )
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.concat(F.col(n).cast("string"), F.lit(r)).alias("reason"), p.cast("double").alias("points"), F.col(n).cast("long").alias("n")) for c, n, r, p in kinds])
    rest = inputs.select("branch_id", F.explode(each).alias("x")).where("x.n > 0").select("branch_id", "x.category", "x.reason", "x.points")
    return first.unionByName(rest)


def lookup(index: DataFrame, name: str) -> DataFrame:
    """IX2: the rows of exactly this name."""
    return index.where(F.col("name") == name)


def expansions(results: DataFrame, calls: DataFrame, functions: DataFrame, groups: list[str], top: int = DEFAULT.expansion_results) -> DataFrame:
    """GR14, JN11: (groups, path, name, start_line, end_line, text, score, nth): sources of the functions that retrieved symbols call, then of those that call them, in order.

    ``results`` (groups, branch_id, path, name, type, rank), ``calls`` (branch_id, src, dst), ``functions`` as :func:`symbols`. What was retrieved already is left out, and what is no function; the score is fixed.
    """
    r = results.where("type in ('function', 'class')").select(*groups, "branch_id", "rank", F.concat("path", F.lit("::"), "name").alias("node"))
    known = calls.where("dst is not null")
    out = r.join(known, (r["branch_id"] == known["branch_id"]) & (r["node"] == known["src"])).select(*groups, r["branch_id"], F.col("dst").alias("key"), F.struct("rank", F.lit(0).alias("side"), F.col("dst").alias("k")).alias("o"))
    back = r.join(known, (r["branch_id"] == known["branch_id"]) & (r["node"] == known["dst"])).select(*groups, r["branch_id"], F.col("src").alias("key"), F.struct("rank", F.lit(1).alias("side"), F.col("src").alias("k")).alias("o"))
    first = out.unionByName(back).groupBy(*groups, "branch_id", "key").agg(F.min("o").alias("o"))
    have = results.select(*groups, "branch_id", F.concat("path", F.lit("::"), "name").alias("key")).distinct()
    code = functions.where("type = 'function' and code is not null").groupBy("branch_id", F.concat("path", F.lit("::"), "name").alias("key")).agg(F.min(F.struct("line", "end_line", "code")).alias("c"))
    found = first.join(have, [*groups, "branch_id", "key"], "left_anti").join(code, ["branch_id", "key"])
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy("o"))
    part = lambda i: F.split("key", "::")[i]
    return found.withColumn("nth", nth).where(F.col("nth") <= top).select(*groups, "branch_id", part(0).alias("path"), part(1).alias("name"), F.col("c.line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.code").alias("text"), F.lit(0.5).alias("score"), "nth")
