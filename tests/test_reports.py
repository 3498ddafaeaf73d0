"""Reports, whole searches and contexts on small fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions.embed import retry_delay
from codeloom.operators import impact, reports, retrieval
from codeloom.plans.pipeline import Workspace
from codeloom.sources import analysis, checkout, code
from codeloom.sources.tables import require_index, resolve_branch, upsert_report
from codeloom.streaming import push

FILES = "id string, branch_id string, path string, analysis struct<functions: array<struct<name: string, code: string, start_line: int, end_line: int>>, classes: array<string>, class_locations: map<string, struct<start_line: int, end_line: int>>, imports: array<string>, graph: map<string, array<string>>, blocks: array<struct<type: string, name: string, code: string, start_line: int, end_line: int>>, raw_text: string>"


def stored(spark):
    fn = lambda *names: [(n, f"def {n}(): pass", i * 3 + 1, i * 3 + 2) for i, n in enumerate(names)]
    rows = [
        ("1", "b", "app/routers/users.py", (fn("login", "main"), ["Q"], {"Q": (9, 12)}, ["from app.repositories.users import find", "import os"], {"login": ["find", "helper", "gone"]}, None, "")),
        ("2", "b", "app/repositories/users.py", (fn("find", "idle"), [], None, ["import app.routers.users"], {"find": ["login"]}, None, "")),
        ("3", "b", "web/x.ts", (fn("helper"), [], None, ["import { a } from './y'"], None, None, "")),
        ("3", "b", "web/x.ts", (fn("helper"), [], None, ["import { a } from './y'"], None, None, "")),
        ("4", "b", "notes.md", None),
        ("5", "c", "z.go", (None, None, None, None, None, None, "")),
    ]
    return spark.createDataFrame(rows, FILES)


def test_stored_graphs(spark):
    f = reports.once(stored(spark))
    calls = reports.stored_calls(f)
    assert sorted((r.src, r.dst or "") for r in calls.collect()) == [("app/repositories/users.py::find", "app/routers/users.py::login"), ("app/routers/users.py::login", ""), ("app/routers/users.py::login", "app/repositories/users.py::find"), ("app/routers/users.py::login", "web/x.ts::helper")]
    nodes = {r.node: (r.n_calls, r.n_called_by) for r in reports.call_nodes(f, calls).where("branch_id = 'b'").collect()}
    assert nodes["app/routers/users.py::login"] == (3, 1) and nodes["app/routers/users.py::Q"] == (0, 0)
    assert [r.name for r in reports.dead_symbols(f, calls).collect()] == ["idle", "Q"]
    assert {r.branch_id: (r.total_dead, r.python_files) for r in reports.dead_code_report(stored(spark), reports.dead_symbols(f, calls)).collect()} == {"b": (2, 2), "c": (0, 0)}
    assert reports.calls_of(calls, "login").count() == 3 and reports.calls_of(calls, "nobody").count() == 0
    assert reports.lookup(reports.symbols(f), "find").count() == 1


def test_architecture(spark):
    f = reports.once(stored(spark))
    edges = reports.stored_imports(f)
    nodes = reports.architecture(stored(spark), edges)
    assert {(r.path, r.isolated) for r in nodes.collect()} == {("app/routers/users.py", False), ("app/repositories/users.py", False), ("web/x.ts", True), ("z.go", True)}
    assert {r.path for r in reports.architecture(stored(spark), edges, "web").collect()} == {"web/x.ts"}
    out = reports.architecture_health(nodes, edges, 2)
    assert sorted(r.message for r in out["violations"].collect()) == ["controller bypasses repository boundaries", "repository depends upward on controller"]
    assert [(r.branch_id, r.size) for r in out["cycles"].collect()] == [("b", 2)]
    assert {r.branch_id: (r.n_nodes, r.n_edges, r.layer_violations, r.circular_dependencies, r.high_coupling_modules) for r in out["summary"].collect()} == {"b": (3, 2, 2, 1, 2), "c": (1, 0, 0, 0, 0)}


def test_health_of_five_reports(spark):
    df = spark.createDataFrame
    found = df([("b", "high", "security"), ("b", "low", "quality")], "branch_id string, severity string, category string")
    arch = df([("b", 1, 0, 0)], "branch_id string, layer_violations int, circular_dependencies int, high_coupling_modules int")
    inputs = reports.health_inputs(df([("b",), ("empty",)], "branch_id string"), found, df([("b", 2)], "branch_id string, total_dead int"), arch, df([("b", 1)], "branch_id string, vulnerable_count int"), df([("b", "a.py", 8), ("b", "c.py", 4)], "branch_id string, path string, churn int"))
    got = {r.branch_id: r for r in reports.health(inputs).collect()}
    b = got["b"]
    assert (b.security, b.maintainability, b.architecture, b.dependencies, b.change_risk, b.overall, b.grade) == (90, 96, 94, 88, 96, 93, "A")
    assert got["empty"].overall == 100
    assert sorted((r.category, r.points) for r in reports.deductions(inputs, found).collect()) == [("architecture", 6.0), ("change_risk", 4.0), ("dependencies", 12.0), ("maintainability", 1.0), ("maintainability", 3.0), ("security", 10.0)]


def test_issue_and_dependency_reports(spark):
    df = spark.createDataFrame
    found = df([("b", "a.py", "eval-usage", "high", "security", 1, 5, "eval(x)"), ("b", "a.py", "todo-comment", "info", "quality", 2, 17, "# TODO"), ("b", "c.py", "debug-true", "low", "security", 1, 16, "DEBUG = True")], "branch_id string, path string, id string, severity string, category string, line int, ord int, snippet string")
    assert {r.branch_id: (r.total_files_scanned, r.total_findings, r.high) for r in reports.issue_report(stored(spark), found).collect()} == {"b": (4, 3, 1), "c": (1, 0, 0)}
    assert reports.explained(found).where("message is null or solution is null").count() == 0
    assert [(r.path, r.risk_score, r.worst) for r in reports.finding_groups(found, words="DEBUG").collect()] == [("c.py", 1, "low")]
    assert [r.path for r in reports.finding_groups(found, category="security").collect()] == ["a.py", "c.py"]
    manifests = df([("a/requirements.txt", "# base\nflask==2.0.1\nrequests>=2.25 ; python_version > '3'\n-r other.txt\nuvicorn[standard]==0.20\n\nnumpy"), ("b/package.json", '{"dependencies": {"react": "^18.2.0", "left-pad": "*"}, "devDependencies": {"vite": "~4.1.0"}}'), ("c/pyproject.toml", '[tool.poetry]\nname = "demo"\npython = "^3.11"\n[tool.poetry.dependencies]\nFlask = "^2.1"\nhttpx = ">=0.23"'), ("d/package.json", "{broken")], "path string, content string")
    rows, counts = reports.dependency_report(manifests, df([("flask", "2.0.1", "V-1"), ("flask", "2.0.1", "V-0")], "name string, version string, vuln_id string"))
    got = rows.collect()
    assert [(r.name, r.version) for r in got] == [("flask", "2.0.1"), ("httpx", "0.23"), ("left-pad", None), ("numpy", None), ("react", "18.2.0"), ("requests", "2.25"), ("uvicorn", None), ("vite", "4.1.0")]
    assert got[0].ids == ["V-0", "V-1"] and "past the version(s) named in V-0, V-1" in got[0].solution and got[1].solution is None
    c = counts.first()
    assert (c.total_dependencies, c.vulnerable_count, len(c.manifests)) == (8, 1, 4)


def test_hybrid_search_and_context(spark):
    docs = spark.createDataFrame([(1, "def login_user(): pass"), (2, "user list"), (3, "other")], "id int, document string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (9, [1.0, 0.0])], "id int, embedding array<double>")
    got = retrieval.hybrid_search(docs, vectors, "id", "login_user", [1.0, 0.0], top=2).orderBy("rank").collect()
    assert [(r.id, r.methods, r.exact_match) for r in got] == [(1, ["lexical", "semantic"], True), (3, ["semantic"], False)]
    f = reports.once(stored(spark))
    calls, functions = reports.stored_calls(f), reports.symbols(f)
    results = spark.createDataFrame([(7, "b", "app/routers/users.py", "login", "function", 1, 2, "TEXT", 1, 1, 0)], "q int, branch_id string, path string, name string, type string, start_line int, end_line int, text string, rank int, nth int, part int")
    more = reports.expansions(results, calls, functions, ["q"])
    assert [(r.name, r.score) for r in more.orderBy("nth").collect()] == [("find", 0.5), ("helper", 0.5)]
    key = lambda c: F.concat("branch_id", F.lit(":"), c)
    said = impact.relations(calls.select(key("src").alias("src"), key("dst").alias("dst")))
    rows = results.withColumn("node", key(F.concat("path", F.lit("::"), "name"))).join(said, "node", "left")
    assert retrieval.context_blocks(rows, ["q"]).first().context == "SOURCE [app/routers/users.py:1-2] (function login)\nTEXT\nCalls: find, helper\nCalled by: find"


def test_inner_functions_own_their_calls(spark):
    text = "def f():\n    g(1)(x.y())\n    def h():\n        k(); k()\n    return h\nm(); m()\n"
    df = spark.createDataFrame([("b", "a.py", (text,))], "branch_id string, path string, analysis struct<raw_text: string>")
    assert {r["name"]: r.calls for r in code.local_calls(code.symbols(df, local=True)).collect()} == {"f": ["g", "g(1)", "x.y"], "h": ["k", "k"]}
    files = spark.createDataFrame([("b", "a.py", ("x = 1\nm(); m()\n",))], "branch_id string, path string, analysis struct<raw_text: string>")
    assert [(r.line, r.code) for r in code.references(code.symbols(files), "m", files).collect()] == [(2, "m(); m()"), (2, "m(); m()")]


def test_branches_reports_and_pushes(spark, tmp_path):
    b = spark.createDataFrame([("1", "r", "main", True, None), ("2", "r", "dev", None, "2024-01-01"), ("3", "s", "x", None, "2024-01-02"), ("4", "s", "y", None, "2024-01-03")], "id string, repository_id string, name string, is_default boolean, indexed_at string")
    one = lambda *a: [r.branch_id for r in resolve_branch(b, *a).collect()]
    assert one("r") == ["1"] and one("r", "dev") == ["2"] and one("s") == ["4"] and one("s", "none") == []
    with pytest.raises(LookupError):
        require_index(b.limit(0))
    w = Workspace(spark, str(tmp_path))
    upsert_report(w.reports, "k", issues_report="{}")
    upsert_report(w.reports, "k", health_score_report="1")
    upsert_report(w.reports, None, issues_report="{}")
    assert [(r.issues_report, r.health_score_report, r.updated_at is not None) for r in w.reports.read().collect()] == [("{}", "1", True)]
    scan = spark.createDataFrame([("n.txt", "h1", "text of n")], "path string, content_hash string, raw_text string")
    events = spark.createDataFrame([("a/b", "main", "s1", 1), ("a/b", "main", "s2", 2)], "repo string, branch string, sha string, ts long")
    push.rebuild(w, lambda repo, branch, sha: (scan, None))(events, 0)
    assert [(r.branch_id, r.last_commit_sha) for r in w.built.read().collect()] == [("a/b@main", "s2")] and w.chunks.read().count() == 1
    w.clear("a/b@main")
    w.clear("a/b@main")
    assert w.chunks.read().count() == 0
    assert retry_delay({"retry-after-ms": "1500"}, 1) == 1.5 and retry_delay({"retry-after": "7"}, 1) == 7 and retry_delay({}, 3) == 8 and retry_delay({"retry-after": "soon"}, 9) == 60
    a = spark.range(1).select(analysis.empty_analysis().alias("a")).first().a
    assert a.functions == [] and a.raw_text == ""
    f = spark.createDataFrame([("k", "d\\x.py", "t")], "branch_id string, path string, raw_text string")
    assert checkout.file_content(f, "k", "d/x.py").count() == 1 and checkout.file_content(f, "k", "/etc/passwd").count() == 0
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_bytes(b"x = '\xff'\n")
    assert checkout.contents(spark, str(tmp_path / "tree")).first().raw_text == "x = '\ufffd'\n"
