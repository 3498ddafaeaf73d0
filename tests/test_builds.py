"""Impact, lexical extraction, builds."""

from pyspark.sql import functions as F

from codeloom.operators import impact
from codeloom.plans.pipeline import Workspace, register_views
from codeloom.sources import lexical

CALLS = [("app/routers/auth.py::login", "app/service.py::validate"), ("app/main.py::run", "app/routers/auth.py::login"), ("tests/test_a.py::test_login", "app/routers/auth.py::login"), ("app/x.py::f", None)]
DEFS = [("app/routers/auth.py::login", 3, ["post"]), ("app/service.py::validate", 1, []), ("tests/test_a.py::test_login", 9, None)]
EDGES = [("app/routers/auth.py", "app/service.py"), ("app/main.py", "app/routers/auth.py")]


def parts(spark, target, depth=3):
    c = spark.createDataFrame(CALLS, "src string, dst string")
    d = spark.createDataFrame(DEFS, "node string, line int, decorators array<string>")
    return impact.change_impact(c, spark.createDataFrame(EDGES, "src string, dst string"), d, target, depth)


def test_change_impact(spark):
    for target in ("app/service.py::validate", "APP/service.py::Validate", "app/service.py", "VALIDATE"):
        got = parts(spark, target)
        s = {r.node: r for r in got["symbols"].collect()}
        assert s["app/routers/auth.py::login"].depth == 1 and s["app/routers/auth.py::login"].is_endpoint
        assert [n for n, r in s.items() if r.is_test] == ["tests/test_a.py::test_login"]
        assert {r.node: r.depth for r in got["modules"].collect()} == {"app/routers/auth.py": 1, "app/main.py": 2}
        r = got["summary"].first()
        assert (r.direct, r.transitive, r.modules, r.endpoints, r.score, r.risk) == (1, 2, 2, 1, 48, "medium")
    assert parts(spark, "nothing")["summary"].first().score == 0


def test_relations(spark):
    got = {r.node: r.relations for r in impact.relations(spark.createDataFrame(CALLS, "src string, dst string")).collect()}
    assert got["app/routers/auth.py::login"] == "Calls: validate\nCalled by: run, test_login"


def names(lang, text):
    return [(k, n, a, z) for k, n, _, a, z in lexical.extract(lang, text)]


def test_lexical():
    assert names("go", 'package a\n\nimport "fmt"\n\ntype T struct {\n}\n\nfunc (t *T) F() {\n\tx := "func g() {"\n}\n') == [("import", 'import "fmt"', 3, 3), ("class", "T", 5, 6), ("function", "F", 8, 10)]
    assert names("javascript", "import a from './a';\n// function no() {}\nconst f = (x) => {\n  return x;\n};\nclass C {\n  m(a) {\n  }\n}\n") == [("import", "import a from './a';", 1, 1), ("function", "f", 3, 5), ("class", "C", 6, 9), ("function", "m", 7, 8)]
    assert [(k, n) for k, n, *_ in names("java", "import a.B;\nclass A {\n  public int f(int x) {\n    if (x > 0) {\n    }\n    return x;\n  }\n}\n")] == [("import", "import a.B;"), ("class", "A"), ("function", "f")]
    assert [(k, n) for k, n, *_ in names("rust", "use a::b;\npub struct S {}\nfn f() {}\n")] == [("import", "use a::b;"), ("class", "S"), ("function", "f")]
    assert [(k, n) for k, n, *_ in names("ruby", "require 'x'\nclass A\n  def f\n  end\nend\n")] == [("import", "require 'x'"), ("class", "A"), ("function", "f")]
    assert [(k, n) for k, n, *_ in names("c", "#include <a.h>\nint f(int a) {\n}\n")] == [("import", "#include <a.h>"), ("function", "f")]
    assert [(k, n) for k, n, *_ in names("python", "import os\nclass A:\n    @x\n    def f(self):\n        pass\n")] == [("import", "import os"), ("class", "A"), ("function", "f")]
    assert lexical.extract("python", "def (") == [] and lexical.extract("cobol", "x") == []


def test_builds(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    scan = lambda rows: spark.createDataFrame(rows, "path string, content_hash string, raw_text string")
    first = w.build(scan([("a", "1", "x\ny"), ("b", "1", "z"), ("c", "1", "")]), "m")
    assert first == {"mode": "full", "files_changed": 3, "files_deleted": 0, "files_unchanged": 0}
    assert w.vectors.size("m") == 2
    again = w.build(scan([("a", "2", "new"), ("b", "1", "z"), ("d", "1", "w")]), "m", "sha")
    assert again == {"mode": "incremental", "files_changed": 2, "files_deleted": 1, "files_unchanged": 1}
    assert sorted((r.path, r.text) for r in w.chunks.read().collect()) == [("a", "new"), ("b", "z"), ("d", "w")]
    assert w.vectors.read().where(F.size("embedding") == 768).count() == 3
    assert w.build(scan([("a", "2", "new"), ("b", "1", "z"), ("d", "1", "w")]), "m", "sha")["files_changed"] == 0


def test_builds_chunk_code_whole(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    body = "".join(f"    x{i} = {i}\n" for i in range(900))
    docs = [("m.py", f"class A:\n    pass\n\ndef f():\n{body}\ndef last():\n    return 1\n"), ("Dockerfile", "FROM a:1\nRUN x\n"), ("compose.yml", "services:\n  api:\n    image: a\n"), ("n.txt", "words")]
    w.build(spark.createDataFrame([(p, "1", t) for p, t in docs], "path string, content_hash string, raw_text string"), "m")
    got = {(r.path, r.type, r.name): r for r in w.chunks.read().collect()}
    assert {k[1:] for k in got if k[0] == "m.py"} == {("function", "f"), ("function", "last"), ("class", "A")}
    assert "x899 = 899" in got["m.py", "function", "f"].text and got["m.py", "function", "last"].start_line == 906
    assert got["m.py", "class", "A"].text == "Class: A" and got["m.py", "class", "A"].start_line == 1
    assert ("Dockerfile", "docker_instruction", "RUN x") in got and ("compose.yml", "docker_service", "api") in got and ("n.txt", "text", "n.txt") in got
    assert w.vectors.size("m") == len(got)


def test_views(spark, sf):
    register_views(spark, sf, ["issue_summary"])
    assert spark.sql("select sum(total) from issue_summary").first()[0] >= 0
