"""Units: golden cases and randomised graphs against plain Python."""

import random
import subprocess
import uuid

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.embed import embed
from codeloom.operators import chunking, graph, history, issues, ranked, retrieval
from codeloom.sources import code, docker
from codeloom.sources.tables import BranchTable


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.tokenize(F.lit("parseHTTPRequest getUser_name 42"))) == ["parse", "httprequest", "get", "user_name", "42"]
    name = "b:p:function:f:3:abc"
    assert one(spark, T.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))
    assert one(spark, T.join_path(F.lit("src/a"), F.lit("../b/./c"))) == "src/b/c"
    assert one(spark, T.join_path(F.lit(""), F.lit("../x"))) == "x"
    assert one(spark, T.relative_module(F.lit("pkg.sub.mod"), F.lit(1), F.lit("x"))) == "pkg.sub.x"
    assert one(spark, T.layer(F.lit("frontend/services/x.py"))) == "presentation"
    assert one(spark, T.layer(F.lit("a/services"))) == "service"
    assert one(spark, T.language(F.lit("x/Dockerfile.dev"))) == "dockerfile"
    assert one(spark, T.language(F.lit("docker-compose.prod.yml"))) == "docker-compose"
    assert one(spark, T.normal_url(F.lit(" git@github.com:A/B.git "))) == "a/b"
    assert one(spark, T.is_test(F.lit("src/x.py::test_a"))) is True
    assert one(spark, T.is_entrypoint(F.lit("f"), F.array(F.lit("get")))) is True
    assert one(spark, T.is_entrypoint(F.lit("f"), F.lit(None).cast("array<string>"))) is False


def test_ranks_do_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.0, -1.5, 2.0, rng.uniform(-1e6, 1e6), rng.uniform(0, 1e-6)])) for _ in range(400)]
    got = ranked.grouped_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    for r in got:
        same = [v for k, v in rows if k == r.k]
        assert r.rank == 1 + sum(v < r.v for v in same) and r.total == len(same)
    # Ties of a third of all rows are spread; close values fall into different parts.
    close = [("a", 0.8 + i * 1e-9) for i in range(300)] + [("a", 0.5)] * 200
    df = spark.createDataFrame(close, "k string, v double")
    hot = ranked.grouped_rank(df, ["k"], "v", spread=F.rand(1), hot_rows=50).collect()
    assert sorted((r.v, r.rank, r.total) for r in hot) == sorted((v, 1 + sum(y < v for _, y in close), 500) for _, v in close)


def test_rules_find_each_line_once(spark):
    text = "eval(x)\neval(y) # TODO\n  debugger;\nyaml.load(f)\nyaml.load(f, Loader=yaml.SafeLoader)\n"
    files = spark.createDataFrame([("b", "a.py", (text,)), ("b", "x.PNG", ("eval(1)",)), ("b", "n.py", None)], "branch_id string, path string, analysis struct<raw_text: string>")
    got = sorted((r.id, r.line) for r in issues.findings(files).collect())
    assert got == [("debugger-statement", 3), ("eval-usage", 1), ("eval-usage", 2), ("todo-comment", 2), ("yaml-unsafe-load", 4)]
    assert [(r.id, r.snippet) for r in issues.findings(files, 3).where("id = 'large-file'").collect()] == [("large-file", "5 lines")]


def test_windows_equal_slicing(spark):
    text = "\n".join(f"l{i}" if i % 7 else "" for i in range(205))
    t = spark.createDataFrame([("b", "p", text), ("b", "q", ""), ("b", "r", None)], "branch_id string, path string, raw_text string")
    got = [(r.path, r.start_line, r.text) for r in chunking.text_windows(t, 40, 3, 60).orderBy("start_line").collect()]
    lines = text.split("\n")
    want = [("p", a + 1, "\n".join(lines[a : a + 40]).strip()[:60]) for a in range(0, 205, 40)][:3]
    assert got == want


def random_edges(seed, n=14, m=26):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def closure(edges):
    reach = {}
    for s in {x for e in edges for x in e}:
        todo, seen = [s], set()
        while todo:
            for a, b in edges:
                if a == (x := todo[0]) and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        reach[s] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components(spark, seed):
    edges = random_edges(seed)
    r = closure(edges)
    want = sorted((a, min(b for b in r[a] if a in r[b])) for a in r if a in r[a])
    got = sorted((x.node, x.component) for x in graph.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect())
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_reach(spark, seed):
    edges = random_edges(seed)
    depth, level = {0: 0}, [0]
    for d in range(1, 4):
        level = sorted({a for a, b in edges if b in level and a not in depth})
        depth |= dict.fromkeys(level, d)
    got = graph.reach(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,)], "node int"), 3)
    assert sorted(map(tuple, got.collect())) == sorted((n, d) for n, d in depth.items() if d)


def test_layer_violations(spark):
    e = spark.createDataFrame([("services/a.py", "routers/b.py"), ("ui/a.js", "services/b.py"), ("routers/a.py", "services/b.py"), ("x/a", "db/b")], "src string, dst string")
    assert sorted(r.kind for r in graph.layer_violations(e).collect()) == ["reverse", "skipped"]


def test_bm25_prefers_the_phrase(spark):
    docs = spark.createDataFrame([(1, "def login_user(): pass"), (2, "user list"), (3, ""), (4, None)], "id int, document string")
    got = retrieval.bm25(docs, "id", "login_user").collect()
    assert [r.id for r in got] == [1] and got[0].exact_match
    # Every text contains the empty phrase, and no word is asked for: the phrase's boost alone is left.
    assert {r.score for r in retrieval.bm25(docs, "id", "").collect()} <= {2.0}


def test_fusion_rewards_both_channels(spark):
    hits = [(1, "a", "semantic", 0.9, False), (1, "b", "semantic", 0.8, False), (1, "b", "lexical", 7.0, True), (1, "c", "lexical", 9.0, False)]
    got = retrieval.fuse(spark.createDataFrame(hits, "q int, c string, method string, score double, exact boolean"), ["q"], "c", {"semantic": 0.6, "lexical": 0.4}).orderBy("rank").collect()
    assert got[0].c == "b" and got[0].score == 1.0 and got[0].methods == ["lexical", "semantic"]


PY = {
    "app/util.py": "def helper():\n    return 1\n\nclass Tool:\n    def run(self):\n        return self.step()\n    def step(self):\n        return helper()\n",
    "app/main.py": "from .util import helper as h, Tool\nimport app.util as u\n\n@app.get('/')\ndef index():\n    def inner():\n        return h()\n    return Tool()\n\ndef unused():\n    return unused()\n\ndef dead():\n    return u.helper()\n",
    "app/bad.py": "def broken(:\n",
}


def py_files(spark):
    return spark.createDataFrame([("b", p, (t,)) for p, t in PY.items()], "branch_id string, path string, analysis struct<raw_text: string>")


def test_call_graph(spark):
    edges = {(r.src, r.text, r.dst) for r in code.call_edges(code.symbols(py_files(spark))).collect()}
    assert ("app/util.py::step", "helper", "app/util.py::helper") in edges
    assert ("app/util.py::run", "self.step", "app/util.py::step") in edges
    assert ("app/main.py::index", "h", "app/util.py::helper") in edges
    assert ("app/main.py::index", "Tool", "app/util.py::Tool") in edges
    assert ("app/main.py::dead", "u.helper", "app/util.py::helper") in edges
    assert ("app/main.py::unused", "unused", "app/main.py::unused") in edges
    assert not any(s.startswith("app/bad.py") for s, _, _ in edges)


def test_definitions_and_imports(spark):
    rows = code.symbols(py_files(spark))
    d = {(r.path, r.name): (r.type, r.decorators) for r in code.definitions(rows).collect()}
    assert d["app/main.py", "index"] == ("function", ["get"]) and d["app/util.py", "Tool"][0] == "class"
    got = {(r.src, r.dst) for r in code.python_import_edges(rows, py_files(spark)).collect()}
    assert got == {("app/main.py", "app/util.py")}


def test_js_imports(spark):
    files = {"src/a.js": "import x from './b';\nconst y = require('../lib');\nimport z from 'react';\nimport './a.js';", "src/b.ts": "", "lib/index.js": "export * from '/src/b.ts'"}
    df = spark.createDataFrame([("b", p, (t,)) for p, t in files.items()], "branch_id string, path string, analysis struct<raw_text: string>")
    assert {(r.src, r.dst) for r in code.js_import_edges(df).collect()} == {("src/a.js", "src/b.ts"), ("src/a.js", "lib/index.js"), ("lib/index.js", "src/b.ts")}


def test_docker(spark):
    src = "# escape=`\nFROM python:3 AS build\nRUN a `\n  # note\n\n  && b\nRUN <<EOF\nFROM fake\nEOF\nFROM scratch\nCOPY --from=build /x /y\nCOPY --from=nginx:1 /a /b\nCOPY --from=0 /a /b\n"
    rows = docker.docker_instructions(src)
    assert [r[0] for r in rows] == ["FROM", "RUN", "RUN", "FROM", "COPY", "COPY", "COPY"]
    assert rows[1][2:] == (3, 6) and rows[2][2:] == (7, 9)
    multi = "# syntax=docker/dockerfile:1\r\nARG BASE=python:3.11-slim\r\nFROM --platform=$BUILDPLATFORM ${BASE} AS builder\r\nFROM Builder AS test\nFROM scratch\nCOPY --from=builder /a /a\nCOPY --from=busybox:1.36 /b /b\nCOPY --from=later /c /c\nFROM x AS later\nFROM x"
    quoted = "FROM alpine\nRUN echo '<<EOF'\nRUN cat <<<word\nCOPY <<'A' <<-\"B\" /d\nFROM no\nA\n\tstill\n\tB\nCMD [\"sh\"]"
    assert [(r[0], r[2], r[3]) for r in docker.docker_instructions(quoted)] == [("FROM", 1, 1), ("RUN", 2, 2), ("RUN", 3, 3), ("COPY", 4, 8), ("CMD", 9, 9)]
    assert docker.docker_instructions("") == [] and docker.docker_instructions("\n# only\n") == [] and docker.docker_instructions("RUN a \\")[0][:2] == ("RUN", "a")
    f = spark.createDataFrame([("b", "Dockerfile", src), ("b", "x/Dockerfile.dev", multi), ("b", "q.dockerfile", quoted), ("b", "bin/Dockerfile", "FROM a\0"), ("b", "notes.md", "FROM a")], "branch_id string, path string, t string")
    f = f.select("branch_id", "path", F.struct(F.col("t").alias("raw_text")).alias("analysis"))
    rows = docker.instructions(f)
    assert {r.path: r.images for r in docker.images(rows).collect()} == {"Dockerfile": ["python:3", "nginx:1"], "x/Dockerfile.dev": ["${BASE}", "busybox:1.36", "later", "x"], "q.dockerfile": ["alpine"]}
    st = [(r.stage_no, r.base_image, r["name"], r.start_line) for r in docker.stages(rows).where("path = 'x/Dockerfile.dev'").orderBy("stage_no").collect()]
    assert st == [(1, "${BASE}", "builder", 3), (2, "Builder", "test", 4), (3, "scratch", None, 5), (4, "x", "later", 9), (5, "x", None, 10)]


def test_compose(spark):
    text = "x-base: &base\n  image: demo:1\nservices:\n  api:\n    <<: *base\n    build:\n      context: ./b\n    depends_on:\n      db:\n        condition: up\n    ports: ['80:80', 90]\n  w:\n    image: demo:1\n    depends_on: [api]\n  bad: 3\nvolumes:\n  d: {}\n"
    api, w = docker.compose_services(text)
    assert api[:5] == ("api", "demo:1", '{"context": "./b"}', ["db"], ["80:80", "90"]) and api[5:7] == (4, 11) and "w:" not in api[7]
    assert w[0] == "w" and w[3] == ["api"] and w[5:7] == (12, 14)
    for odd in ("services: [", "a: 1", "", "- list", "services: null", "services: {api: null}", "services: {1: {image: a}}"):
        assert docker.compose_services(odd) == []
    f = spark.createDataFrame([("b", "deploy/compose.prod.yaml", text), ("b", "compose.yml", "services: ["), ("b", "x.yml", text)], "branch_id string, path string, t string")
    rows = docker.services(f.select("branch_id", "path", F.struct(F.col("t").alias("raw_text")).alias("analysis"))).collect()
    assert sorted((r.path, r.service) for r in rows) == [("deploy/compose.prod.yaml", "api"), ("deploy/compose.prod.yaml", "w")]


def test_git_sources(spark, tmp_path):
    from codeloom.sources import git

    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for name in ("first", "deleted"):
        (tmp_path / name).write_text("1")
    run("add", "-A"), run("commit", "-qm", "one")
    (tmp_path / "first").write_text("2")
    (tmp_path / "added").write_text("3")
    (tmp_path / "deleted").unlink()
    run("add", "-A"), run("commit", "-qm", "two")
    assert git.git_changes(str(tmp_path), "HEAD~1", "HEAD") == ({"first", "added"}, {"deleted"})
    assert git.git_branches(str(tmp_path)) == ["main"]
    log = git.git_log(spark, str(tmp_path))
    assert {r.path: r["count"] for r in log.groupBy("path").count().collect()} == {"first": 2, "deleted": 2, "added": 1}


def test_checkout(spark, tmp_path):
    from codeloom.sources import checkout

    for p, t in {"a.py": b"x = 1", "node_modules/b.js": b"1", "Makefile": b"all:", "blob": b"a\0b", "i.PNG": b"1", "c.weird": b"1"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(t)
    assert {r.path for r in checkout.listing(spark, str(tmp_path)).collect()} == {"a.py", "Makefile", "blob", "i.PNG", "c.weird"}
    assert {r.path: r.raw_text for r in checkout.contents(spark, str(tmp_path)).collect()} == {"a.py": "x = 1", "Makefile": "all:"}


def test_intermediates_can_be_released(spark):
    from codeloom.session import materialize, release

    release(spark)
    df = materialize(spark.range(5).toDF("n"), "probe")
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0


def test_branch_table(spark, tmp_path):
    t = BranchTable(spark, str(tmp_path / "t"), "path string, text string, branch_id string")
    df = lambda rows: spark.createDataFrame(rows, "branch_id string, path string, text string")
    assert t.size("x") == 0
    t.replace(df([("x", "a", "1"), ("x", "b", "1"), ("y", "a", "1")]))
    t.merge(df([("x", "a", "2")]), "x", df([("x", "b", "")]))
    assert sorted((r.branch_id, r.path, r.text) for r in t.read().collect()) == [("x", "a", "2"), ("y", "a", "1")]


def test_health_and_mode(spark):
    assert history.build_mode(None, 3, 0) == "full" and history.build_mode("s", 3, 1) == "full" and history.build_mode("s", 3, 0) == "incremental"


def test_embedding(spark):
    got = embed(spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id int, t string"), "id", "t").collect()
    assert all(len(r.embedding) == 768 for r in got) and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-5


def test_pushes(spark):
    from codeloom.streaming import push

    body = lambda ref: '{"ref": "%s", "after": "abc", "repository": {"clone_url": "https://github.com/A/B.git"}}' % ref
    rows = [(body("refs/heads/main"), push.signature_of("s", body("refs/heads/main")), 1), (body("refs/tags/v1"), push.signature_of("s", body("refs/tags/v1")), 2), (body("refs/heads/x"), "sha256=bad", 3), ("{", None, 4)]
    df = spark.createDataFrame(rows, "body string, signature string, ts long")
    assert [tuple(r) for r in push.pushes(df, "s").collect()] == [("a/b", "main", "abc", 1)]
    assert push.pushes(df, None).count() == 0
    assert push.pushes(df, "s", spark.createDataFrame([("git@github.com:other/x",)], "url string")).count() == 0


def test_chain_of_cycles_keeps_every_component(spark):
    pairs = [e for i in range(0, 12, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    want = {n: n - n % 2 for n in range(12)}
    for edges in (pairs, [(11 - a, 11 - b) for a, b in pairs]):
        got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=3).collect()
        assert {r.node: r.component for r in got} == want and len(got) == 12
