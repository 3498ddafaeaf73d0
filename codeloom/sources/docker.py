"""Dockerfiles and Compose files as rows: instructions, stages, images, services (PRS7-PRS10).

A Dockerfile is cut by one pattern whose matches are logical lines: physical lines that an escape character joins, with the
comments and blank lines between them. The bodies of here-documents are skipped by position. What a stage is and which
images come from outside is decided on the rows, by joins.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.code import sources

INSTRUCTIONS = "branch_id string, path string, no int, instruction string, value string, start_line int, end_line int"
SERVICES = "branch_id string, path string, service string, image string, build string, depends_on array<string>, ports array<string>, start_line int, end_line int, code string"
DOCKER_PATH = r"(?i)(?:^|/)(?:dockerfile|containerfile|(?:dockerfile|containerfile)\.[^/]*|[^/]*\.(?:dockerfile|containerfile))$"
COMPOSE_PATH = r"(?i)(?:^|/)(?:docker-)?compose(?:\.[^./]+)*\.ya?ml$"

_VOID = r"[^\S\n]*(?:#[^\n]*)?\n"
#: Parser directives, of which only the first comment lines of a file consist.
_DIRECTIVES = re.compile(r"(?:[^\S\n]*#[^\S\n]*(?:syntax|check|escape)[^\S\n]*=[^\n]*\n)*", re.I)
_ESCAPE = re.compile(r"#\s*escape\s*=\s*([\\`])[^\S\n]*$", re.I | re.M)
_WORD_AND_REST = re.compile(r"\s*([A-Za-z]+)(?!\S)\s*([\s\S]*)")
#: Words of a shell command as far as here-documents need them: what is quoted or escaped opens none, and <<< is another operator.
_SHELL = re.compile(r"""\\[\s\S]|'[^']*(?:'|$)|"(?:\\[\s\S]|[^"\\])*(?:"|$)|<<<|<<(?P<strip>-?)\s*(?:"(?P<a>[^"]+)"|'(?P<b>[^']+)'|(?P<c>[A-Za-z_][\w.]*))""")
_WITH_BODIES = {"RUN", "COPY", "ADD"}


@lru_cache(maxsize=2)
def _logical(escape: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a logical line and of the joints in it; the text must end in a newline."""
    joint = rf"[^\S\n]*{re.escape(escape)}[^\S\n]*\n(?:{_VOID})*"
    return re.compile(rf"(?:[^\n]*{re.escape(escape)}[^\S\n]*\n(?:{_VOID})*)*[^\n]*\n"), re.compile(joint)


def docker_instructions(source: str) -> list[tuple[str, str, int, int]]:
    """(instruction, value, start_line, end_line) of each instruction; a text without any gives none."""
    text = re.sub(r"\r\n?", "\n", source.removeprefix("\ufeff"))
    n_lines = text.count("\n") + (not text.endswith("\n"))
    text = text if text.endswith("\n") else text + "\n"
    head = _DIRECTIVES.match(text)[0]
    chosen = _ESCAPE.findall(head)
    logical, joint = _logical(chosen[-1] if chosen else "\\")
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda pos: bisect_right(breaks, pos - 1) + 1
    void, out, pos = re.compile(_VOID), [], 0
    while pos < len(text):
        if skip := void.match(text, pos):
            pos = skip.end()
            continue
        line = logical.match(text, pos)
        start, pos = pos, line.end()
        said = _WORD_AND_REST.match(joint.sub(" ", line[0]).rstrip("\n"))
        if said is None:
            continue
        word, value = said[1].upper(), said[2].strip()
        if word in _WITH_BODIES:
            for h in _SHELL.finditer(value):
                name = h["a"] or h["b"] or h["c"]
                if name:
                    end = re.compile(rf"^{chr(9) + '*' if h['strip'] else ''}{re.escape(name)}\n", re.M).search(text, pos)
                    pos = end.end() if end else len(text)
        out.append((word, value, line_of(start), min(n_lines, line_of(pos - 1))))
    return out


def _instruction_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(b, p, i, *r) for b, p, t in zip(pdf.branch_id, pdf.path, pdf.text) for i, r in enumerate(docker_instructions(t), 1)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSTRUCTIONS.split(", ")])


def instructions(files: DataFrame) -> DataFrame:
    """PRS7-PRS8: instructions of all Dockerfiles, with the schema INSTRUCTIONS; texts with NUL are binary and give none."""
    texts = sources(files, DOCKER_PATH).where(~F.contains("text", F.lit("\u0000")))
    return texts.mapInPandas(_instruction_batches, INSTRUCTIONS)


def _unquoted(c) -> F.Column:
    return F.regexp_replace(c, "[\"']", "")


def stages(rows: DataFrame) -> DataFrame:
    """PRS9: (branch_id, path, stage_no, base_image, name, start_line) of the FROM rows of ``instructions``; options are skipped."""
    words = F.filter(F.split(_unquoted(F.col("value")), r"\s+"), lambda w: (w != "") & ~w.startswith("--"))
    w = Window.partitionBy("branch_id", "path").orderBy("no")
    parts = rows.where("instruction = 'FROM'").select("branch_id", "path", "no", "start_line", words.alias("w")).where(F.size("w") > 0)
    name = F.when((F.size("w") >= 3) & (F.upper(F.get("w", F.lit(1))) == "AS"), F.get("w", F.lit(2)))
    return parts.select("branch_id", "path", F.row_number().over(w).alias("stage_no"), F.get("w", F.lit(0)).alias("base_image"), name.alias("name"), "start_line", "no")


def images(rows: DataFrame) -> DataFrame:
    """PRS9: (branch_id, path, images): what a Dockerfile takes from outside, in order and once.

    References are the bases of stages and ``--from`` of COPY and ADD. One that names an earlier stage of the file, in any case, is
    taken out by an anti-join on the name and the place; ``scratch`` is no base image and a number is a stage.
    """
    st = stages(rows)
    base = st.where(F.lower("base_image") != "scratch").select("branch_id", "path", "no", F.col("base_image").alias("ref"))
    option = _unquoted(F.regexp_extract("value", r"(?:^|\s)--from=(\S+)", 1))
    copied = rows.where("instruction in ('COPY', 'ADD')").select("branch_id", "path", "no", option.alias("ref")).where((F.col("ref") != "") & ~F.col("ref").rlike(r"^\d+$"))
    refs = base.unionByName(copied).withColumn("low", F.lower("ref"))
    named = st.where("name is not null").groupBy("branch_id", "path", F.lower("name").alias("low")).agg(F.min("no").alias("since"))
    outside = refs.join(named, ["branch_id", "path", "low"], "left").where(F.col("since").isNull() | (F.col("since") >= F.col("no")))
    once = outside.groupBy("branch_id", "path", "ref").agg(F.min("no").alias("no"))
    per_file = once.groupBy("branch_id", "path").agg(F.sort_array(F.collect_list(F.struct("no", "ref"))).alias("x"))
    return rows.select("branch_id", "path").distinct().join(per_file, ["branch_id", "path"], "left").select("branch_id", "path", F.coalesce(F.transform("x", lambda r: r["ref"]), F.array().cast("array<string>")).alias("images"))


def compose_services(text: str) -> list[tuple]:
    """PRS10: (service, image, build, depends_on, ports, start_line, end_line, code) of a Compose file.

    The node tree gives each service its lines, the values constructed from the same tree have anchors and merges resolved. Other YAML gives none.
    """
    try:
        import yaml

        loader = yaml.SafeLoader(text)
        tree = loader.get_single_node()
        under = {k.value: v for k, v in tree.value}.get("services")
        spans = {k.value: (k.start_mark.line, v.end_mark.index) for k, v in under.value}
        made = loader.construct_document(tree)["services"]
        found = [(name, s) for name, s in made.items() if isinstance(name, str) and isinstance(s, dict)]
    except Exception:  # noqa: BLE001 - whatever the YAML reader says, such a file has no services
        return []
    plain = lambda x: x if isinstance(x, str) or x is None else json.dumps(x, sort_keys=True, default=str)
    each = lambda x: [plain(y) for y in x] if isinstance(x, (list, dict)) else []
    lines, out = text.splitlines(), []
    for name, s in found:
        first, last, code = None, None, None
        if name in spans:
            first, stop = spans[name]
            last = min(len(lines), max(first + 1, len(text[:stop].rstrip().splitlines())))
            first, code = first + 1, "\n".join(lines[first:last])
        out.append((name, plain(s.get("image")), plain(s.get("build")), each(s.get("depends_on")), each(s.get("ports")), first, last, code))
    return out


def _service_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SERVICES.split(", ")]
    for pdf in batches:
        rows = [(b, p, *r) for b, p, t in zip(pdf.branch_id, pdf.path, pdf.text) for r in compose_services(t)]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"start_line": "Int32", "end_line": "Int32"})


def services(files: DataFrame) -> DataFrame:
    """PRS10: services of all Compose files, with the schema SERVICES."""
    return sources(files, COMPOSE_PATH).mapInPandas(_service_batches, SERVICES)
