"""The analysis of scanned files, as ``files.analysis`` has it, from their text (SRC2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import language
from codeloom.sources import docker, lexical

ANALYSED = (
    "branch_id string, path string, raw_text string, functions array<struct<name: string, code: string, start_line: int, end_line: int>>, classes array<string>, "
    "class_locations map<string, struct<start_line: int, end_line: int>>, blocks array<struct<type: string, name: string, code: string, start_line: int, end_line: int>>"
)


def analyse(path: str, lang: str | None, text: str) -> tuple[list[dict], list[str], dict, list[dict]]:
    """(functions, classes, class_locations, blocks) of one file; a file that no parser reads has none."""
    if re.search(docker.DOCKER_PATH, path):
        lines = text.removeprefix("\ufeff").splitlines()
        name = lambda word, value: f"{word} {value.splitlines()[0] if value else ''}".rstrip()
        return [], [], {}, [{"type": "docker_instruction", "name": name(w, v), "code": "\n".join(lines[a - 1 : z]), "start_line": a, "end_line": z} for w, v, a, z in docker.docker_instructions(text)]
    if re.search(docker.COMPOSE_PATH, path):
        return [], [], {}, [{"type": "docker_service", "name": n, "code": c, "start_line": a, "end_line": z} for n, *_, a, z, c in docker.compose_services(text) if c is not None]
    items = lexical.extract(lang, text) if lang else []
    functions = [{"name": n, "code": c, "start_line": a, "end_line": z} for k, n, c, a, z in items if k == "function"]
    classes = {n: {"start_line": a, "end_line": z} for k, n, _, a, z in items if k == "class"}
    return functions, list(classes), classes, []


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(b, p, t, *analyse(p, la, t)) for b, p, la, t in zip(pdf.branch_id, pdf.path, pdf.language, pdf.raw_text)]
        yield pd.DataFrame(rows, columns=["branch_id", "path", "raw_text", "functions", "classes", "class_locations", "blocks"])


def analysed(files: DataFrame) -> DataFrame:
    """(branch_id, path, analysis) of files (branch_id, path, raw_text); without a text there is no analysis."""
    rows = files.where(F.col("raw_text").isNotNull()).select("branch_id", "path", language(F.col("path")).alias("language"), "raw_text")
    return rows.mapInPandas(_batches, ANALYSED).select("branch_id", "path", F.struct("functions", "classes", "class_locations", "blocks", "raw_text").alias("analysis"))


def empty_analysis() -> F.Column:
    """SRC6: the analysis of a file that no parser reads."""
    kind = "struct<functions: array<struct<name: string, code: string, start_line: int, end_line: int>>, classes: array<string>, imports: array<string>, graph: map<string, array<string>>, raw_text: string>"
    return F.from_json(F.lit('{"functions": [], "classes": [], "imports": [], "graph": {}, "raw_text": ""}'), kind)
