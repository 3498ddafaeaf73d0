"""Functions, classes and imports of languages without a grammar here (PRS1-PRS6), by their declarations.

Strings and comments are blanked, declarations are found by a pattern per language, and a body ends at its matching brace, or at ``end`` in Ruby.
Python is parsed exactly (see ``code``). Nested functions come out too; a declaration in a string or comment does not.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import language

_C = r"//[^\n]*|/\*[\s\S]*?\*/"
_S = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|synchronized|export|default|inline|unsafe|extern|const|partial|readonly)\s+)*"
_TYPE = r"\w[\w<>\[\],.?*&: \t]{0,120}?"
_NOT = r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|new\b|throw\b|do\b|sizeof\b|using\b|lock\b|foreach\b)"
_JS_FN = rf"{_MODS}function\s*\*?\s*(?P<a>\w+)\s*[(<]|(?:const|let|var)\s+(?P<b>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)|^[ \t]+{_MODS}(?:get\s+|set\s+)?{_NOT}(?P<c>\w+)\s*\([^()\n]*\)\s*(?::[^={{\n]+)?\{{"
#: Comments and strings, functions, classes, imports of each language.
LANGUAGES = {
    "javascript": (_C + "|" + _S + r"|`(?:\\.|[^`\\])*`", _JS_FN, r"\bclass\s+(?P<a>\w+)", r"^[ \t]*import\b[^;\n]*;?|\brequire\([^)\n]*\)"),
    "typescript": (_C + "|" + _S + r"|`(?:\\.|[^`\\])*`", _JS_FN, r"\b(?:class|interface)\s+(?P<a>\w+)", r"^[ \t]*import\b[^;\n]*;?|\brequire\([^)\n]*\)"),
    "go": (_C + r"|`[^`]*`|" + _S, r"^func\s*(?:\([^)\n]*\)\s*)?(?P<a>\w+)\s*[\[(]", r"^\s*(?:type\s+)?(?P<a>\w+)\s+(?:struct|interface)\b", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"[^\"\n]+\"\s*$"),
    "rust": (_C + r"|\"(?:\\.|[^\"\\])*\"", r"\bfn\s+(?P<a>\w+)", r"\b(?:struct|enum|trait)\s+(?P<a>\w+)", r"^\s*(?:pub\s+)?use\s+[^;]+;"),
    "java": (_C + "|" + _S, rf"^[ \t]++(?:@\w+\s+)*{_MODS}(?:<[^>\n]+>\s+)?(?:{_TYPE}[ \t]++)?{_NOT}(?P<a>\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{{", r"\b(?:class|interface|enum)\s+(?P<a>\w+)", r"^\s*import\s+[^;]+;"),
    "c": (_C + "|" + _S, rf"^{_MODS}{_TYPE}\b{_NOT}(?P<a>\w+)\s*\([^();]*\)\s*\{{", r"\bstruct\s+(?P<a>\w+)\s*\{", r"^\s*#\s*include\s+\S+"),
    "cpp": (_C + "|" + _S, rf"^\s*{_MODS}{_TYPE}\b{_NOT}(?P<a>~?\w+)\s*\([^();]*\)\s*(?:const\s*)?(?:override\s*)?\{{", r"\b(?:class|struct)\s+(?P<a>\w+)", r"^\s*#\s*include\s+\S+"),
    "ruby": (r"#[^\n]*|" + _S, r"^\s*def\s+(?:self\.)?(?P<a>\w+[?!=]?)", r"^\s*(?:class|module)\s+(?P<a>[\w:]+)", r"^\s*require(?:_relative)?\s+\S+"),
    "php": (_C + r"|#[^\n]*|" + _S, r"\bfunction\s+&?(?P<a>\w+)\s*\(", r"\b(?:class|interface|trait)\s+(?P<a>\w+)", r"^\s*use\s+[^;]+;"),
    "csharp": (_C + "|" + _S, rf"^[ \t]++{_MODS}(?:{_TYPE}[ \t]++)?{_NOT}(?P<a>\w+)\s*\([^()]*\)\s*(?::\s*\w+\([^)]*\)\s*)?\{{", r"\b(?:class|interface|struct|record)\s+(?P<a>\w+)", r"^\s*using\s+[^;=(]+;"),
}
LANGUAGES["tsx"] = LANGUAGES["typescript"]
_COMPILED = {k: (re.compile(v[0]), *(re.compile(x, re.M) for x in v[1:])) for k, v in LANGUAGES.items()}

ITEMS = "branch_id string, path string, kind string, name string, code string, start_line int, end_line int"


def _body_end(lang: str, blank: str, at: int) -> int:
    """Where the declaration that begins at ``at`` ends."""
    if lang == "ruby":
        indent = re.match(r"[ \t]*", blank[blank.rfind("\n", 0, at) + 1 :])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(blank, at)
        return m.end() if m else len(blank)
    opened = blank.find("{", at)
    line_end = blank.find("\n", at)
    line_end = len(blank) if line_end < 0 else line_end
    if opened < 0 or (opened > line_end and ";" in blank[at:opened]):
        return line_end
    depth = 0
    for m in re.compile(r"[{}]").finditer(blank, opened):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(blank)


def extract(lang: str, source: str) -> list[tuple]:
    """(kind, name, code, start_line, end_line) in the order of the text."""
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        lines, out = source.split("\n"), []
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)):
                kind = "class" if isinstance(n, ast.ClassDef) else "import" if isinstance(n, (ast.Import, ast.ImportFrom)) else "function"
                code = "\n".join(lines[n.lineno - 1 : n.end_lineno])[n.col_offset :]
                out.append((kind, code if kind == "import" else n.name, code, n.lineno, n.end_lineno))
        return sorted(out, key=lambda r: (r[3], r[0]))
    if lang not in _COMPILED:
        return []
    hide, fn, cls, imp = _COMPILED[lang]
    blank = hide.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line = lambda at: source.count("\n", 0, at) + 1
    out = []
    for kind, rx in (("function", fn), ("class", cls)):
        for m in rx.finditer(blank):
            name = next(g for g in m.groups() if g)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = _body_end(lang, blank, start)
            out.append((kind, name, source[start:end], line(start), line(max(start, end - 1))))
    comments = re.compile(_C)
    text = comments.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source) if lang != "ruby" else source
    for m in imp.finditer(text):
        s = m[0].strip()
        out.append(("import", s, s, line(m.start() + len(m[0]) - len(m[0].lstrip())), line(m.end() - 1)))
    return sorted(out, key=lambda r: (r[3], r[0]))


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(b, p, *r) for b, p, la, t in zip(pdf.branch_id, pdf.path, pdf.language, pdf.text) for r in extract(la, t)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])


def items(files: DataFrame) -> DataFrame:
    """All declarations and imports of the files in a known language, each (branch_id, path) once."""
    rows = files.where(F.col("analysis.raw_text").isNotNull()).select("branch_id", "path", language(F.col("path")).alias("language"), F.col("analysis.raw_text").alias("text"))
    return rows.where(F.col("language").isNotNull()).dropDuplicates(["branch_id", "path"]).mapInPandas(_batches, ITEMS)
