"""Source files that do not parse (problem 2).

Files are lexed into rows, one per statement or bracket content, with a letter per token. Rows with a pair of adjacent letters that no production
permits are found by an anti-join; prefix sums in windows over each file's brackets check nesting, the distinct rows are reduced to statement productions, and windows over each file's rows check what a statement
must follow or be followed by. Python and JSON files found so are confirmed by an exact parser.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import grammar
from codeloom.session import materialize, table

LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".json": "json"}
ROW_SCHEMA = "file_id string, lang string, frame int, no int, ctx string, kinds string"

_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[a-zA-Z]{0,3}(?![\w])"
_DQ, _SQ = r'"(?:\\(?:\r\n|[\s\S])|[^"\\\n])*"', r"'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'"
_IDENT = r"[^\W\d][\w$]*|\$[\w$]*"


def _lexer(comment: str, string: str, number: str, ops: str) -> re.Pattern:
    return re.compile(rf"[ \t\r\f﻿]*(?:(?P<nl>\n)|(?P<c>{comment})|(?P<s>{string})|(?P<d>{number})|(?P<n>{_IDENT})|(?P<b>[(\[{{)\]}}])|(?P<o>{ops})|(?P<x>[^\s]))")


_JS_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n>+])|(?<=[=(,:\[!&|?{};>+] ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|(?<=return) /(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_REGEX_HERE = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = r"`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"
_LEXERS = {
    "javascript": _lexer(_COMMENT + r"|(?<![\s\S])#![^\n]*", f"{_DQ}|{_SQ}|{_TEMPLATE}|{_JS_REGEX}", _NUMBER, r"\.\.\.|=>|\?\.(?!\d)|\+\+|--|\*\*=|>>>=|<<=|>>=|\?\?=|&&=|\|\|=|===|!==|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||\?\?|\*\*|<<|[-+*/%&|^~!<>=?:;,.@#]"),
    "java": _lexer(_COMMENT, rf'"""[\s\S]*?"""|{_DQ}|{_SQ}', _NUMBER, r"\.\.\.|->|::|\+\+|--|>>>=|<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||<<|[-+*/%&|^~!<>=?:;,.@]"),
    "go": _lexer(_COMMENT, rf"{_DQ}|{_SQ}|`[^`]*`", _NUMBER, r"\.\.\.|:=|<-|\+\+|--|<<=|>>=|&\^=|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||<<|>>|&\^|[-+*/%&|^~!<>=?:;,.]"),
    "python": _lexer(r"#[^\n]*|\\\r?\n", rf"""(?:[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|{_DQ}|{_SQ})""", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[jJ]?(?![\w])", r"\.\.\.|:=|->|\*\*=|//=|<<=|>>=|[-+*/%&|^@]=|==|!=|<=|>=|//|\*\*|<<|>>|[-+*/%&|^~<>=:;,.@]"),
    "json": _lexer(r"(?!)", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"[:,]"),
}
_LEXERS["typescript"] = _LEXERS["javascript"]

_OPS = {"...": "R", "=>": "A", "->": "A", "?.": "U", "++": "I", "--": "I", "=": "=", "+": "+", "-": "+", "*": "*", "&": "&", "|": "|", "<": "<", ">": ">", "!": "!", "~": "!", "?": "?", ":": ":", ";": ";",
        ",": ",", ".": ".", "@": "@", "#": "#", "::": "M", ":=": "~", "<-": "R"}
_BY_LANG = {"go": {"...": "L"}, "python": {"->": "R", "...": "n", "**": "k", "!": "`", "?": "`"}}
_CONSTANTS = {"json": {"true", "false", "null"}}
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Tokens after which a line end ends a statement, and before which it may.
_ASI_ENDS = set("nsdphaQozBIVrZguLwKe")
_ASI_BEGINS = set("nsdNPmXfCiFWOSrtTvVZguLwKejJ@!Icl D".replace(" ", ""))
_GO_ENDS = set("ndsphaQozBIVr")


_ALIKE = re.compile(r"((?:[sdnoapQz]|\+d|[snd]:[sdnoapQz]),)\1{2,}")


class _Rows:
    """Collects the rows of one file; a frame is a bracket's content or a block's statements."""

    def __init__(self, lang: str):
        self.lang, self.rows, self.frames, self.brackets = lang, [], 0, []

    def closed(self, tokens=()) -> list[tuple[int, int, str, str]] | None:
        """The rows, with one more for all brackets of the file; of the tokens that are left where a bracket did not match, the brackets count too. None if one of those is illegal."""
        for m in tokens:
            if m.lastgroup == "x":
                return None
            if m.lastgroup == "b":
                self.brackets.append(m["b"])
        if self.brackets:
            self.rows.append((-1, len(self.rows), "#", "".join(self.brackets)))
        return self.rows

    def new(self) -> int:
        self.frames += 1
        return self.frames - 1

    def add(self, frame: int, ctx: str, kinds: str) -> None:
        # Lists of like elements are cut to two, which changes neither the pairs nor the productions.
        self.rows.append((frame, len(self.rows), ctx, _ALIKE.sub(r"\1\1", kinds)))


def _op(lang: str, t: str) -> str:
    own = _BY_LANG.get(lang, {})
    if t in own:
        return own[t]
    if t in _OPS:
        return _OPS[t]
    return "E" if t[-1] == "=" and t not in ("==", "===", "!=", "!==", "<=", ">=") else "b"


#: How a Java type's declaration begins.
_DECLARED = re.compile(r"(?:@n(?:\.n)*[ph]?|[gw]|n\+g)*@?[CJw]n")
_CONSTANT = re.compile(r"(?:n[ph]?[oz]?,)*n[ph]?[oz]?$")


def _brace(lang: str, cur: str, ctx: str, constants: bool = False) -> str:
    """The context of a brace's content, from what stands before it."""
    last = cur[-1:]
    if lang == "json":
        return "o"
    if lang == "java":
        if re.search(r"S[ph]$", cur):
            return "w"
        if re.match(r"(?:@n(?:\.n)*[ph]?|g)*wn(?:<[^;{]*?>)?[ph](?:x.*)?$", cur):
            return "R"
        if re.match(r"(?:[gw@.n]|[ph])*Jn", cur) and "=" not in cur:
            return "J"
        if ctx == "J" and constants and _CONSTANT.match(cur):
            return "C"
        if re.search(r"(?:^|[gwA@)phn;])*[Cw]n(?:<[^;{]*)?[ph]?(?:x.*)?$", cur) and "C" in cur or re.search(r"N[nY].*[ph]$", cur) and "=" not in cur[cur.rfind("N"):]:
            return "C"
        if last and last in "=aQ,(D" or (ctx in "opa" and last in ("", ",")):
            return "o"
        return "s"
    if lang == "go":
        if last == "C":
            return "C"
        if last == "j":
            return "j"
        if re.match(r"S", cur) and not re.search(r"(?:Q|a|Ma)n?$", cur):
            return "w"
        if re.match(r"(?:n:)?[iF]|.*l$|.*li", cur) and not re.search(r"(?:Q|Ma|a)\**n(?:\.n)?$", cur) and ctx in "sw":
            return "s"
        if re.search(r"f(?:[ph])?n?a?[ph](?:[*QaMRH]*n?(?:\.n)?a?|p)?$", cur) and "f" in cur:
            return "s"
        if cur == "" and ctx in "sw":
            return "s"
        return "o"
    if re.search(r"S[p]$", cur):
        return "w"
    if re.search(r"f\*?[nZguLwKe]?(?:<[^<>]*>)?[ph]$", cur):
        return "s"
    if re.search(r"C[nguweKLZ]?(?:<.*)?(?:x.*)?$", cur) and "C" in cur and not re.search(r"C[^x]*[oz]$", cur):
        return "C"
    if lang == "typescript" and re.search(r"j.[^=]*$", cur):
        return "j"
    if lang == "typescript" and re.search(r"J.$", cur):
        return "J"
    if re.match(r"(?:m|X)w?(?:n,)?$", cur):
        return "M"
    if last in ("A", "T", "y", "l", "O", "k") or (cur == "" and ctx in "swC") or (cur == "g" and ctx == "C"):
        return "s"
    if re.search(r"(?:^|[^=(,:?b+*&|<>!A])[ph]$", cur) and (re.search(r"f\*?.?(?:<.*>)?[ph]$|[iFWk][ph]$|FPp$", cur) or (ctx in "Co" and re.search(r"[nZguLwKefCxilFWOScDrtTkyvNPqmXVjJsda][?!]?(?:<.*>)?[ph]$", cur))):
        return "s"
    if lang == "typescript" and re.search(r"[ph]:[^;{]*[nsoaQz>d]$", cur) and ("f" in cur or ctx in "Co"):
        return "s"
    if lang == "typescript" and re.match(r"X?w+(?:n(?:\.n)*|s)$", cur):
        return "s"
    if re.search(r"n:$", cur) and ctx in "sw" and cur.count(":") == 1 and "?" not in cur and not cur.startswith("v"):
        return "s"
    return "o"


#: Constants of an enum, of which one stands for all before it.
_CONSTANTS_SO_FAR = re.compile(r"^(?:n[ph]?[oz]?,)+")


def _element(cur: str) -> str:
    """The element of a list that is being read, with the comma before it; the others say nothing about it."""
    tail = cur[max(0, cur.rfind(",")) :]
    return cur if ">" in tail and "<" not in tail else tail


def _inserted(template: str) -> list[str]:
    """The expressions that a template string inserts, of any depth."""
    out, at = [], 0
    while (at := template.find("${", at)) >= 0:
        if (len(template[:at]) - len(template[:at].rstrip("\\"))) % 2:
            at += 2
            continue
        depth, end = 1, at + 2
        while end < len(template) and depth:
            depth += {"{": 1, "}": -1}.get(template[end], 0)
            end += 1
        out.append(template[at + 2 : end - 1])
        at = end
    return out


def lex_braces(lang: str, text: str, top: str | None = None, out: _Rows | None = None) -> list[tuple[int, int, str, str]] | None:
    """Rows of a file in a language with braces, the last with its brackets; None where a character is illegal, as an unclosed literal's is. From a bracket that does not match on, only brackets are read."""
    inside = out is not None
    out, keywords = out or _Rows(lang), grammar.KEYWORDS[lang]
    top = top or {"java": "t", "go": "t", "json": "t"}.get(lang, "s")
    # A frame: [bracket, context, letters so far, number, statement-like, whether it has rows, length at which lists are cut next]
    stack = [["", top, "", out.new(), top != "c", False, 64]]
    nl = False
    constants = _CONSTANTS.get(lang)
    asi = lang in ("javascript", "typescript")

    def end(f) -> None:
        if f[2]:
            out.add(f[3], f[1], f[2])
            f[2], f[5] = "", True

    tokens = _LEXERS[lang].finditer(text)
    while m := next(tokens, None):
        kind = m.lastgroup
        f = stack[-1]
        if asi and kind == "o" and m["o"] in ("/", "/=") and re.search(r"(?:^|l)[iFW]P?p$|[FW]p$", f[2]) and f[4]:
            # Behind the head of a statement a slash begins a pattern.
            if literal := _REGEX_HERE.match(text, m.start("o")):
                f[2] += "s"
                tokens = _LEXERS[lang].finditer(text, literal.end())
                continue
        if kind == "nl":
            if lang == "go" and f[2] and f[2][-1] in _GO_ENDS:
                if f[4]:
                    if not (f[1] in "sw" and re.match(r"(?:n:)?[iFS][^B]*;$", f[2])):
                        end(f)
                else:
                    f[2] += ";"
            nl = True
            continue
        if kind == "c":
            if "\n" in m["c"]:
                nl = True
            continue
        t = m[kind]
        if kind == "n":
            k = keywords.get(t, "n")
            if f[2][-1:] in (".", "U") and k not in "C":
                k = "n"
            if constants is not None and t not in constants:
                k = "`"
        elif kind == "o":
            k = _op(lang, t)
            if k == "#":
                k = "" if asi else "`"
        elif kind == "b":
            k = t
        elif kind == "x":
            return None
        else:
            k = kind
            if asi and k == "s" and t[0] == "`" and "${" in t:
                for inner in _inserted(t):
                    if inner.strip() and lex_braces(lang, inner, "c", out) is None or not inner.strip():
                        return None
        if asi and nl and f[4] and f[2] and f[2][-1] in _ASI_ENDS and k in "nsdNPmXfCiFWOSrtTvVZguLwKejJ@cDl{" and k:
            if f[1] == "C" or not re.search(r"(?:^|l)(?:ip|l)$|(?<!B)[FW]p$|^@.*$", f[2]):
                if not (k == "{" and (re.search(r"[ph]$|[A]$", f[2]) or re.match(r"[XwgDj]*[Cj]", f[2]))):
                    end(f)
        nl = False
        if kind != "b":
            # A block that ended a statement.
            f[2] += k
            if k == "," and len(f[2]) >= f[6]:
                f[2] = _CONSTANTS_SO_FAR.sub("n,", f[2]) if lang == "java" and f[1] == "J" and not f[5] else _ALIKE.sub(r"\1\1", f[2])
                f[6] = max(64, 2 * len(f[2]))
            if f[4]:
                if k == ";":
                    if not (lang == "go" and re.match(r"(?:n:)?[iFS][^B]*;$", f[2])):
                        end(f)
                elif k == ":" and f[1] == "w" and re.match(r"[cD]", f[2]) and f[2].count("?") < f[2].count(":"):
                    end(f)
                elif k == "," and f[1] in ("j",):
                    end(f)
            continue
        out.brackets.append(t)
        if t in "([{":
            if t == "{":
                ctx = _brace(lang, f[2] if f[4] else _element(f[2]), f[1], lang == "java" and f[1] == "J" and not f[5])
            elif t == "(":
                c = f[2]
                ctx = "p"
                if lang in ("javascript", "typescript", "java"):
                    if c[-1:] in ("i", "W", "S") and f[1] in "sw" or c[-1:] == "W":
                        ctx = "c"
                    elif c[-1:] == "F" or c.endswith("FP"):
                        ctx = "F"
                    elif lang == "java" and c[-1:] == "k":
                        ctx = "k"
                    elif lang == "java" and c[-1:] == "T":
                        ctx = "T"
                elif lang == "go" and f[1] in "tsw" and c in ("m", "v", "w"):
                    ctx = {"m": "m", "v": "v", "w": "W"}[c]
            else:
                ctx = "a"
            stack.append([t, ctx, "", out.new(), t == "{" and ctx in ("swCjJR" if lang == "java" else "swCj") or ctx in "mvW" and t == "(", False, 64])
            continue
        if f[0] != _CLOSE[t] or len(stack) == 1:
            return None if inside else out.closed(tokens)
        empty = not f[2] and not f[5]
        if f[2]:
            body = f[2]
            if lang == "go" and not f[4] and body.endswith(";"):
                # Go's automatic semicolon: a comma was needed, but for a single value there is none to need.
                body = body if f[1] in ("o",) or t in ")]" else body[:-1]
            f[2] = body
            end(f)
        stack.pop()
        up = stack[-1]
        if t == ")":
            up[2] += "h" if empty else "p"
        elif t == "]":
            up[2] += "Q" if empty else "a"
        else:
            letter = "B" if f[1] == "s" or (lang == "go" and f[1] == "w") else ("z" if empty else "o")
            up[2] += letter
            if up[4]:
                c = up[2]
                if lang == "go":
                    pass
                elif f[1] == "s" and not re.search(r"[A]B$|f\*?[^;]*B$", c) or (f[1] == "s" and asi and re.match(r"[XDwZ]*f\*?[^=(]*B$", c)) or (f[1] == "s" and up[1] == "C"):
                    if not (c.endswith("OB") or (asi and "=" in c and up[1] != "C") or re.search(r"N[nY].*B$", c)):
                        end(up)
                elif lang == "java" and up[1] == "J" and _CONSTANT.match(c):
                    pass
                elif f[1] in "CjJR" and (lang == "java" and _DECLARED.match(c) or not re.search(r"[=(,:?r]", c[:-1]) and not re.search(r"N", c)):
                    end(up)
                elif f[1] == "w" and re.match(r"(?:n:)?S[ph]", c):
                    end(up)
    if len(stack) == 1:
        end(stack[0])
    elif inside:
        return None
    return out.rows if inside else out.closed()


def lex_python(text: str) -> list[tuple[int, int, str, str]] | None:
    """Rows of a Python file: logical lines by block, bracket contents, and all brackets; None where a character is illegal, as an unclosed literal's is, or indentation does not match."""
    out, keywords = _Rows("python"), grammar.KEYWORDS["python"]
    blocks = [(0, out.new())]
    stack: list[list] = []
    line, indent, fresh, opened = "", 0, True, False
    pos = 0

    def end_line() -> bool:
        nonlocal line, opened
        if not line:
            return True
        width, frame = blocks[-1]
        if opened:
            if indent <= width:
                return False
            blocks.append((indent, out.new()))
        else:
            while indent < blocks[-1][0]:
                blocks.pop()
            if indent != blocks[-1][0]:
                return False
        out.add(blocks[-1][1], "s", line)
        opened = line.endswith(":")
        line = ""
        return True

    tokens = _LEXERS["python"].finditer(text)
    for m in tokens:
        kind = m.lastgroup
        if kind == "nl":
            if not stack:
                if not end_line():
                    return None
                fresh = True
            continue
        if kind == "c":
            continue
        if kind == "x":
            return None
        t = m[kind]
        if fresh and not stack:
            start = text.rfind("\n", 0, m.start(kind)) + 1
            lead = text[start : m.start(kind)]
            indent = len(lead.expandtabs(8).replace("\f", "").replace("\r", "").replace("﻿", ""))
            fresh = False
        if kind == "b":
            out.brackets.append(t)
            if t in "([{":
                stack.append([t, "", out.new()])
            else:
                if not stack or stack[-1][0] != _CLOSE[t]:
                    return out.closed(tokens)
                b, inner, frame = stack.pop()
                if inner:
                    out.add(frame, {"(": "p", "[": "a", "{": "o"}[b], inner)
                letter = {"(": "ph", "[": "aQ", "{": "oz"}[b][not inner]
                if stack:
                    stack[-1][1] += letter
                else:
                    line += letter
            continue
        if kind == "n":
            k = keywords.get(t, "n")
            before = stack[-1][1] if stack else line
            if before.endswith("."):
                k = "n" if k == "n" else k if k == "m" and before.startswith("u") else "`"
        elif kind == "o":
            k = _op("python", t)
        else:
            k = kind
        if stack:
            stack[-1][1] += k
        else:
            line += k
    del pos
    if not stack and (not end_line() or opened):
        return None
    return out.closed()


def lex(lang: str, text: str) -> list[tuple[int, int, str, str]] | None:
    return lex_python(text) if lang == "python" else lex_braces(lang, text)


def parses_exactly(lang: str, text: str) -> bool:
    """The verdict of an exact parser, for the languages that have one here."""
    text = text.removeprefix("﻿")
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                # What is no error of grammar but of a later pass counts as syntax too (a return outside a function).
                compile(text, "<file>", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
        else:
            json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _lex_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for fid, lang, text in zip(pdf.file_id, pdf.lang, pdf.text):
            found = lex(lang, text)
            if found is None:
                rows.append((fid, lang, 0, 0, "!", "illegal"))
            elif not found and lang in ("json", "go"):
                rows.append((fid, lang, 0, 0, "!", "empty"))
            elif found and lang == "go" and not found[0][3].startswith("K") and not found[0][2] != "t":
                rows.append((fid, lang, 0, 0, "!", "package"))
            else:
                rows += [(fid, lang, *r) for r in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW_SCHEMA.split(", ")])


def _production_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bad = [not grammar.holds(la, c, k) for la, c, k in zip(pdf.lang, pdf.ctx, pdf.kinds)]
        yield pdf[bad]


def _exact_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [la not in ("python", "json") or not parses_exactly(la, t) for la, t in zip(pdf.lang, pdf.text)]
        yield pdf.loc[ok, ["file_id", "lang"]]


def claimed_sources(files: DataFrame) -> DataFrame:
    """(file_id, lang, text) of files that claim one of LANGUAGES by the end of their path; a null text counts as empty."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    lang = F.coalesce(*[F.when(suffix == s, F.lit(x)) for s, x in LANGUAGES.items()])
    rows = files.where(F.col("analysis").isNotNull() & F.col("id").isNotNull() & F.col("path").isNotNull())
    return rows.select(F.col("id").alias("file_id"), lang.alias("lang"), F.coalesce("analysis.raw_text", F.lit("")).alias("text")).where(F.col("lang").isNotNull())


#: Passes that take inner pairs of brackets away before what is left is looked at bracket by bracket.
_BRACKET_PASSES = 8


def nesting_errors(rows: DataFrame) -> DataFrame:
    """(file_id, lang) of files whose brackets do not nest, from rows (file_id, lang, kinds) with all brackets of a file.

    Pairs with nothing between are taken away in passes, all at once. Of what is left, prefix sums in a window over the file give each bracket its level; the sum may not fall
    below zero and must end there, and of each level every closing bracket must follow its own opening one.
    """
    inner = lambda s: F.regexp_replace(s, r"\(\)|\[\]|\{\}", "")
    left = rows.select("file_id", "lang", F.aggregate(F.sequence(F.lit(1), F.lit(_BRACKET_PASSES)), F.col("kinds"), lambda s, _: inner(s)).alias("k")).where("k <> ''").dropDuplicates(["file_id"])
    each = left.select("file_id", "lang", F.posexplode(F.split("k", "")).alias("pos", "c")).where("c <> ''")
    opens = F.col("c").isin("(", "[", "{")
    w = Window.partitionBy("file_id").orderBy("pos")
    at = each.withColumn("d", F.sum(F.when(opens, 1).otherwise(-1)).over(w)).withColumn("level", F.when(opens, F.col("d")).otherwise(F.col("d") + 1))
    paired = at.withColumn("p", F.lag("c").over(Window.partitionBy("file_id", "level").orderBy("pos")))
    wrong = F.when(opens, F.lit(False)).otherwise(~F.concat(F.coalesce("p", F.lit("")), "c").isin("()", "[]", "{}"))
    per_file = paired.groupBy("file_id", "lang").agg(F.max(wrong).alias("wrong"), F.min("d").alias("least"), F.max_by("d", "pos").alias("end"))
    return per_file.where("wrong or least < 0 or end <> 0").select("file_id", "lang")


def _sequence_errors(rows: DataFrame) -> DataFrame:
    """(file_id, lang) of files where a statement does not follow, or is not followed by, what it needs."""
    statements = rows.where(F.col("ctx").isin("s", "w") & F.col("lang").isin("python", "javascript", "typescript", "java")).select("file_id", "lang", "frame", "no", F.substring("kinds", 1, 3).alias("k"), F.expr("right(kinds, 1)").alias("z"))
    # A row delivered twice would be its own neighbour. Spread as the window needs it, so that the rows move once.
    statements = statements.repartition("file_id", "frame").dropDuplicates(["file_id", "frame", "no"])
    w = Window.partitionBy("file_id", "frame").orderBy("no")
    s = statements.withColumn("p", F.coalesce(F.lag("k").over(w), F.lit(""))).withColumn("q", F.coalesce(F.lead("k").over(w), F.lit("")))
    one = lambda c: F.substring(c, 1, 1)
    k, p, q = one("k"), one("p"), one("q")
    py = F.col("lang") == "python"
    closes = F.when(py, q.isin("X", "y")).otherwise(q.isin("k", "y"))
    bad_py = (
        ((k == "T") & ~closes)
        | ((k == "X") & ~p.isin("T", "X"))
        | ((k == "y") & ~p.isin("T", "X", "l"))
        | ((k == "l") & ~p.isin("i", "e", "F", "W", "X", "Z"))
        | ((k == "e") & ~p.isin("i", "e"))
        | ((k == "@") & ~(q.isin("@", "f", "C") | F.col("q").startswith("Zf")))
    )
    bad = (
        ((F.col("k") == "TB") & ~closes)
        | (k.isin("k") & ~p.isin("T", "k"))
        | (k.isin("y") & ~p.isin("T", "k"))
        | ((k == "l") & ~(p.isin("i", "l", "F", "W") | (F.col("lang") != "java") & (p == "n")))
    )
    return s.where(F.when(py, bad_py).otherwise(bad)).select("file_id", "lang").distinct()


def unparsable_files(files: DataFrame) -> DataFrame:
    """(file_id, lang) of the files whose text is not valid source of the language their path claims, once each.

    Files without analysis and of other languages have no row. An empty text is valid Python, JavaScript, TypeScript and Java, and invalid JSON and Go.
    Repeated rows count once. The distinct strings of letters are few, since names are abstracted, so they are aggregated before they are judged.
    """
    spark = files.sparkSession
    sources = claimed_sources(files)
    rows = materialize(sources.mapInPandas(_lex_batches, ROW_SCHEMA), "syntax-rows")
    shapes = rows.where(~F.col("ctx").isin("!", "#")).select("lang", "ctx", "kinds").distinct()
    # Adjacent pairs, each once per string.
    pairs = shapes.where(F.length("kinds") >= 2).select("lang", "ctx", "kinds", F.explode(F.array_distinct(F.regexp_extract_all("kinds", F.lit("(?=(..))."), F.lit(1)))).alias("pair"))
    permitted = spark.createDataFrame(pd.DataFrame(grammar.permissible_pairs(), columns=["lang", "ctx", "pair"]))
    impossible = pairs.join(F.broadcast(permitted), ["lang", "ctx", "pair"], "left_anti").select("lang", "ctx", "kinds").distinct()
    # The strings are few bytes but costly each, so they are spread by number, not by size.
    wrong = shapes.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(_production_batches, "lang string, ctx string, kinds string")
    bad = impossible.unionByName(wrong).distinct()
    by_shape = rows.join(bad, ["lang", "ctx", "kinds"], "left_semi").select("file_id", "lang")
    illegal = rows.where(F.col("ctx") == "!").select("file_id", "lang")
    nesting = nesting_errors(rows.where(F.col("ctx") == "#"))
    suspects = by_shape.unionByName(illegal).unionByName(nesting).unionByName(_sequence_errors(rows)).distinct()
    # The exact parsers see only what was found.
    texts = sources.join(suspects.select("file_id").distinct(), "file_id", "left_semi")
    return texts.mapInPandas(_exact_batches, "file_id string, lang string").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable_files(table(spark, sf_dir, "files")).select("file_id").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository_id, lang, n_files, n_bad, rate) per repository and language."""
    files = table(spark, sf_dir, "files")
    bad = unparsable_files(files).select("file_id", F.lit(1).alias("bad"))
    repo = table(spark, sf_dir, "branches").select(F.col("id").alias("branch_id"), "repository_id").distinct()
    where = files.select(F.col("id").alias("file_id"), "branch_id").distinct()
    all_files = claimed_sources(files).select("file_id", "lang").distinct().join(where, "file_id").join(repo, "branch_id", "left").join(bad, "file_id", "left")
    return all_files.groupBy("repository_id", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_bad")).withColumn("rate", F.round(F.col("n_bad") / F.col("n_files"), 6))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
