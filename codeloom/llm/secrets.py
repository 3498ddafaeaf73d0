"""Credentials embedded in source code (problem 4).

A text is searched by a multi-pattern automaton for words and prefixes that stand near
credentials; only lines it names are looked at. In these, literals in assignment contexts (assignments,
mappings, command line options, login calls, headers, comments, URLs with a login) are judged: a literal is segmented into
dictionary words by Viterbi, and what no word explains is its residual. Long residuals are secrets,
known hash formats and placeholders are not; the nearer the context is to a credential, the less residual is needed.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

#: Where the vocabulary of the word tokenizer lies; its whole words are the dictionary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

# Formats that are credentials wherever they stand.
TOKEN_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_/+\-])(?:"
    r"A(?:KIA|SIA)[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_\-]{20,}"
    r"|xox[abprs]-[A-Za-z0-9\-]{20,}"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_\-]{30,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|ya29\.[A-Za-z0-9_\-]{20,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")(?![A-Za-z0-9_])"
)
#: The beginning of such a token, as a cut snippet or the first of several pieces shows it.
TOKEN_START = re.compile(
    r"^(?:A(?:KIA|SIA)[0-9A-Z]{4,16}|gh[pousr]_[A-Za-z0-9]{6,}|glpat-[A-Za-z0-9_\-]{6,}|xox[abprs]-[A-Za-z0-9\-]{6,}"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{4,}|AIza[A-Za-z0-9_\-]{6,}|eyJ[A-Za-z0-9_\-.]{12,})$"
)
# Formats of public hashes and ids.
HASH_FORMATS = re.compile(
    r"^(?:sha(?:1|224|256|384|512)[-:=][A-Za-z0-9+/=]+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|md5[-:=]\S+|\$2[aby]\$.*|v?\d+(?:\.\d+)+\S{0,12})$"
)
_HEX = re.compile(r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$")
# What stands where a secret would, but isn't one.
PLACEHOLDER = re.compile(
    r"^(?:|[x*.•#_\-]{3,}|<[^>]*>|\$\{?[\w.:\-]*\}?.*|\$\(.*|%\(?\w+\)?[s%]?|\{\{.*|\{[\w.]*\}|@\w+@|\[[^\]]*\]|(?:none|null|nil|true|false|undefined|empty|n/a|tbd)"
    r"|.*(?:\*{4,}|\bredacted\b|X{6,}|x{6,}|0{10,}|1234567).*"
    r"|.*(?:replace|change|your|insert|fill|todo|fixme|dummy|example|placeholder|set)[-_ ]?(?:me|this|it|at|in|by|here|api|token|key|secret|password|value|your)\b.*"
    r"|.*\bhere$|see[ -_]vault.*|.*\b(?:vault|getenv|environ|process\.env)\b.*|(?:dummy|example|placeholder|changeme|password|passwd|secret|token|apikey|api[-_]key|test|user|username|admin|root|bearer|basic|string|str|object|int|boolean|bytes|text))$",
    re.I,
)
# Parts of a name that make it a credential's.
STRONG = set("secret secrets token tokens apikey auth bearer credential credentials cred creds conn hdr salt dsn".split())
#: Parts of a name whose value people choose: a password may consist of words and little else.
PASSWORDS = set("password passwd passwort passphrase pass pwd pw kennwort clave contrasena passe".split())
#: What makes a key a credential, if it stands before the word key; other keys name fields, messages or orders.
KEY_KINDS = set("api secret private access auth encryption encrypt signing sign master client consumer service account storage shared webhook deploy license licence subscription admin session cipher aes hmac jwt rsa ssh app aws gcp azure stripe github".split())
#: Parts of a name that describe a credential rather than hold it, or name a public value.
DESCRIBING = set(
    "hint field pattern regex regexp name label text min max length len ttl path file filename ref prompt policy format id ids uuid guid sha sha1 sha256 sha512 hash "
    "digest etag checksum integrity commit trace nonce version build banner type title message url uri endpoint host env var header count size index column schema "
    "public pub".split()
)
#: Last parts of a name that say nothing: what it holds must look random.
NEUTRAL = set("license licence code seed signature".split())
# Names with digits that say how something is done.
TECHNICAL = set("sha1 sha224 sha256 sha384 sha512 md4 md5 hs256 hs384 hs512 rs256 rs384 rs512 es256 es384 ps256 aes128 aes192 aes256 ed25519 x25519 p256 p384 rsa2048 rsa4096 argon2 pbkdf2 oauth1 oauth2 base32 base58 base64 utf8 utf16 utf32 latin1 x509 pkcs1 pkcs8 pkcs12 http2 http3 ipv4 ipv6 s3 ec2 v1 v2 v3 v4".split())
CALLS = "login log_in signin sign_in connect auth authenticate dial basic_auth setcredentials".split()
# Words and prefixes near which credentials stand: those of the rules below, and the fixed values that formats begin with.
HINTS = sorted(
    STRONG
    | PASSWORDS
    | NEUTRAL
    | set(CALLS)
    | {"key", "contrase", "log in", "log-in", "basic ", "://", "curl", "rotat", "-u ", "-u=", "-u\t", "--user", "--proxy-user", "-----begin"}
    | set("akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxb- xoxp- xoxa- xoxr- xoxs- sk_live_ sk_test_ rk_live_ rk_test_ aiza eyj npm_ ya29.".split())
)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_OPAQUE = re.compile(r"^[a-z]{1,2}\d{1,2}$", re.I)
#: Where a value is assigned to such a name.
_OPAQUE_SET = re.compile(r"""(?<![A-Za-z0-9_])[A-Za-z]{1,2}\d{1,2}["'\]]{0,2}\s*[:=]""")

# The rules are linear in a line's length: a name is read once, from the first letter of its run, and by its last 200 characters if longer.
_ASSIGN = re.compile(
    r"""(?<![A-Za-z_])(?P<name>[A-Za-z_][\w.\-]{0,200}+)["'\]]{0,2}\s*(?::\s*[A-Za-z_][\w<>\[\]. ]{0,30}?\s*(?==))?(?::=|=>|==?|:)\s*(?:\(\s*)?(?:[bfrBFR]{1,2}(?=["']))?(?P<q>\"\"\"|'''|["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)(?P<end>(?P=q))?"""
)
_BARE = re.compile(r"""^[\s\-#/*;]*(?:export\s+|ENV\s+|ARG\s+|set\s+|-\s+)*(?P<name>[A-Za-z_][\w.\-]*)\s*(?:=|:\s)\s*(?P<v>[^\s"'`#({\[|>][^\s"'`]*)\s*(?:#.*)?$""")
_OPTION = re.compile(r"""(?P<name>--?[A-Za-z][\w\-]{0,200}+)(?:\s+|=)(?P<q>["']?)(?P<v>[^\s"']{4,})(?P=q)""")
_SCHEME = re.compile(r"""\b(?P<name>Bearer|Basic|Token|Digest)\s+(?P<v>(?!--)[A-Za-z0-9+/=_.\-~]{8,})""", re.I)
_CALL = re.compile(rf"""\b(?:{'|'.join(CALLS)})\s*\((?P<args>[^()\n]*)\)""", re.I)
_USER_OPTION = re.compile(r"""(?:^|\s)(?:-u|--user|--proxy-user)(?:\s+|=)["']?[^\s:"'`$<{]+:(?P<v>[^\s"'`]{4,})""")
_LITERAL = re.compile(r"""(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)""")
_URL = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@"'`<>{}$]*:(?P<v>[^\s@/"'`]{3,}(?:/[^\s@/"'`]+)?)@[\w.\[]""")
_SPOKEN = re.compile(
    r"""(?:\b(?P<n1>pass(?:word|wd|phrase)?|passwort|kennwort|clave|contraseña|mot de passe|secret|token|pwd)\b\s*(?:is|was|ist|es|est|[:=])\s*|\blog[ -]?in\b[^/\n"']{0,40}?[:\s][^/\n"'\s]+\s+/\s+|\bcredentials?\b[^/\n"']{0,30}[:\s][^/\n"'\s]+\s+/\s+)(?P<q>["'`]?)(?P<v>[^\s"'`]{4,})(?P=q)""",
    re.I,
)
_USED = re.compile(r"""\buse[ds]?\s+["'`]?(?P<v>[^\s"'`]{16,})""", re.I)
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_STOP = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY")
_KEY_BODY = re.compile(r"(?:\\r|\\n|[\s\"'+,>#/*|])*(?P<v>[A-Za-z0-9+/=]{16,})")
#: What stands between the lines of a key's body, and a line of it: a header or letters in base 64.
_KEY_GAP = re.compile(r"(?:\\[rnt\\\n]|[\s\"'`,>#*|.&()]|\+(?=[\s\"'`\\])|//(?=\s))*+")
_KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID)(?::[^\n\\\"']*)")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/=]++")
_NEXT_PIECE = re.compile(r"""\s*+\\?+\s*+(?:\+|\.|&|\|\|)?+\s*+\\?+\s*+(?:\+|\.)?+\s*+(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)""")


@lru_cache(maxsize=2)
def dictionary(path: str = VOCABULARY) -> dict[str, float]:
    """Cost in nats of each whole word of the vocabulary, by its rank (Zipf's law)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [(w[:-4], i) for w, i in vocab.items() if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 7 and w[:-4].isascii()]
    words.sort(key=lambda x: x[1])
    return {w: math.log(rank + 10) + 1.0 for rank, (w, _) in enumerate(words)}


#: Cost of a character that no word explains; a word must beat it.
_RAW_COST = 3.4


def _unexplained(run: str, words: dict[str, float]) -> int:
    """Letters of a run that the cheapest segmentation leaves without a word, by Viterbi."""
    s = run.lower()
    n = len(s)
    best, raw = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i in range(n):
        if best[i] + _RAW_COST < best[i + 1]:
            best[i + 1], raw[i + 1] = best[i] + _RAW_COST, raw[i] + 1
        for j in range(i + 3, min(n, i + 16) + 1):
            c = words.get(s[i:j])
            if c is not None and best[i] + c < best[j]:
                best[j], raw[j] = best[i] + c, raw[i]
    return raw[n]


def residual(literal: str, words: dict[str, float], chosen: bool = False) -> int:
    """How many characters of a literal no dictionary word explains.

    Runs of letters are segmented by Viterbi. Digits are explained where they number a word (up to four of them, at the beginning or end of a part); digits that
    alternate with letters are not, and neither are short runs of letters between them. With ``chosen``, where people choose a value, nothing but a word is explained: every digit and every
    sign that joins no words counts.
    """
    left = 0
    for part in re.findall(r"[^\W_]+", literal):
        if part.lower() in TECHNICAL:
            continue
        runs = re.findall(r"[^\W\d_]+|\d+", part)
        mixed = len(runs) > 2
        for run in runs:
            if run.isdigit():
                left += len(run) if chosen or mixed or len(run) > 4 else 0
            elif mixed and len(run) < 3:
                left += len(run)
            else:
                # A number's unit or a word's end of one or two letters says nothing.
                left += _unexplained(run, words) if len(run) > 2 or not mixed and len(runs) == 1 and len(part) > 2 else 0
    return left + (len(re.findall(r"[^\w\s.\-/:]", literal)) if chosen else 0)


def name_strength(name: str) -> int:
    """3 for a password's name, 2 for another credential's, 1 for a name that says nothing, 0 for any other."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    if not parts:
        return 0
    if any(p in DESCRIBING for p in parts):
        return 0
    if any(p in PASSWORDS for p in parts):
        return 3
    if any(p in STRONG for p in parts) or parts[-1] in ("key", "keys") and any(p in KEY_KINDS for p in parts[:-1]):
        return 2
    if parts[-1] in ("key", "keys"):
        return 1
    if parts[-1] in NEUTRAL:
        return 1
    return 1 if _OPAQUE.match(name.split(".")[-1]) else 0


def is_placeholder(v: str) -> bool:
    return bool(PLACEHOLDER.match(v.strip()))


#: Characters that words must leave over for a literal to be a secret, by the strength of its context.
LEAST_RESIDUAL = {3: 1, 2: 2, 1: 10}
#: The same for literals in a format that only credentials have: what is left to see is that it's no example made of words.
LEAST_KNOWN = 3


def judge(value: str, strength: int, words: dict[str, float], whole: bool = True) -> bool:
    """Whether a literal is a secret: what words leave over decides, the more so the less its context says; strength is that of its context."""
    v = value.strip()
    known = bool(TOKEN_FORMATS.search(v) or (not whole and TOKEN_START.match(v)))
    if not known and (not strength or re.search(r"\s", v) or HASH_FORMATS.match(v) or "://" in v):
        return False
    if is_placeholder(v) or re.search(r"\[[^\[\]\-]*-[^\]]*\]", v[: v.rfind("]") + 1]):
        return False
    if known:
        return residual(v, words) >= LEAST_KNOWN
    # A call or a member is code, not a value.
    if len(v) < 6 and not _HEX.match(v) or re.match(r"^[\w.\-]*\(", v):
        return False
    return residual(v, words, strength >= 2) >= LEAST_RESIDUAL[strength]


class _Automaton:
    """One automaton per worker."""

    built = None

    @classmethod
    def get(cls):
        if cls.built is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for h in HINTS:
                a.add_word(h, len(h))
            a.make_automaton()
            cls.built = a
        return cls.built


def _joined(text: str, value: str, at: int) -> tuple[str, list[tuple[int, int]]]:
    """A literal with the pieces that are added to it, and the spans of those pieces; ``at`` is after its closing quote."""
    spans, parts = [], [value]
    while (m := _NEXT_PIECE.match(text, at)) and re.search(r"[+.&|\n\\]|^\s*$", text[at : m.start("q")]):
        # Juxtaposed literals join only across a line end or an operator.
        if not re.search(r"[+\n.&|]", text[at : m.start("q")]):
            break
        parts.append(m["v"])
        spans.append(m.span("v"))
        at = m.end()
    return "".join(parts), spans


def _key_end(text: str, at: int) -> int:
    """Where the body of a private key ends whose header ends at ``at``: before its END line, or after its last line if it is cut off.

    Lines are followed one by one, however many. Bodies written in other ways count up to a key's END line, if nothing else begins before.
    """
    last, pos = 0, at
    while True:
        pos = _KEY_GAP.match(text, pos).end()
        if text.startswith("-----END", pos):
            return pos
        if m := _KEY_HEADER.match(text, pos):
            pos = m.end()
            continue
        m = _KEY_LINE.match(text, pos)
        n = m.end() - pos if m else 0
        # Shorter ones are the last line, or where the key was cut off; an identifier is no line.
        if not (n >= 40 or n >= 16 and re.search(r"[0-9+/]", m[0]) or last and n and (m.end() == len(text) or text.startswith("-----END", _KEY_GAP.match(text, m.end()).end()) or m[0][0] == "=" and n == 5)):
            break
        last = pos = m.end()
    following = text.find("-----BEGIN", at)
    if stop := _KEY_STOP.search(text, at, following if following >= 0 else len(text)):
        return stop.start()
    return max(last, _KEY_BODY.match(text, at).end("v"))


def scan(text: str, words: dict[str, float], snippet: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secret values in a text, in order; pieces put together give a span each.

    The first span of a secret has its kind, the others 'more'. With ``snippet``, a literal may be cut at its end.
    """
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer would shift positions
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ends = [m.start() for m in re.finditer("\n", text)]
    hits = {bisect_right(ends, e - 1) for e, _ in _Automaton.get().iter(lower)}
    lines = sorted(hits | {bisect_right(ends, m.start()) for m in _OPAQUE_SET.finditer(text)})
    # bisect_right over line ends gives the line's index; a hit's end never lies on a newline.
    found: dict[int, tuple[int, int, str]] = {}
    taken: list[tuple[int, int]] = []

    def add(a: int, z: int, kind: str, more: list[tuple[int, int]] | None = None) -> None:
        if z > a and not any(a < y and z > x for x, y in taken):
            found[a] = (a, z, kind)
            taken.append((a, z))
            for x, y in more or ():
                found[x] = (x, y, "more")
                taken.append((x, y))

    for k in lines:
        a = ends[k - 1] + 1 if k else 0
        z = ends[k] if k < len(ends) else len(text)
        line = text[a:z]
        for m in _PRIVATE_KEY.finditer(line):
            if _KEY_BODY.match(text, a + m.end()):
                add(a + m.start(), _key_end(text, a + m.end()), "private_key")
        for m in _URL.finditer(line):
            if not is_placeholder(m["v"]) and residual(m["v"], words, True) >= LEAST_RESIDUAL[3]:
                add(a + m.start("v"), a + m.end("v"), "url_password")
        for m in _SCHEME.finditer(line):
            v = m["v"]
            if m["name"].lower() == "basic":
                try:
                    login = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8", "replace")
                except (binascii.Error, ValueError):
                    login = ""
                said = login.partition(":")[2]
                ok = bool(said) and not is_placeholder(v) and not is_placeholder(said) and residual(said, words, True) >= LEAST_RESIDUAL[3]
            else:
                ok = judge(v, 2, words)
            if ok:
                add(a + m.start("v"), a + m.end("v"), "authorization")
        # A value may stand on a later line than its name; a text in three quotes there is a docstring.
        for m in _ASSIGN.finditer(text, a):
            if m.start() >= z:
                break
            if m.start("q") >= z and len(m["q"]) == 3:
                continue
            value, more, whole = m["v"], [], m["end"] is not None
            if whole and not snippet or whole and re.search(r"\S", text[m.end() : z]):
                value, more = _joined(text, m["v"], m.end())
            strength = name_strength(m["name"])
            if _PRIVATE_KEY.search(value):
                continue
            if judge(value, strength, words, whole and not (snippet and line.rstrip().endswith(("+", "(", "\\")))):
                if more or TOKEN_FORMATS.fullmatch(value) or strength or not whole or TOKEN_START.match(value):
                    add(*m.span("v"), "assignment", more)
        m = _BARE.match(line)
        if m and judge(m["v"].rstrip(",;"), name_strength(m["name"]), words):
            add(a + m.start("v"), a + m.start("v") + len(m["v"].rstrip(",;")), "assignment")
        for m in _OPTION.finditer(line):
            s = name_strength(m["name"].lstrip("-"))
            if s >= 2 and judge(m["v"], s, words):
                add(a + m.start("v"), a + m.end("v"), "option")
        for m in _USER_OPTION.finditer(line):
            if judge(m["v"], 3, words):
                add(a + m.start("v"), a + m.end("v"), "option")
        for m in _CALL.finditer(line):
            literals = list(_LITERAL.finditer(m["args"]))
            if len(literals) >= 2:
                v = literals[-1]
                if judge(v["v"], 3, words):
                    at = a + m.start("args")
                    add(at + v.start("v"), at + v.end("v"), "login")
        for m in _SPOKEN.finditer(line):
            if judge(m["v"], name_strength(m["n1"] or "") or 3, words):
                add(a + m.start("v"), a + m.end("v"), "login")
        for m in _USED.finditer(line):
            if judge(m["v"], 1, words):
                add(a + m.start("v"), a + m.end("v"), "token")
        for m in TOKEN_FORMATS.finditer(line):
            if judge(m[0], 2, words):
                add(a + m.start(), a + m.end(), "token")
    return [found[x] for x in sorted(found)]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with its secrets replaced so that the code or JSON around stays as it was.

    Only characters inside literals change: a value becomes the word REDACTED, a private key keeps its lines' ends and escapes.
    """
    out, at = [], 0
    for a, z, kind in spans:
        out.append(text[at:a])
        if kind == "private_key":
            body = _PRIVATE_KEY.match(text, a).end()
            # Escapes are stepped over, so that the n of a line end is no part of the key.
            hidden = re.sub(r"\\[nrt]|[A-Za-z0-9+/=]{4,}", lambda m: m[0] if m[0][0] == "\\" else "REDACTED", text[body:z])
            out.append(text[a:body] + hidden)
        else:
            out.append("REDACTED")
        at = z
    return "".join([*out, text[at:]])


FOUND_SCHEMA = "origin string, record_id string, path string, line_no int, kind string"


def _file_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = dictionary()
    for pdf in batches:
        rows = []
        for fid, path, text in zip(pdf.file_id, pdf.path, pdf.raw_text):
            seen = set()
            for a, _, kind in scan(text, words):
                line = text.count("\n", 0, a) + 1
                if kind != "more" and line not in seen:
                    seen.add(line)
                    rows.append(("file", fid, path, line, kind))
        yield pd.DataFrame(rows, columns=["origin", "record_id", "path", "line_no", "kind"])


def _snippet_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = dictionary()
    for pdf in batches:
        rows = []
        for branch, path, line, snippet in zip(pdf.branch_id, pdf.path, pdf.line, pdf.snippet):
            spans = [s for s in scan(snippet, words, snippet=True) if s[2] != "more"]
            if spans:
                rows.append(("report", branch, path, line, spans[0][2]))
        yield pd.DataFrame(rows, columns=["origin", "record_id", "path", "line_no", "kind"])


ISSUES = "struct<by_file: map<string, array<struct<id: string, path: string, line: int, snippet: string>>>>"


def findings(reports: DataFrame) -> DataFrame:
    """(branch_id, path, line, snippet) of the issue reports; null and broken reports give no rows."""
    parsed = reports.where(F.col("issues_report").isNotNull()).select("branch_id", F.from_json("issues_report", ISSUES).alias("r"))
    per_file = parsed.select("branch_id", F.explode("r.by_file").alias("path", "findings"))
    return per_file.select("branch_id", "path", F.explode("findings").alias("f")).select("branch_id", "path", F.col("f.line").alias("line"), F.col("f.snippet").alias("snippet"))


def file_secrets(files: DataFrame) -> DataFrame:
    """Places of secrets in ``analysis.raw_text``, with the schema FOUND_SCHEMA; one row per line where one begins.

    Files with null ids, analysis or text and empty texts give none. Repeated rows give repeated results; callers drop them.
    """
    rows = files.where(F.col("analysis.raw_text").isNotNull()).select(F.col("id").alias("file_id"), "path", F.col("analysis.raw_text").alias("raw_text"))
    return rows.mapInPandas(_file_batches, FOUND_SCHEMA)


def report_secrets(reports: DataFrame) -> DataFrame:
    """Findings whose snippet shows a secret or a usable part of one."""
    rows = findings(reports).where(F.col("snippet").isNotNull() & F.col("line").isNotNull())
    return rows.mapInPandas(_snippet_batches, FOUND_SCHEMA)


REDACTED_SCHEMA = "file_id string, n_secrets int, raw_text string, codes array<string>"


def _redact_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = dictionary()
    for pdf in batches:
        rows = []
        for fid, text, codes in zip(pdf.file_id, pdf.raw_text, pdf.codes):
            spans = scan(text, words) if text is not None else []
            out = []
            for code in codes if codes is not None else ():
                own = scan(code, words) if code is not None else []
                out.append(redact(code, own) if own else code)
            rows.append((fid, sum(s[2] != "more" for s in spans), redact(text, spans) if spans else text, out))
        yield pd.DataFrame(rows, columns=["file_id", "n_secrets", "raw_text", "codes"])


def redacted_files(files: DataFrame) -> DataFrame:
    """Files with their secrets redacted: ``raw_text`` and ``codes``, the code of functions, then blocks, in order."""
    code = lambda c: F.coalesce(F.transform(f"analysis.{c}", lambda x: x["code"]), F.array().cast("array<string>"))
    rows = files.where(F.col("analysis").isNotNull()).select(
        F.col("id").alias("file_id"), F.col("analysis.raw_text").alias("raw_text"), F.concat(code("functions"), code("blocks")).alias("codes")
    )
    return rows.mapInPandas(_redact_batches, REDACTED_SCHEMA)


def _report_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = dictionary()
    for pdf in batches:
        out, counts = [], []
        for report in pdf.issues_report:
            n = 0
            try:
                doc = json.loads(report)
                for found in (doc.get("by_file") or {}).values():
                    for f in found:
                        if isinstance(f.get("snippet"), str) and (spans := scan(f["snippet"], words, snippet=True)):
                            f["snippet"] = redact(f["snippet"], spans)
                            n += 1
                # The escapes of non-ASCII are kept as the report had them.
                out.append(json.dumps(doc, ensure_ascii=report.isascii()) if n else report)
            except (ValueError, AttributeError, TypeError):
                out.append(report)
            counts.append(n)
        yield pd.DataFrame({"branch_id": pdf.branch_id, "n_secrets": counts, "issues_report": out})


def redacted_reports(reports: DataFrame) -> DataFrame:
    """Reports whose snippets are redacted; they stay JSON. Broken and null reports stay as they are or are left out."""
    rows = reports.where(F.col("issues_report").isNotNull()).select("branch_id", "issues_report")
    return rows.mapInPandas(_report_batches, "branch_id string, n_secrets int, issues_report string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_secrets(table(spark, sf_dir, "files"))
    reports = report_secrets(table(spark, sf_dir, "reports"))
    return files.unionByName(reports).select("origin", "record_id", "path", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_files(table(spark, sf_dir, "files")).dropDuplicates(["file_id"])


def p4_redacted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_reports(table(spark, sf_dir, "reports")).distinct()


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_redacted_reports": p4_redacted_reports}
SQL: dict[str, str] = {}
