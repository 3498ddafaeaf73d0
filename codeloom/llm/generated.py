"""Generated, minified or vendored source files (problem 3).

Generation and licence notices in file headers are matched by a multi-pattern automaton, paths by rules
for vendored directories, lock files and minified suffixes. What bears neither is judged by its content: minified
text, data written as code, and series of statements that only a tool writes. A licence notice is evidence of a third party only if its owner is not the
repository's own, and a directory with an ambiguous name only if the package in it is known from elsewhere; both are decided by joins over the collection. Copies of third-party files
without notice are found as near-duplicates of files that are known to be vendored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.session import materialize, table

# File name endings of source and JSON files.
SOURCE_SUFFIXES = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".java", ".json", ".rs", ".c", ".h", ".cpp", ".hpp", ".cc", ".rb", ".php", ".cs", ".css", ".kt", ".swift", ".scala")
# Notices with which generators begin a comment.
NOTICES = (
    "code generated by", "code generated;", "@generated", "<auto-generated", "<autogenerated", "auto-generated file", "autogenerated", "auto-generated by", "auto-generated from",
    "auto-generated code", "automatically generated", "machine-written by", "machine-generated", "machine generated", "generated by", "generated from", "generated with",
    "generated using", "generated code", "generated file", "this file was automatically generated", "this file is automatically generated", "this file was auto-generated",
    "this file is auto-generated", "this file was autogenerated", "this file is autogenerated", "this file was generated", "this file is generated", "this file has been generated",
    "this code was generated", "this code is generated", "do not edit", "do not modify", "diese datei wurde maschinell erzeugt", "diese datei wurde automatisch", "diese datei wurde generiert",
    "automatisch generiert", "automatisch erzeugt", "maschinell erzeugt", "ce fichier a été généré", "ce fichier est généré", "fichier généré", "généré automatiquement", "généré par",
    "este archivo fue generado", "este archivo ha sido generado", "archivo generado", "generado automáticamente", "generado por",
)
# Licence notices of third parties.
LICENCES = ("copyright", "(c)", "©", "use is governed by", "licensed under", "spdx-license-identifier", "@license", "@preserve")
# Directories that package managers fill, and names that third-party code stands under but own code may too.
INSTALLED = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|jspm_packages|third[_-]?party|godeps|_vendor|pods)/", re.I)
AMBIGUOUS = re.compile(r"(?:^|/)(?:vendor|vendored|external|extern|deps|contrib)/(?P<package>[^/]+)/", re.I)
#: A package's directory that names a host or a version.
_PACKAGE_DIR = re.compile(r"^(?:[a-z0-9\-]+\.(?:com|org|net|io|in|dev|co)|.*[-@_]v?\d+(?:\.\d+)+.*)$", re.I)
# Lock files.
LOCK_FILES = re.compile(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|pipfile\.lock|poetry\.lock|packages\.lock|[\w.]+-lock|[\w.]+\.lock)(?:\.json)?$", re.I)
# Suffixes of generated and minified files.
GENERATED_SUFFIX = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|\.pb\.(?:h|cc)|_generated\.\w+|\.generated\.\w+|\.g\.dart|\.designer\.cs)$", re.I)
MINIFIED_SUFFIX = re.compile(r"[.-]min\.(?:js|css|mjs)$", re.I)

HEADER_LINES = 25
_COMMENT = re.compile(r"""\s*(?://+!?|/\*+!?|\*+(?!/)|#+!?|--+|;+|<!--|\"\"\"|\'\'\')[ \t]*""")
#: A request not to edit is a generator's if it says no more, or how.
_REQUEST = re.compile(r"do not (?:edit|modify)(?:\s*(?:$|[.,;:!\-–(*]|this file|the file|it\b|directly|manually|by hand|below|above))")
_BY_HAND = re.compile(r"generated (?:by|from|with|using) hand\b")
#: Whom a notice names: a group's name, a name after the year, a package before its version.
_OWNERS = (
    re.compile(r"\bthe\s+(?P<o>[\w.\-]+(?:\s+[\w.\-]+)?)\s+(?:authors|contributors|developers|team|project|foundation)\b", re.I),
    re.compile(r"(?:copyright|\(c\)|©)[\s:]*(?:\(c\)|©)?[\s\d,\-–]*(?:by\s+)?(?P<o>[^\W\d][\w&'’\-]*(?:\s+[^\W\d][\w&'’.\-]*){0,3})", re.I),
    re.compile(r"@(?:license|preserve)\s+(?P<o>[^\W\d][\w.\-]*)\s+v?\d", re.I),
)
_NO_OWNER = re.compile(r"^(?:all|and|the|notice|rights?|holders?|owners?|header|years?|licen[cs]e[ds]?|of|in|is|by|see|this|information|statements?)\b", re.I)
_LITERAL = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\b(?:0x[0-9a-fA-F]+|\d[\d_.eE]*)\b|\b(?:true|false|null|None|True|False|nil)\b""")
_LETTER = re.compile(r"[A-Za-z]")
_SPACE = re.compile(r"\s")
_KEYWORDS = frozenset(
    "def class if for while return import from func type struct package var const let function export interface public private static final void new try except catch else elif in of and or not with as raise throw throws async await yield default".split()
)
_WORD = re.compile(r"\w+")

#: A payload has at least this many characters, and fewer letters of code than these.
PAYLOAD_CHARS, PAYLOAD_CODE_SHARE, PAYLOAD_CODE = 1000, 0.02, 150
#: Text is minified that has a line of this length, literals aside, and less white space than this share.
MINIFIED_LINE, MINIFIED_SPACE, MINIFIED_CHARS = 200, 0.08, 400
#: A series is generated that fills this share of a file's lines: a counter running through as many lines of a shape, or as many blocks of the same shapes.
SERIES_SHARE, SERIES_LENGTH, SERIES_LINES = 0.6, 8, 20
#: An owner is a repository's own whose notices stand in this share of its source files, and in as many, outside of vendored directories.
OWN_SHARE, OWN_FILES = 0.25, 3
#: Similarity of lines from which a file is a copy, letters a line has to count, and lines a file needs.
COPY_SIMILARITY, LINE_CHARS, COPY_LINES = 0.8, 12, 8
#: Bytes up to which the lines of vendored files are sent to every executor.
BROADCAST_BYTES = 8_000_000


class _Automaton:
    """The notices' automaton, one per worker."""

    built = None

    @classmethod
    def get(cls):
        if cls.built is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for kind, phrases in (("notice", NOTICES), ("licence", LICENCES)):
                for p in phrases:
                    a.add_word(p, (kind, len(p)))
            a.make_automaton()
            cls.built = a
        return cls.built


#: Letters of the longest phrase; a notice begins its comment, so nothing behind can be one.
_LONGEST = max(map(len, NOTICES + LICENCES)) + 2


def _owner(said: str) -> str | None:
    for rx in _OWNERS:
        m = rx.search(said)
        if m and not _NO_OWNER.match(m["o"]):
            return re.sub(r"[\s.,]+(?:all rights.*|inc|ltd|llc|gmbh|corp)?$", "", m["o"], flags=re.I).strip().lower() or None
    return None


def header_notice(text: str) -> tuple[str | None, str | None]:
    """('generated', None) if a comment in the file's header begins with a generator's notice, else (None, owner), whom a licence notice there names, if any.

    A notice that is quoted or told of within a sentence does not begin its comment. A licence without an owner says nothing about whose the file is.
    """
    a, owner = _Automaton.get(), None
    at = 0
    for _ in range(HEADER_LINES):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        m = _COMMENT.match(line)
        if m:
            said = line[m.end() :].partition("*/")[0].strip()
            head = said[:_LONGEST].lower()
            for stop, (kind, n) in a.iter(head):
                if stop + 1 - n > 1:
                    continue
                if kind == "licence":
                    owner = owner or _owner(said)
                elif not _BY_HAND.search(head) and (not head.lstrip("*!@<").startswith("do not") or _REQUEST.match(said.lower())):
                    return "generated", None
        if end < 0:
            break
        at = end + 1
    return None, owner


_INT = re.compile(r"(?<![\d.])\d+")


def _shape(line: str) -> str:
    return _WORD.sub(lambda m: m[0] if m[0] in _KEYWORDS else "w", line)


def is_series(lines: list[str], bare: list[str]) -> bool:
    """Whether most lines belong to a series of statements that a tool wrote: a counter runs through lines of one shape, or one block of three lines and more comes again and again.

    Rows of a table, that is keys and literals alone, are data and no statements. Routes, settings and the like have neither counters nor blocks.
    """
    if len(lines) < SERIES_LINES:
        return False
    shapes = [_shape(x) for x in bare]
    by: dict[str, list[int]] = {}
    for i, x in enumerate(shapes):
        by.setdefault(x, []).append(i)
    counted = 0
    for x, at in by.items():
        if len(at) < SERIES_LENGTH or not re.search(r"w\s*\(|=\s*[wn(]|[a-z]{2,}\s", x):
            continue
        slots = [[int(v) for v in _INT.findall(lines[i])] or [int(v) for v in re.findall(r"\d+", lines[i])] for i in at]
        width = min(map(len, slots))
        if any(sum(p[k] + 1 == q[k] for p, q in zip(slots, slots[1:])) >= 0.9 * (len(at) - 1) for k in range(width)):
            counted += len(at)
    if counted >= SERIES_SHARE * len(lines):
        return True
    for period in range(3, 13):
        same = sum(p == q for p, q in zip(shapes, shapes[period:]))
        if same >= period * SERIES_LENGTH and same >= SERIES_SHARE * len(shapes) and len(set(shapes[-period - 1 :])) >= 3 and not any(sum(p == q for p, q in zip(shapes, shapes[d:])) >= 0.9 * same for d in (1, 2)):
            return True
    return False


def content_kind(text: str, suffix: str) -> str | None:
    """'payload', 'minified' or 'generated' by the text alone, else None."""
    n = len(text)
    bare = _LITERAL.sub("0", text)
    if suffix != ".json":
        code = len(_LETTER.findall(bare))
        if n >= PAYLOAD_CHARS and code < PAYLOAD_CODE and code < PAYLOAD_CODE_SHARE * n:
            return "payload"
        lines = text.split("\n")
        shown = [x.strip() for x in bare.split("\n")]
        if len(shown) != len(lines):  # a literal spans lines
            shown = [_LITERAL.sub("0", x).strip() for x in lines]
        kept = [(x, y) for x, y in zip(lines, shown) if len(y) > 1]
        if is_series([x for x, _ in kept], [y for _, y in kept]):
            return "generated"
    elif re.match(r'\s*\{\s*"(?:lockfileVersion|_lock|lockfile)"', text) or (n >= PAYLOAD_CHARS and text.count('"integrity"') >= 3 and '"lockfileVersion"' in text):
        return "generated"
    if suffix in (".js", ".mjs", ".cjs", ".ts", ".css", ".jsx"):
        longest = max(map(len, bare.split("\n")), default=0)
        if n >= MINIFIED_CHARS and longest >= MINIFIED_LINE and len(_SPACE.findall(bare)) < MINIFIED_SPACE * len(bare):
            return "minified"
    return None


def path_kind(path: str) -> str | None:
    """The kind that the path alone tells."""
    if INSTALLED.search(path):
        return "vendored"
    m = AMBIGUOUS.search(path)
    if m and _PACKAGE_DIR.match(m["package"]):
        return "vendored"
    if LOCK_FILES.search(path):
        return "generated"
    if GENERATED_SUFFIX.search(path):
        return "generated"
    return "minified" if MINIFIED_SUFFIX.search(path) else None


def package_of(path: str) -> str | None:
    """The package of a path in a directory that may hold third-party code."""
    m = AMBIGUOUS.search(path) or re.search(r"(?:^|/)(?:node_modules|bower_components|site-packages|third[_-]?party)/(?P<package>[^/]+)/", path, re.I)
    return m["package"].lower() if m else None


def classify(path: str, text: str | None) -> tuple[str | None, str | None, str | None]:
    """(kind, owner, package): why a file is not hand-written, 'generated', 'vendored', 'minified' or 'payload', if the file alone tells; else what the collection must decide on."""
    kind, package = path_kind(path), package_of(path)
    if not text:
        return kind, None, package
    noted, owner = header_notice(text)
    if kind is None:
        suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
        kind = noted or content_kind(text, suffix)
    return kind, owner, package


FACTS = "file_id string, branch_id string, kind string, owner string, package string, inside boolean"


def _classify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, b, *classify(p, t), bool(INSTALLED.search(p) or AMBIGUOUS.search(p))) for f, b, p, t in zip(pdf.file_id, pdf.branch_id, pdf.path, pdf.text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


def source_files(files: DataFrame) -> DataFrame:
    """(file_id, branch_id, path, text) of source and JSON files, by path in any case; repeated rows stay."""
    pattern = "(?i)(?:" + "|".join(re.escape(s) for s in SOURCE_SUFFIXES) + ")$"
    rows = files.where(F.col("id").isNotNull() & F.col("path").rlike(pattern) & F.col("analysis").isNotNull())
    return rows.select(F.col("id").alias("file_id"), "branch_id", F.translate("path", "\\", "/").alias("path"), F.col("analysis.raw_text").alias("text"))


def _line_hashes(text) -> F.Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\r\t]", " "))), lambda x: F.length(x) >= LINE_CHARS)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def copies(sources: DataFrame, kinds: DataFrame) -> DataFrame:
    """(file_id) of files whose lines are at least COPY_SIMILARITY alike (Jaccard) to those of a vendored file.

    Vendored files with the same set of lines count as one. Two sets that similar share at least one of any
    n - ceil(0.8 n) + 1 lines of the vendored one, so it is enough to look up those that are rarest among all sources; common lines are
    looked up by nobody, which keeps hot lines out of the join without losing a pair. Candidates are then
    compared in full. Files with fewer than COPY_LINES different lines of LINE_CHARS letters are not compared: so little text proves no origin.
    """
    lines = sources.select("file_id", _line_hashes("text").alias("lines")).where(F.size("lines") >= COPY_LINES)
    lines = materialize(lines, "line-hashes")
    vendored = _small(kinds.where(F.col("kind") == "vendored").select("file_id").distinct(), 80)
    known = lines.join(vendored, "file_id", "left_semi")
    known = materialize(known.select(F.sort_array("lines").alias("lines")).distinct().withColumn("rep", F.xxhash64(F.to_json("lines"))), "vendored-lines")
    each = known.select("rep", F.size("lines").alias("n"), F.explode("lines").alias("h"))
    asked = _small(materialize(each.select("h").distinct(), "vendored-line-set"), 32)
    df = lines.select(F.explode("lines").alias("h")).join(asked, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("rep").orderBy("df", "h")
    keep = F.col("n") - F.ceil(F.lit(COPY_SIMILARITY) * F.col("n")) + 1
    prefix = each.join(df, "h").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= keep).select("rep", "h")
    prefix = _small(materialize(prefix, "rare-lines"), 48)
    rest = lines.join(_small(kinds.select("file_id").distinct(), 80), "file_id", "left_anti")
    hits = rest.select("file_id", F.explode("lines").alias("h")).join(prefix, "h").select("file_id", "rep").distinct()
    pairs = materialize(hits, "copy-candidates")
    texts = lines.join(_small(pairs.select("file_id").distinct(), 80), "file_id", "left_semi").dropDuplicates(["file_id"])
    both = pairs.join(texts, "file_id").join(known.select("rep", F.col("lines").alias("k")), "rep")
    shared = F.size(F.array_intersect("lines", "k"))
    return both.where(shared >= COPY_SIMILARITY * (F.size("lines") + F.size("k") - shared)).select("file_id").distinct()


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The table marked for broadcast if its counted size is within BROADCAST_BYTES, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _alike(a: str, b: str) -> F.Column:
    """Whether two names are one but for case and signs, or one begins with the other."""
    x, y = (F.regexp_replace(F.lower(c), r"[^\p{L}\d]", "") for c in (a, b))
    return (F.length(x) >= 3) & (F.length(y) >= 3) & (x.startswith(y) | y.startswith(x))


def third_party(facts: DataFrame, where: DataFrame, n_files: DataFrame) -> DataFrame:
    """(file_id) of files that a notice or an ambiguous directory shows to be a third party's.

    ``facts`` has the schema FACTS, ``where`` (branch_id, repo, org, name) and ``n_files`` (branch_id, n) the source files per branch.
    A notice's owner is the repository's own if the repository's address names it, or if its notices stand in OWN_SHARE of the repository's files and in OWN_FILES at least, outside of vendored
    directories. A package in an ambiguous directory is known if it bears a foreign owner's name, is installed by a package manager elsewhere, or stands in such directories of two organisations.
    """
    f = materialize(facts.where("owner is not null or package is not null").join(where, "branch_id", "left"), "third-party-facts").withColumn("repo", F.coalesce("repo", "branch_id"))
    noted = f.where("owner is not null")
    totals = n_files.join(where, "branch_id", "left").groupBy(F.coalesce("repo", "branch_id").alias("repo")).agg(F.sum("n").alias("total"))
    shares = noted.where("not inside").groupBy("repo", "owner").agg(F.count_distinct("file_id").alias("n")).join(totals, "repo")
    own = shares.where((F.col("n") >= OWN_FILES) & (F.col("n") >= OWN_SHARE * F.col("total"))).select("repo", "owner")
    foreign = noted.where(~F.coalesce(_alike("owner", "org") | _alike("owner", "name"), F.lit(False))).join(own, ["repo", "owner"], "left_anti")
    foreign = materialize(foreign.select("file_id", "owner").distinct(), "foreign-notices")
    named = foreign.select(F.regexp_replace("owner", r"[^\p{L}\d]", "").alias("p"))
    package = F.regexp_replace("package", r"[^\p{L}\d]", "").alias("p")
    installed = f.where("kind = 'vendored' and package is not null").select(package)
    often = f.where("package is not null").groupBy(package).agg(F.count_distinct(F.coalesce("org", "repo")).alias("orgs")).where("orgs >= 2").select("p")
    known = named.unionByName(installed).unionByName(often).where("p <> ''").distinct()
    inside = f.where("package is not null and kind is null").select("file_id", package).join(known, "p", "left_semi").select("file_id")
    return foreign.select("file_id").unionByName(inside).distinct()


def machine_files(files: DataFrame, branches: DataFrame | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """(file_id, kind) of the source and JSON files that the repository's people did not write by hand, once each.

    ``kind`` is 'generated', 'minified', 'payload' or 'vendored'. Binary files and files with a null path have none; an empty
    text is judged by its path. Repeated rows count once. Without ``branches`` and ``repositories`` each branch counts as a repository of its own without an address.
    """
    sources = source_files(files)
    facts = sources.mapInPandas(_classify_batches, FACTS)
    facts = materialize(facts.where("kind is not null or owner is not null or package is not null").distinct(), "file-facts")
    if branches is None:
        where = files.select("branch_id").distinct().select("branch_id", *[F.lit(None).cast("string").alias(c) for c in ("repo", "org", "name")])
    else:
        where = branches.select(F.col("id").alias("branch_id"), F.col("repository_id").alias("repo")).distinct()
        if repositories is not None:
            part = lambda i: F.regexp_extract("url", r"([^/:]+)/([^/]+?)(?:\.git)?/?$", i)
            where = where.join(repositories.select(F.col("id").alias("repo"), part(1).alias("org"), part(2).alias("name")).dropDuplicates(["repo"]), "repo", "left")
        else:
            where = where.withColumn("org", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
        where = where.dropDuplicates(["branch_id"])
    n_files = source_files(files).groupBy("branch_id").agg(F.count_distinct("file_id").alias("n"))
    theirs = third_party(facts, where, n_files).withColumn("kind", F.lit("vendored"))
    kinds = facts.where("kind is not null").select("file_id", "kind").unionByName(theirs)
    kinds = materialize(kinds.groupBy("file_id").agg(F.min("kind").alias("kind"), F.max(F.col("kind") == "vendored").alias("v")).select("file_id", F.when(F.col("v"), "vendored").otherwise(F.col("kind")).alias("kind")), "file-kinds")
    return kinds.unionByName(copies(sources, kinds).withColumn("kind", F.lit("vendored")))


def _machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "branches"), table(spark, sf_dir, "repositories"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _machine(spark, sf_dir).select("file_id").distinct()


def p3_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains: (file_id, branch_id, path) of hand-written source files."""
    files = table(spark, sf_dir, "files")
    machine = _machine(spark, sf_dir).select("file_id").distinct()
    rows = source_files(files).select("file_id").join(machine, "file_id", "left_anti").distinct()
    where = files.select(F.col("id").alias("file_id"), "branch_id", "path").distinct()
    return where.join(rows, "file_id", "left_semi")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per branch and kind."""
    files = table(spark, sf_dir, "files")
    where = files.select(F.col("id").alias("file_id"), "branch_id").distinct()
    return _machine(spark, sf_dir).join(where, "file_id").groupBy("branch_id", "kind").agg(F.count_distinct("file_id").alias("n_files"))


QUERIES = {"p3_found": p3_found, "p3_hand_written": p3_hand_written, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
