"""Rule scan over lines (RS1-RS3, JN16, AG1-AG4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import DEFAULT
from codeloom.functions.text import is_skipped, strip

# Id, severity, category and pattern of each rule, in the order of findings.
RULES = (
    ("hardcoded-aws-key", "critical", "security", r"AKIA[0-9A-Z]{16}"),
    ("hardcoded-private-key", "critical", "security", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("hardcoded-github-token", "critical", "security", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("hardcoded-slack-token", "high", "security", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("hardcoded-secret-assignment", "high", "security", r"""(?i)\b(api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*['"][A-Za-z0-9/+_\-]{8,}['"]"""),
    ("eval-usage", "high", "security", r"\beval\s*\("),
    ("exec-usage", "medium", "security", r"\bexec\s*\("),
    ("shell-true", "high", "security", r"shell\s*=\s*True"),
    ("os-system", "medium", "security", r"\bos\.system\s*\("),
    ("pickle-load", "medium", "security", r"\bpickle\.(load|loads)\s*\("),
    ("yaml-unsafe-load", "medium", "security", r"yaml\.load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)"),
    ("disabled-tls-verify-py", "high", "security", r"verify\s*=\s*False"),
    ("disabled-tls-verify-js", "high", "security", r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0"""),
    ("wildcard-cors", "medium", "security", r"""Access-Control-Allow-Origin['"]?\s*[:=]\s*['"]\*['"]|allow_origins\s*=\s*\[\s*['"]\*['"]\s*\]"""),
    ("dangerously-set-innerhtml", "medium", "security", r"dangerouslySetInnerHTML|\.innerHTML\s*="),
    ("sql-string-building", "medium", "security", r"""(?i)(SELECT|INSERT|UPDATE|DELETE)\b[^\n]{0,80}['"]\s*\+|f['"](?:SELECT|INSERT|UPDATE|DELETE)\b"""),
    ("debug-true", "low", "security", r"(?i)\bDEBUG\s*=\s*True\b"),
    ("todo-comment", "info", "quality", r"(?i)(#|//)\s*(TODO|FIXME|HACK|XXX)\b"),
    ("console-log", "info", "quality", r"\bconsole\.(log|debug)\s*\("),
    ("debugger-statement", "low", "quality", r"(?U)^\s*debugger\s*;?\s*$"),
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
RISK_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def lines_of(texts: DataFrame) -> DataFrame:
    """(branch_id, path, line, text) of (branch_id, path, raw_text); the empty line after a last line end does not count."""
    cut = F.split(F.regexp_replace("raw_text", "\r\n?", "\n"), "\n")
    kept = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return texts.select("branch_id", "path", F.posexplode(kept).alias("pos", "text")).select("branch_id", "path", (F.col("pos") + 1).alias("line"), "text")


def scanned_texts(files: DataFrame, max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """Files the rule scan reads: not binary by suffix and not too large; each (branch_id, path) once."""
    rows = files.where(F.col("analysis.raw_text").isNotNull() & ~is_skipped(F.col("path")))
    rows = rows.select("branch_id", "path", F.col("analysis.raw_text").alias("raw_text")).where(F.octet_length("raw_text") <= max_bytes)
    return rows.dropDuplicates(["branch_id", "path"])


def findings(files: DataFrame, large_lines: int = DEFAULT.large_file_lines) -> DataFrame:
    """(branch_id, path, id, severity, category, line, ord, snippet): at most one per rule and line, and large-file per file.

    No cross join: each line is tested against all rules in one projection, and only hits are exploded. Null and empty texts give none.
    """
    texts = scanned_texts(files)
    lines = lines_of(texts)
    hit = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("ord"), F.lit(r).alias("id"), F.lit(s).alias("severity"), F.lit(c).alias("category"))) for i, (r, s, c, p) in enumerate(RULES)])
    found = lines.select("branch_id", "path", "line", "text", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("f"))
    snippet = F.substring(strip(F.col("text")), 1, DEFAULT.snippet_chars)
    per_line = found.select("branch_id", "path", "f.id", "f.severity", "f.category", "line", "f.ord", snippet.alias("snippet"))
    big = texts.select("branch_id", "path", _line_count().alias("n")).where(F.col("n") > large_lines)
    large = big.select("branch_id", "path", F.lit("large-file").alias("id"), F.lit("low").alias("severity"), F.lit("quality").alias("category"), F.lit(1).alias("line"), F.lit(len(RULES)).alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" lines")).alias("snippet"))
    return per_line.unionByName(large)


def _line_count():
    t = F.regexp_replace("raw_text", "\r\n?", "\n")
    return F.size(F.split(t, "\n")) - F.when(t.endswith("\n") | (t == ""), 1).otherwise(0)


def large_files(files: DataFrame, large_lines: int) -> DataFrame:
    return scanned_texts(files).select("branch_id", "path", _line_count().alias("n_lines")).where(F.col("n_lines") > large_lines)


def summary(found: DataFrame) -> DataFrame:
    """AG1: findings per branch and severity, zero-filled."""
    counts = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in SEVERITIES]
    return found.groupBy("branch_id").agg(F.count(F.lit(1)).alias("total"), *counts)


def risk() -> F.Column:
    return F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in RISK_WEIGHT.items()], F.lit(0))


def file_risk(found: DataFrame) -> DataFrame:
    """AG3: (branch_id, path, risk_score, n_findings)."""
    return found.groupBy("branch_id", "path").agg(F.sum(risk()).cast("long").alias("risk_score"), F.count(F.lit(1)).alias("n_findings"))


def by_file(found: DataFrame) -> DataFrame:
    """AG2: findings of each file in rule, then line order."""
    one = F.struct("ord", "line", "id", "severity", "category", "snippet")
    return found.groupBy("branch_id", "path").agg(F.sort_array(F.collect_list(one)).alias("findings"))
