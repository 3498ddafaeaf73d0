"""Queries: listing, rules, chunks, tokens, urls, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunking, issues
from codeloom.session import table


def _once(df):
    return df.dropDuplicates(["id"])


def scan_listing(spark, d):
    f = table(spark, d, "files").select("id", "branch_id", "path", "size").distinct()
    return f.where(~T.in_ignored_dir(F.col("path"))).select("branch_id", "path", T.extension(F.col("path")).alias("extension"), "size", T.language(F.col("path")).alias("language"))


def _lang_sql(p):
    name = f"lower(regexp_extract({p}, '([^/]*)$', 1))"
    ext = f"lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1))"
    cases = " ".join(f"when {ext} = '{e}' then '{x}'" for e, x in T.LANGUAGES.items())
    return f"case when {name} in ('dockerfile', 'containerfile') or starts_with({name}, 'dockerfile.') or starts_with({name}, 'containerfile.') or ends_with({name}, '.dockerfile') or ends_with({name}, '.containerfile') then 'dockerfile' when regexp_full_match({name}, '(?:docker-)?compose(?:\\.[^.]+)*\\.ya?ml') then 'docker-compose' {cases} end"


_IGNORED = ", ".join(f"'{x}'" for x in T.IGNORED_DIRS)
_SCANNED = (
    "texts as (select distinct branch_id, path, analysis.raw_text as raw_text from files where analysis.raw_text is not null and not regexp_matches(lower(path), '(?:"
    + "|".join(s.replace(".", "\\.") for s in T.BINARY_SUFFIXES)
    + ")$') and octet_length(encode(analysis.raw_text)) <= 400000),\n"
    "arr as (select branch_id, path, string_split(regexp_replace(raw_text, '\\r\\n?', chr(10), 'g'), chr(10)) as a from texts),\n"
    "cut as (select branch_id, path, case when a[-1] = '' then a[1:len(a) - 1] else a end as a from arr),\n"
    "lines as (select branch_id, path, unnest(range(1, len(a) + 1)) as line, unnest(a) as text from cut)"
)


def _rule_sql():
    out = []
    for i, (r, s, c, p) in enumerate(issues.RULES):
        if r == "yaml-unsafe-load":
            test = "regexp_matches(text, 'yaml\\.load\\s*\\(') and not regexp_matches(text, 'yaml\\.load\\s*\\(.*Loader\\s*=\\s*yaml\\.SafeLoader')"
        else:
            q = p.replace("(?U)", "").replace("'", "''")
            test = f"regexp_matches(text, '{q}')"
        out.append(f"select branch_id, path, '{r}' as id, '{s}' as severity, '{c}' as category, line::int as line, {i} as ord, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) as snippet from lines where {test}")
    out.append("select branch_id, path, 'large-file', 'low', 'quality', 1, 20, len(a) || ' lines' from cut where len(a) > 600")
    return "with " + _SCANNED + ",\nfound as (" + "\nunion all ".join(out) + ")\n"


_FOUND = _rule_sql()


def issue_findings(spark, d):
    return issues.findings(table(spark, d, "files"))


def issue_summary(spark, d):
    """Branches without findings have zeros."""
    branches = table(spark, d, "files").select("branch_id").distinct()
    return branches.join(issues.summary(issue_findings(spark, d)), "branch_id", "left").fillna(0)


def issue_file_risk(spark, d):
    return issues.file_risk(issue_findings(spark, d))


def issue_top_files(spark, d):
    """The ten riskiest files of all branches."""
    return issue_file_risk(spark, d).orderBy(F.desc("risk_score"), "path", "branch_id").limit(10)


def large_files(spark, d):
    return issues.large_files(table(spark, d, "files"), 150)


def issues_by_file(spark, d):
    return issues.by_file(issue_findings(spark, d)).select("branch_id", "path", F.size("findings").alias("n_findings"), F.col("findings")[0]["id"].alias("first_id"))


def text_chunks(spark, d):
    f = _once(table(spark, d, "files")).where(F.col("analysis.raw_text").isNotNull())
    return chunking.text_windows(f.select("branch_id", "path", F.col("analysis.raw_text").alias("raw_text")))


def file_chunks(spark, d):
    return chunking.file_chunks(_once(table(spark, d, "files"))).groupBy("branch_id", "type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def chunk_ids(spark, d):
    return chunking.with_chunk_id(table(spark, d, "chunks").drop("chunk_id").distinct()).select("branch_id", "path", "name", "start_line", "chunk_id")


def content_hash(spark, d):
    f = table(spark, d, "files").select("id", "content_hash", F.sha2("analysis.raw_text", 256).alias("digest")).distinct()
    return f.select("id", "digest", (F.lower("content_hash") == F.col("digest")).alias("agrees"))


def tokenize(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.tokenize(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def url_normalise(spark, d):
    return table(spark, d, "repositories").select("id", T.normal_url(F.col("url")).alias("name"))


def layer_of_files(spark, d):
    return table(spark, d, "files").select("id", "path").distinct().select("id", T.layer(F.col("path")).alias("layer"))


def file_info(spark, d):
    """FN24-25: sorted names of each file."""
    f = _once(table(spark, d, "files")).where(F.col("analysis").isNotNull())
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), "|")
    return f.select("id", T.language(F.col("path")).alias("language"), names(F.transform("analysis.functions", lambda x: x["name"])).alias("functions"), names(F.col("analysis.classes")).alias("classes"), names(F.col("analysis.imports")).alias("imports"))


def folder_scope(spark, d):
    return table(spark, d, "files").select("branch_id", "path").distinct().where(T.in_folder(F.col("path"), "src/")).groupBy("branch_id").agg(F.count(F.lit(1)).alias("n_files"))


def sample_files(spark, d):
    """SRC5: the first files by path that have an analysis."""
    return table(spark, d, "files").where(F.col("analysis").isNotNull()).select("path", "id").distinct().orderBy("path", "id").limit(20)


_SRC_NAMES = "array_to_string(list_sort(list_distinct(coalesce({}, []))), '|')"
QUERIES = {f.__name__: f for f in (scan_listing, issue_findings, issue_summary, issue_file_risk, issue_top_files, issues_by_file, large_files, text_chunks, file_chunks, chunk_ids, content_hash, tokenize, url_normalise, layer_of_files, file_info, folder_scope, sample_files)}
_WINDOWS = """select branch_id, path, start_line::int as start_line, end_line::int as end_line, text from (
  select branch_id, path, (s + 1) as start_line, least(s + 40, len(a)) as end_line, left(t, 3000) as text, row_number() over (partition by id order by s) as rn from (
    select id, branch_id, path, a, s, regexp_replace(array_to_string(a[s + 1:s + 40], chr(10)), '^\\s+|\\s+$', '', 'g') as t from (
      select id, branch_id, path, a, unnest(range(0, len(a), 40)) as s from (select distinct id, branch_id, path, string_split(analysis.raw_text, chr(10)) as a from files where analysis.raw_text is not null{}))) where t <> '') where rn <= 12"""
SQL = {
    "scan_listing": f"select branch_id, path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1) as extension, size, {_lang_sql('path')} as language from (select distinct id, branch_id, path, size from files) where not list_has_any(string_split(path, '/')[1:len(string_split(path, '/')) - 1], [{_IGNORED}])",
    "issue_findings": _FOUND + "select * from found",
    "issue_summary": _FOUND + "select b.branch_id, count(id) as total, " + ", ".join(f"count(id) filter (severity = '{s}') as {s}" for s in issues.SEVERITIES) + " from (select distinct branch_id from files) b left join found using (branch_id) group by 1",
    "issue_file_risk": _FOUND + "select branch_id, path, sum(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end)::bigint as risk_score, count(*) as n_findings from found group by 1, 2",
    "issue_top_files": _FOUND + "select branch_id, path, sum(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end)::bigint as risk_score, count(*) as n_findings from found group by 1, 2 order by 3 desc, 2, 1 limit 10",
    "issues_by_file": _FOUND + "select branch_id, path, count(*)::int as n_findings, arg_min(id, ord) as first_id from found group by 1, 2",
    "large_files": "with " + _SCANNED + " select branch_id, path, len(a)::int as n_lines from cut where len(a) > 150",
    "text_chunks": _WINDOWS.format(""),
    "file_chunks": """with f as (select distinct id, branch_id, path, analysis as a from files where analysis is not null),
c as (select branch_id, 'function' as type, x.code as text from (select branch_id, unnest(a.functions) as x from f)
 union all select branch_id, 'class', 'Class: ' || c from (select branch_id, unnest(a.classes) as c from f)
 union all select branch_id, x.type, x.code from (select branch_id, unnest(a.blocks) as x from f)
 union all select branch_id, 'text', text from (""" + _WINDOWS.format(" and coalesce(len(analysis.functions), 0) = 0 and coalesce(len(analysis.classes), 0) = 0") + """))
select branch_id, type, count(*) as n_chunks, sum(length(text))::bigint as n_chars from c group by 1, 2""",
    "content_hash": "select distinct id, sha256(analysis.raw_text) as digest, lower(content_hash) = sha256(analysis.raw_text) as agrees from files",
    "tokenize": "select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z][A-Za-z0-9_]*|[0-9]+'), lambda x: lower(x)) as t from documents where text is not null)",
    "url_normalise": "select id, regexp_replace(regexp_replace(regexp_replace(rtrim(lower(trim(url)), '/'), '\\.git$', ''), '^(?:https://|http://|ssh://git@github\\.com/|git@github\\.com:)', ''), '^github\\.com/', '') as name from repositories",
    "layer_of_files": "select id, case " + " ".join(f"when regexp_matches('/' || lower(path) || '/', '/(?:{'|'.join(dirs)})/') then '{name}'" for name, dirs in T.LAYERS) + " end as layer from (select distinct id, path from files)",
    "file_info": f"select id, {_lang_sql('path')} as language, {_SRC_NAMES.format('list_transform(a.functions, lambda x: x.name)')} as functions, {_SRC_NAMES.format('a.classes')} as classes, {_SRC_NAMES.format('a.imports')} as imports from (select distinct id, path, analysis as a from files where analysis is not null)",
    "folder_scope": "select branch_id, count(*) as n_files from (select distinct branch_id, path from files) where starts_with(path, 'src') group by 1",
    "sample_files": "select distinct path, id from files where analysis is not null order by path, id limit 20",
}
