"""Queries that read the rows of whole tables as files: every document as a Markdown file of its source, every page as an HTML file."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import audit, chunking, detect, parsers, reports
from codeloom.plans.registry import ORACLES, query
from codeloom.sources.repositories import described


def table_files(spark, sf_dir, table, project, key, text, ending):
    """Every row of a table as a file of a file table."""
    raw = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(project.alias("project_id"), F.concat_ws("", F.lit(f"{table}/"), F.col(key).cast("string"), F.lit(ending)).alias("file_path"), F.coalesce(text, F.lit("")).alias("content"))
    return described(raw.withColumn("n_bytes", F.octet_length("content").cast("long")))


def document_files(spark, sf_dir):
    return table_files(spark, sf_dir, "documents", F.col("source"), "doc_id", F.col("text"), ".md")


def page_files(spark, sf_dir):
    return table_files(spark, sf_dir, "pages", F.lit("pages"), "page_id", F.col("html"), ".html")


@query("parse_structure", r"""
with l as (select 'pages/' || page_id || '.html' as file_path, unnest(string_split(html, chr(10))) as line, unnest(range(1, 1 + len(string_split(html, chr(10))))) as n from pages where html is not null)
select 'pages' as project_id, file_path, 'tag' as "table", 'tag' as kind, unnest(regexp_extract_all(line, '<([a-zA-Z][\w-]*)', 1)) as name, cast(n as int) as line, cast(null as varchar) as detail from l""")
def parse_structure(spark, sf_dir):
    """Tags of every page."""
    parsed = parsers.parse_files(page_files(spark, sf_dir))
    return parsed.where("table not in ('symbol', 'import')").select("project_id", "file_path", "table", "kind", "name", "line", "detail")


@query("environment_variables", r"""
select distinct source as project_id, name, '***referenced***' as value, 'documents/' || doc_id || '.md' as source, 'reference' as detected
from (select source, doc_id, unnest(regexp_extract_all(text, '\bprocess\.env\.([A-Za-z_]\w*)', 1)) as name from documents) qualify row_number() over (partition by project_id, name order by 'documents/' || doc_id || '.md') = 1""")
def environment_variables(spark, sf_dir):
    return detect.environment(document_files(spark, sf_dir))


_CHUNKS = r"""
f as (select source as project_id, 'documents/' || doc_id || '.md' as file_path, text as content, string_split(text, chr(10)) as l, cast(ceil(length(text) / cast(3.5 as double)) as bigint) as tok from documents where text <> ''),
w as (select *, case when tok <= 500 then len(l) else greatest(1, 500 * len(l) // tok) end as w from f),
p as (select project_id, file_path, content, tok, len(l) as n, w, unnest(range(0, len(l), w)) as i, l from w),
c as (select project_id, file_path, i, least(i + w, n) - 1 as e, case when tok <= 500 then content else trim(array_to_string(l[i + 1:i + w], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) end as content, tok > 500 as sub from p)"""


@query("code_chunks", "with " + _CHUNKS + """
select project_id, file_path, 'Markdown' as language, cast(row_number() over (partition by file_path order by i) - 1 as int) as chunk_no, cast(i as int) as start_line, cast(e as int) as end_line, content, cast(null as varchar) as function_name, cast(null as varchar) as symbol_type,
 cast(ceil(length(content) / cast(3.5 as double)) as int) as token_count, sub as is_sub_chunk, file_path || ':' || i || ':' || e as chunk_hash from c where content <> ''""")
def code_chunks(spark, sf_dir):
    return chunking.chunk_files(document_files(spark, sf_dir)).withColumn("chunk_hash", chunking.chunk_hash())


@query("embed_texts", "with " + _CHUNKS + """
select file_path || ':' || i || ':' || e as chunk_hash, sha256('File: ' || file_path || ' (lines ' || (i + 1) || '-' || e || ')' || chr(10) || chr(10) || content) as text_key from c where content <> ''""")
def embed_texts(spark, sf_dir):
    chunks = chunking.chunk_files(document_files(spark, sf_dir)).withColumn("chunk_hash", chunking.chunk_hash())
    return chunks.select("chunk_hash", F.sha2(chunking.embed_text(), 256).alias("text_key"))


@query("file_packs", """
with recursive s as (select source as project_id, 'documents/' || doc_id || '.md' as file_path, cast(ceil(length(coalesce(text, '')) / cast(3.5 as double)) as bigint) as t from documents),
r as (select *, row_number() over (partition by project_id order by file_path) as n from s),
g as (select project_id, file_path, n, 0 as pack_no, t as size from r where n = 1
 union all select r.project_id, r.file_path, r.n, case when g.size > 0 and g.size + r.t > 200 then g.pack_no + 1 else g.pack_no end, case when g.size > 0 and g.size + r.t > 200 then r.t else g.size + r.t end from g join r on r.project_id = g.project_id and r.n = g.n + 1)
select project_id, file_path, pack_no from g""")
def file_packs(spark, sf_dir):
    return chunking.pack_files(document_files(spark, sf_dir), "project_id", 200)


#: The checks in a dialect without lookahead: matches of the first pattern less those of the second.
_SECURITY = {c.check_id: (c.pattern, None) for c in audit.SECURITY} | {"http_url": (r"['\"]http://", r"['\"]http://(?:localhost|127\.)")}


def _found(patterns) -> str:
    count = lambda p: "len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))"
    return " union all ".join(f"select source as project_id, 'documents/' || doc_id || '.md' as file_path, '{c.check_id}' as check_id, '{c.severity}' as severity, " + count(patterns[c.check_id][0]) + (" - " + count(patterns[c.check_id][1]) if patterns[c.check_id][1] else "") + " as n from documents" for c in audit.SECURITY)


@query("security_findings", f"select project_id, file_path, check_id, severity, cast(n as int) as n from ({_found(_SECURITY)}) where n > 0")
def security_findings(spark, sf_dir):
    return audit.scan(document_files(spark, sf_dir), "project_id", "file_path", audit.SECURITY)


@query("codebase_summary", f"""
with packs as ({ORACLES["file_packs"].replace("200", "5000")}),
t as (select source as project_id, 'documents/' || doc_id || '.md' as file_path, cast(ceil(length(coalesce(text, '')) / cast(3.5 as double)) as bigint) as n from documents),
r as (select *, row_number() over (partition by project_id order by n desc, file_path) as k from t)
select project_id, (select count(distinct pack_no) from packs p where p.project_id = r.project_id) as n_packs, count(*) as n_files, cast(sum(n) as bigint) as n_tokens,
 count(*) || ' files, ' || cast(sum(n) as bigint) || ' tokens; largest: ' || string_agg(file_path || ' (' || n || ')', ', ' order by k) filter (where k <= 5) as summary from r group by project_id""")
def codebase_summary(spark, sf_dir):
    """Every source of the documents summarised over packs of 5,000 tokens."""
    return reports.codebase_summary(document_files(spark, sf_dir))
