"""Queries over the driver's tables, each with its oracle. documents stand for files (source = project, lang = language), pages
for landed web pages, embeddings for chunk vectors, conversations for sessions, events for progress and cache traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.vectors import cosine, fit_length
from codeloom.operators import chat, graph, index, metrics, relational, retrieval, views
from codeloom.plans.registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("project_id"), F.col("lang").alias("language"), F.col("text").alias("content"), F.col("n_chars").alias("n_bytes"), X.code_lines("text").alias("loc"), "doc_id")


# -- files and metrics -----------------------------------------------------------------------------------------------

_LOC = """(select count(*) from (select trim(x, chr(32) || chr(9) || chr(13)) as x from (select unnest(string_split(text, chr(10))) as x)) where x <> '' and not (starts_with(x, '//') or starts_with(x, '#')
 or starts_with(x, '--') or starts_with(x, ';') or starts_with(x, '%') or starts_with(x, '<!--')))"""


@query("project_rollup", f"""
with f as (select source, lang, n_chars, text, {_LOC} as loc from documents)
select source as project_id, count(*) as total_files, cast(sum(len(string_split(text, chr(10)))) as bigint) as total_lines, cast(sum(loc) as bigint) as total_loc,
 floor(sum(n_chars) / 1024.0 * 100 + 0.5) / 100 as total_size_kb, count(distinct lang) as n_languages, cast(sum(ceil(length(text) / 3.5)) as bigint) as token_estimate
from f group by source""")
def project_rollup(spark, sf_dir):
    return metrics.totals(files_of(t(spark, sf_dir, "documents")), "project_id")


@query("token_estimate", "select doc_id, cast(ceil(length(text) / cast(3.5 as double)) as bigint) as tokens from documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query("content_key", "select doc_id, sha256(text) as content_key from documents")
def content_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.content_key("text").alias("content_key"))


@query("loc_count", f"select doc_id, {_LOC} as loc, cast(len(string_split(text, chr(10))) as bigint) as n_lines from documents")
def loc_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.code_lines("text").cast("long").alias("loc"), F.size(X.lines("text")).cast("long").alias("n_lines"))


@query("maintainability", f"""
with f as (select source, {_LOC} as loc, len(string_split(text, chr(10))) as lines from documents),
p as (select source, count(*) as files, sum(loc) as loc, sum(lines) as lines from f group by source),
c as (select *, floor((lines - loc) / cast(lines as double) * 1000 + 0.5) / 10 as comment_percent, lines / cast(files as double) / 2 as cc from p),
d as (select *, floor(cc * 100 + 0.5) / 100 as avg_cc from c)
select source as project_id, comment_percent, avg_cc, floor(greatest(0, least(100, 100 - avg_cc * 3 - loc / cast(files as double) / 50 + comment_percent * 0.3)) * 100 + 0.5) / 100 as maintainability from d""")
def maintainability(spark, sf_dir):
    p = metrics.totals(files_of(t(spark, sf_dir, "documents")), "project_id")
    c = p.withColumn("comment_percent", metrics.comment_percent(F.col("total_lines"), F.col("total_loc"))).withColumn("avg_cc", X.round_half_up(F.col("total_lines") / F.col("total_files") / 2, 2))
    return c.select("project_id", "comment_percent", "avg_cc", metrics.maintainability(F.col("avg_cc"), F.col("total_loc"), F.col("total_files"), F.col("comment_percent")).alias("maintainability"))


@query("dimension_scores", """
with m as (select source, sum(n_chars) / 10.0 as loc, count(*) as files, avg(n_chars) / 400.0 as cc, max(n_chars) / 400.0 as maxcc, count(distinct lang) as depth from documents group by source),
s as (select source, loc / 1000 * 0.5 + files / 50.0 * 2.5 as a, cc * 0.5 + maxcc * 0.1 as b, depth * 0.8 + files * 0.03 + 0.4 as c, files / 40.0 * 2 + files / 80.0 * 2 + depth / 20.0 * 2 as d, (100 - 70) * 0.08 + greatest(0, 30 - depth) * 0.05 as e from m)
select source as project_id, round_even(cast(least(10, greatest(1, a)) as double), 1) as size_score, round_even(cast(least(10, greatest(1, b)) as double), 1) as complexity_score,
 round_even(cast(least(10, greatest(1, c)) as double), 1) as architecture_score, round_even(cast(least(10, greatest(1, d)) as double), 1) as surface_score, round_even(cast(least(10, greatest(1, e)) as double), 1) as quality_score from s""")
def dimension_scores(spark, sf_dir):
    m = t(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(
        (F.sum("n_chars") / 10.0).alias("total_loc"), F.count("*").alias("file_count"), (F.avg("n_chars") / 400.0).alias("avg_cc"), (F.max("n_chars") / 400.0).alias("max_cc"), F.count_distinct("lang").alias("folder_depth"))
    m = m.withColumns({"dep_chain_length": F.col("file_count") * 0.1, "circular_dep_count": F.lit(1), "route_count": F.col("file_count"), "async_count": F.col("file_count"), "class_count": F.col("folder_depth"), "maintainability": F.lit(70), "comment_percent": F.col("folder_depth")})
    return metrics.dimension_scores(m).select("project_id", "size_score", "complexity_score", "architecture_score", "surface_score", "quality_score")


@query("min_max_scale", """
with b as (select source, cast(sum(n_chars) as double) as v from documents group by source)
select source as project_id, (least(greatest(v, 1000.0), 500000.0) - 1000.0) / 499000.0 as scaled from b""")
def min_max_scale(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.sum("n_chars").alias("v")).select("project_id", X.min_max("v", 1000.0, 500000.0).alias("scaled"))


@query("chunk_windows", """
with f as (select doc_id, string_split(text, chr(10)) as l, cast(ceil(length(text) / cast(3.5 as double)) as bigint) as tok from documents),
n as (select doc_id, greatest(1, floor(500 * len(l) / cast(greatest(tok, 1) as double))) as w, unnest(l) as line, unnest(range(len(l))) as pos from f),
c as (select doc_id, cast(floor(pos / w) as bigint) as chunk_no, pos, line from n)
select doc_id, chunk_no, cast(min(pos) as bigint) as start_line, cast(max(pos) as bigint) as end_line, cast(sum(length(line)) + count(*) - 1 as bigint) as n_chars from c group by doc_id, chunk_no""")
def chunk_windows(spark, sf_dir):
    from codeloom.operators.chunking import line_windows

    docs = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return line_windows(docs, "doc_id").select("doc_id", "chunk_no", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"))


@query("complexity_decisions", r"""
with c as (select doc_id, cast(1 + len(regexp_extract_all(text, '\b(?:if|for|while|case|catch)\b|&&|\|\|')) + len(regexp_extract_all(text || ' ', '\?[^.?]')) as int) as cc from documents)
select doc_id, cc, case when cc <= 5 then 'low' when cc <= 10 then 'moderate' when cc <= 20 then 'high' when cc <= 50 then 'very high' else 'extreme' end as class from c""")
def complexity_decisions(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", metrics.decision_complexity("text").alias("cc")).withColumn("class", metrics.decision_class(F.col("cc")))


@query("halstead", r"""
with x as (select doc_id, regexp_extract_all(text, '(\w+|[^\s\w])') as w, text from documents),
v as (select doc_id, len(w) * log2(greatest(len(list_distinct(w)), 1)) as volume from x)
select doc_id, round(volume, 4) as volume, round(171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * 3 - 16.2 * ln(40), 4) as maintainability from v""")
def halstead(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", metrics.halstead_volume("text").alias("volume"))
    return d.select("doc_id", F.round("volume", 4).alias("volume"), F.round(metrics.halstead_maintainability(F.col("volume"), F.lit(3), F.lit(40)), 4).alias("maintainability"))


@query("folder_depth", """
with p as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path from pages),
f as (select host, len(string_split(path, '/')) - 1 as depth, string_split(path, '/') as s from p),
u as (select host, unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) as folder from f)
select f.host, cast(max(depth) as int) as max_depth, (select count(distinct folder) from u where u.host = f.host) as n_folders from f group by f.host""")
def folder_depth(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("file_path"))
    return metrics.folder_depth(p, "host")


# -- pages -----------------------------------------------------------------------------------------------------------

@query("url_parse", r"""
select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) as path,
 concat('/', split_part(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '/', 1)) as prefix from pages""")
def url_parse(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.lower(F.regexp_extract(u, "^https?://([^/?#]+)", 1)).alias("host"), F.regexp_extract(u, "^https?://[^/?#]+(/[^?#]*)", 1).alias("path"),
        F.concat(F.lit("/"), F.split_part(F.regexp_extract(u, "^https?://[^/?#]+/([^?#]*)", 1), F.lit("/"), F.lit(1))).alias("prefix"))


@query("routes_by_prefix", r"""
select concat('/', split_part(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '/', 1)) as prefix, count(*) as n_routes from pages group by 1""")
def routes_by_prefix(spark, sf_dir):
    return views.prefix_counts(t(spark, sf_dir, "pages"), F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1))


@query("html_tags", r"""
select tag, count(*) as n_tags, count(distinct page_id) as n_pages from (select page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9_-]*)', 1))) as tag from pages) group by tag""")
def html_tags(spark, sf_dir):
    from codeloom.operators.parsers import parse_files
    from codeloom.plans.projects import page_files

    tags = parse_files(page_files(spark, sf_dir)).where("table = 'tag'")
    return tags.groupBy(F.lower("name").alias("tag")).agg(F.count("*").alias("n_tags"), F.count_distinct("file_path").alias("n_pages"))


@query("html_assets", r"""
select page_id, lower(x[1]) as attribute, count(*) as n_assets from (select page_id, unnest(list_zip(regexp_extract_all(html, '(src|href)="([^"]*)"', 1), regexp_extract_all(html, '(src|href)="([^"]*)"', 2))) as x from pages) group by 1, 2""")
def html_assets(spark, sf_dir):
    pattern = F.lit('(src|href)="([^"]*)"')
    got = t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", pattern, F.lit(1))).alias("attribute"))
    return got.groupBy("page_id", F.lower("attribute").alias("attribute")).agg(F.count("*").alias("n_assets"))


@query("scraped_resources", r"""
with p as (select page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages), k as (select * from p qualify row_number() over (partition by host order by page_id) <= 3)
select page_id, host as technology, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as int) as n_links from k""")
def scraped_resources(spark, sf_dir):
    from codeloom.sources.repositories import page_facts, scrape_targets

    p = t(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("technology"))
    wanted = scrape_targets(p.select("technology", F.col("page_id").alias("rank")))
    return page_facts(wanted.withColumnRenamed("rank", "page_id").join(p.drop("technology"), "page_id")).select("page_id", "technology", "title", "n_links")


@query("scrape_batches", r"""
with h as (select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages) select cast(ceil(count(*) / 5.0) as bigint) as n_batches, cast(least(5, count(*)) as bigint) as largest from h""")
def scrape_batches(spark, sf_dir):
    from codeloom.sources.repositories import scrape_targets

    p = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("technology"), F.col("page_id").alias("rank"))
    each = scrape_targets(p).groupBy("batch").agg(F.count_distinct("technology").alias("n"))
    return each.agg(F.count("*").alias("n_batches"), F.max("n").alias("largest"))


_LAYER_SQL = "case " + " ".join(f"when regexp_matches(p, '{pat}') then '{name}'" for name, pat in X.LAYERS) + " else 'other' end"
_PHASE_SQL = "case " + " ".join(f"when regexp_matches(lower(p), '{pat}') then '{name}'" for name, pat, _ in X.PHASES) + " else 'unknown' end"


@query("layer_of_path", f"""
with u as (select doc_id, text, concat('x/', source, case doc_id % 7 when 0 then '/services/' when 1 then '/models/' when 2 then '/pages/' when 3 then '/utils/' when 4 then '/config/' when 5 then '/tests/' else '/x/' end, 'f', doc_id, '.js') as p from documents)
select doc_id, {_LAYER_SQL} as layer, {_PHASE_SQL.replace('lower(p)', "lower(p || ' ' || text)")} as phase from u""")
def layer_of_path(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, ("/services/", "/models/", "/pages/", "/utils/", "/config/", "/tests/", "/x/"))), (F.col("doc_id") % 7 + 1).cast("int"))
    p = F.concat(F.lit("x/"), "source", folder, F.lit("f"), F.col("doc_id").cast("string"), F.lit(".js"))
    return t(spark, sf_dir, "documents").select("doc_id", "text", p.alias("p")).select("doc_id", X.layer("p").alias("layer"), X.phase(F.concat_ws(" ", "p", "text")).alias("phase"))


@query("diagram_labels", r"""select page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') as id, regexp_replace(replace(url, '"', chr(39)), '[\[\]{}()<>|]', ' ', 'g') as label from pages""")
def diagram_labels(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.diagram_id("url").alias("id"), X.diagram_label("url").alias("label"))


# -- vectors ---------------------------------------------------------------------------------------------------------

#: Queries of a search: the rows whose id is divisible by 20, against all others.
_COS = """with q as (select vec_id, label, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0),
c as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
s as (select q.vec_id as query_id, c.vec_id as id, c.label, list_cosine_similarity(q.v, c.v) as score from q, c where q.vec_id <> c.vec_id)"""


def _search(spark, sf_dir):
    """(chunks, queries) of the embeddings."""
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("topk_similar", _COS + """
select query_id, id, cast(rank as int) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0.1) where rank <= 5""")
def topk_similar(spark, sf_dir):
    return retrieval.nearest(*_search(spark, sf_dir), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Learned cells in three sub-indexes; a vector's label stands for the language of its chunk. Recall is measured by a test."""
    chunks, queries = _search(spark, sf_dir)
    language = F.element_at(F.array(F.lit("JavaScript"), F.lit("Markdown"), F.lit("YAML")), (F.pmod("label", F.lit(3)) + 1).cast("int"))
    return index.ivf_search(chunks.withColumn("kind", retrieval.sub_index(language)), queries).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("hash_search")
def hash_search(spark, sf_dir):
    """Hash tables of random hyperplanes with several probes each. Recall is measured by a test."""
    return index.hash_search(*_search(spark, sf_dir)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("topk_per_label", _COS + """
select query_id, label, id, round(score, 6) as score from (select *, row_number() over (partition by query_id, label order by score desc, id) as rn from s) where rn = 1""")
def topk_per_label(spark, sf_dir):
    return retrieval.nearest_per(*_search(spark, sf_dir), "label").select("query_id", "label", "id", F.round("score", 6).alias("score"))


@query("zero_vector_quality", """
with z as (select count(*) as n, count(*) filter (where len(list_filter(embedding, lambda x: x <> 0)) = 0) as k from embeddings)
select n as n_vectors, k as n_zero, k * 100.0 / n as zero_percent, case when k * 100.0 / n > 50 then 'error' when k * 100.0 / n > 20 then 'warning' else 'ok' end as status from z""")
def zero_vector_quality(spark, sf_dir):
    return metrics.vector_quality(t(spark, sf_dir, "embeddings"))


@query("pair_cosine", """
select a.vec_id as a_id, b.vec_id as b_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def pair_cosine(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("w"))
    return e.select(F.col("vec_id").alias("a_id"), "embedding").join(b, "a_id").select("a_id", "b_id", F.round(cosine("embedding", "w"), 6).alias("similarity"))


@query("fit_length", """select vec_id, cast(80 as int) as n, round(list_sum(cast(embedding as double[])), 6) as total, round(list_sum(cast(embedding as double[])[1:16]), 6) as cut_total from embeddings""")
def fit_length_query(spark, sf_dir):
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(fit_length("embedding", 80)).alias("n"), total(fit_length("embedding", 80)).alias("total"), total(fit_length("embedding", 16)).alias("cut_total"))


@query("cell_index", """
with x as (select label, unnest(cast(embedding as double[])) as v, unnest(range(len(embedding))) as i from embeddings),
c as (select label, list(v order by i) as c from (select label, i, avg(v) as v from x group by label, i) group by label),
s as (select e.vec_id, c.label as cell, list_cosine_similarity(cast(e.embedding as double[]), c.c) as sim from embeddings e, c),
r as (select *, row_number() over (partition by vec_id order by sim desc, cell) as probe from s)
select vec_id, cell, cast(probe as int) as probe, round(sim, 6) as similarity from r where probe <= 2""")
def cell_index(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    cells = retrieval.centroids(e, "label").withColumnRenamed("label", "cell")
    return retrieval.nearest_cell(e, cells, "cell", 2).select("vec_id", "cell", "probe", F.round("similarity", 6).alias("similarity"))


@query("hit_filter_modes", _COS + """select query_id, count(*) filter (where score > 0.3) as strict, count(*) filter (where score >= 0.3) as inclusive, round(max(greatest(0, 1 - (1 - score))), 6) as best from s group by query_id""")
def hit_filter_modes(spark, sf_dir):
    return retrieval.hit_modes(*_search(spark, sf_dir)).withColumn("best", F.round("best", 6))


# -- conversations ---------------------------------------------------------------------------------------------------

@query("chat_history", "select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 10")
def chat_history(spark, sf_dir):
    return chat.last_n(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", 10).select("conv_id", "turn", "role", "text")


_FOLLOW = r"""with m as (select *, count(*) over w as prior, list(text) filter (where role = 'user') over w as earlier from conversations
 window w as (partition by conv_id order by turn rows between 10 preceding and 1 preceding)),
f as (select *, prior > 0 and (regexp_matches(lower(trim(text)), '^(and|also|what about|how about|why|can you|could you|tell me more|elaborate|go deeper|explain further|what else|show me)')
 or (regexp_matches(lower(text), '\b(it|this|that|these|those|they|them)\b') and length(trim(text)) < 60) or (length(trim(text)) < 30 and prior >= 2)) as is_follow_up from m where role = 'user')"""


@query("followup_flag", _FOLLOW + "select conv_id, turn, prior, is_follow_up from f")
def followup_flag(spark, sf_dir):
    return chat.follow_ups(t(spark, sf_dir, "conversations")).select("conv_id", "turn", "prior", "is_follow_up")


@query("followup_query", _FOLLOW + "select conv_id, turn, case when is_follow_up then text || chr(10) || 'Previous: ' || coalesce(array_to_string(earlier[-3:], ' '), '') else text end as query from f")
def followup_query(spark, sf_dir):
    return chat.follow_ups(t(spark, sf_dir, "conversations")).select("conv_id", "turn", "query")


@query("history_budget", """
with r as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4),
l as (select conv_id, turn, cast(ceil(length(case when role = 'user' then 'User: ' else 'Assistant: ' end || text) / cast(3.5 as double)) as bigint) as tokens from r)
select conv_id, turn, tokens from (select *, max(tokens) over (partition by conv_id order by turn) as used from l) where used <= 750""")
def history_budget(spark, sf_dir):
    return chat.history_budget(t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "tokens")


@query("context_budget", """
with d as (select source, doc_id, cast(ceil(length(text) / cast(3.5 as double)) as bigint) as tokens from documents),
r as (select *, sum(tokens) over (partition by source order by doc_id) as running from d),
o as (select *, count(*) filter (where running > 3500) over (partition by source order by doc_id) as over_ from r)
select source as project_id, doc_id, tokens, running > 3500 as truncated, cast(case when running > 3500 then 3500 - (running - tokens) else tokens end as bigint) as tokens_used from o where over_ = 0 or (over_ = 1 and running > 3500)""")
def context_budget(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), "doc_id", X.estimate_tokens("text").alias("tokens"))
    return chat.pack_chunks(d, "project_id", "doc_id", "tokens", 3500).select("project_id", "doc_id", "tokens", "truncated", "tokens_used")


@query("session_caps", """
with s as (select conv_id, conv_id % 3 as owner, count(*) as message_count, max(turn) as last_turn from conversations group by conv_id)
select owner, conv_id, message_count from s qualify row_number() over (partition by owner order by last_turn * 1000000 + conv_id desc) > 20""")
def session_caps(spark, sf_dir):
    s = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("m_")).withColumn("owner", F.col("conv_id") % 3).withColumn("updated_at", F.col("m_") * 1000000 + F.col("conv_id"))
    return chat.evicted(s, ["owner"]).select("owner", "conv_id", "message_count")


@query("session_choice", """
with s as (select conv_id, conv_id % 7 as owner, count(*) as message_count, max(turn) as last_turn from conversations group by conv_id)
select owner, conv_id, message_count >= 5 as needs_new from s qualify row_number() over (partition by owner order by last_turn * 1000000 + conv_id desc) = 1""")
def session_choice(spark, sf_dir):
    s = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("m_")).withColumn("owner", F.col("conv_id") % 7).withColumn("updated_at", F.col("m_") * 1000000 + F.col("conv_id"))
    return chat.session_to_use(s, ["owner"], most=5).select("owner", "conv_id", "needs_new")


@query("file_refs", r"""
with s as (select doc_id, replace(text, '`', '') || ' see `src/' || source || '/m' || doc_id || '.py` and file:docs/' || doc_id || '.md' as said from documents)
select doc_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(said, 'file:([^\s`"]+)', 1), regexp_extract_all(said, '`([^`]+\.(?:js|jsx|ts|tsx|py|java|go|rs|cpp|c|h|css|html|json|yaml|yml))`', 1)), regexp_extract_all(said, '\b(src/[\w/.-]+\.(?:js|jsx|ts|tsx|py|java))\b', 1)))) as file_path from s""")
def file_refs(spark, sf_dir):
    """File names anywhere in whole texts, each followed by two that are there for sure."""
    d = F.col("doc_id").cast("string")
    said = F.concat(F.replace("text", F.lit("`"), F.lit("")), F.lit(" see `src/"), "source", F.lit("/m"), d, F.lit(".py` and file:docs/"), d, F.lit(".md"))
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(X.file_references(said)).alias("file_path"))


@query("document_file_refs", r"""
select doc_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(text, 'file:([^\s`"]+)', 1), regexp_extract_all(text, '`([^`]+\.(?:js|jsx|ts|tsx|py|java|go|rs|cpp|c|h|css|html|json|yaml|yml))`', 1)), regexp_extract_all(text, '\b(src/[\w/.-]+\.(?:js|jsx|ts|tsx|py|java))\b', 1)))) as file_path from documents""")
def document_file_refs(spark, sf_dir):
    """File names that the documents name by themselves."""
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(X.file_references("text")).alias("file_path"))


@query("answer_cache", """
with c as (select sha256(text) as k, max(turn) as turn from conversations where role = 'user' group by 1)
select q.conv_id, q.turn, 'chat_' || sha256(q.text) as cache_key, c.turn >= 3 as from_cache from conversations q join c on c.k = sha256(q.text) where q.role = 'user'""")
def answer_cache(spark, sf_dir):
    q = t(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("text", "question")
    cache = q.groupBy("question").agg(F.max("turn").alias("expires_at")).select(F.concat(F.lit("chat_"), F.sha2("question", 256)).alias("cache_key"), F.lit("answer").alias("answer"), "expires_at")
    return chat.cache_lookup(q, cache, F.lit(2)).select("conv_id", "turn", "cache_key", "from_cache")


@query("token_stream", """select conv_id, turn, string_agg(role, '|') over (partition by conv_id order by turn rows between unbounded preceding and current row) as so_far from conversations""")
def token_stream(spark, sf_dir):
    return chat.token_stream(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "|").select("conv_id", "turn", "so_far")


# -- events ----------------------------------------------------------------------------------------------------------

@query("rate_limit", """
with h as (select *, time_bucket(interval '15 minutes', ts, timestamp '1970-01-01') as w from events)
select event_id, user_id, w as window_start from h qualify row_number() over (partition by user_id, w order by ts, event_id) > 1""")
def rate_limit(spark, sf_dir):
    from codeloom.streaming.limits import excess

    return excess(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "15 minutes", 1).select("event_id", "user_id", "window_start")


@query("session_segments", """
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as n from g)
select user_id, min(ts) as started, max(ts) as ended, count(*) as n_events from s group by user_id, n""")
def session_segments(spark, sf_dir):
    from codeloom.streaming.limits import segments

    return segments(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", "30 minutes")


@query("latest_status", "select user_id, event_type as phase, ts as updated_at from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_status(spark, sf_dir):
    from codeloom.streaming.progress import latest

    return latest(t(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("throttled_progress", "select event_id, user_id, n from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n from events) where n % 5 = 0")
def throttled_progress(spark, sf_dir):
    from codeloom.streaming.progress import throttled

    return throttled(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", F.col("n").cast("long").alias("n"))


@query("ttl_live", "select user_id, count(*) as n_live from events where ts + interval '24 hours' > (select max(ts) from events) group by user_id")
def ttl_live(spark, sf_dir):
    from codeloom.streaming.limits import live

    e = t(spark, sf_dir, "events")
    return live(e, "ts", "24 hours", e.agg(F.max("ts")).scalar()).groupBy("user_id").agg(F.count("*").alias("n_live"))


@query("aged_out", "select event_id from events where ts < (select max(ts) from events) - interval '24 hours'")
def aged_out(spark, sf_dir):
    from codeloom.streaming.limits import aged

    e = t(spark, sf_dir, "events")
    return aged(e, "ts", "24 hours", e.agg(F.max("ts")).scalar()).select("event_id")


@query("props_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def props_json(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("props_variant", "select cast(json_extract(props, '$.k') as int) as k, count(*) as n from events group by 1")
def props_variant(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")).agg(F.count("*").alias("n"))


@query("breaker_state", """
with recursive e as (select user_id, event_id, ts, event_type = 'error' as failed, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, event_id, n, case when failed then 1 else 0 end as fails, timestamp '1900-01-01' as until, 'closed' as state from e where n = 1
 union all select e.user_id, e.event_id, e.n, case when e.ts < r.until then r.fails when not e.failed or r.fails + 1 >= 5 then 0 else r.fails + 1 end,
  case when e.ts >= r.until and e.failed and r.fails + 1 >= 5 then e.ts + interval '30 seconds' else r.until end, case when e.ts < r.until then 'open' when e.failed and r.fails + 1 >= 5 then 'opened' else 'closed' end
 from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, event_id, state from r""")
def breaker_state(spark, sf_dir):
    from codeloom.streaming.breaker import replay

    return replay(t(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "event_id")


@query("family_rotation", """
with f as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r, count(*) filter (where event_type = 'error') over (partition by user_id) as reused from events)
select user_id, event_id, reused > 20 as revoked from f where r = 1""")
def family_rotation(spark, sf_dir):
    from codeloom.streaming.limits import current_tokens

    e = t(spark, sf_dir, "events").withColumn("reused", F.col("event_type") == "error")
    return current_tokens(e, "user_id", ["ts", "event_id"], "reused", 20).select("user_id", "event_id", "revoked")


@query("event_stream_frames", """select event_id, 'data: {"phase":"' || event_type || '","user_id":' || user_id || '}' || chr(10) || chr(10) as frame from events""")
def event_stream_frames(spark, sf_dir):
    from codeloom.streaming.progress import frames

    return t(spark, sf_dir, "events").select("event_id", frames(F.struct(F.col("event_type").alias("phase"), "user_id")).alias("frame"))


@query("chunked_events", """
select user_id, 2 * (row_number() over (partition by user_id order by event_id) - 1) as line, event_type as phase from events""")
def chunked_events(spark, sf_dir):
    """Every user's events as a stream of frames, cut anywhere, put together again and read."""
    from codeloom.streaming.progress import frames, lines

    text = t(spark, sf_dir, "events").select("user_id", "event_id", frames(F.struct(F.col("event_type").alias("phase"), "user_id")).alias("f"))
    at = (F.col("event_id") * 7 % (F.length("f") + 1)).cast("int")
    pieces = F.posexplode(F.array(F.substr("f", F.lit(1), at), F.substr("f", at + 1)))
    chunks = text.select("user_id", "event_id", pieces.alias("i", "chunk")).select("user_id", (F.col("event_id") * 2 + F.col("i")).alias("seq"), "chunk")
    return views.parse_frames(lines(chunks, "user_id", "seq", "chunk"), "text").select("user_id", "line", F.col("event.phase").alias("phase"))


# -- relational shapes -----------------------------------------------------------------------------------------------

@query("paginate", "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def paginate(spark, sf_dir):
    return relational.page(t(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3, 80).select("o_orderkey", "o_custkey", "o_totalprice")


@query("page_count", "select count(*) as n_rows, cast(ceil(count(*) / 10.0) as bigint) as n_pages from orders")
def page_count(spark, sf_dir):
    return relational.page_count(t(spark, sf_dir, "orders"), 10)


@query("upsert_rows", "select c_custkey, c_acctbal, 'new' as origin from customer where c_custkey % 3 = 0 union all select c_custkey, c_acctbal, 'old' from customer where c_custkey % 3 <> 0")
def upsert_rows(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return relational.upsert(c.withColumn("origin", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("origin", F.lit("new")), ["c_custkey"])


@query("cascade_delete", """select 'orders' as name, o_orderkey as id, o_custkey as project_id from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')
 union all select 'customer', c_custkey, c_custkey from customer where c_mktsegment <> 'BUILDING'""")
def cascade_delete(spark, sf_dir):
    from codeloom.sources.sinks import cascade_delete as delete

    c = t(spark, sf_dir, "customer")
    tables = {"orders": t(spark, sf_dir, "orders").select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id")), "customer": c.select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("project_id"))}
    left = delete(tables, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("project_id")))
    return left["orders"].unionByName(left["customer"]).select("name", "id", "project_id")


@query("ownership", "select o_orderkey, case when o_custkey is null then 'missing' when o_custkey % 10 = 1 then 'ok' else 'forbidden' end as access from orders")
def ownership(spark, sf_dir):
    return relational.owned(t(spark, sf_dir, "orders").withColumn("u_", F.col("o_custkey") % 10), "u_", F.lit(1)).select("o_orderkey", "access")


@query("node_search", "select c_custkey, c_name from customer where contains(lower(c_name), '00') and (contains(lower(c_mktsegment), 'auto') or contains(lower(c_name), 'auto'))")
def node_search(spark, sf_dir):
    return relational.search(relational.search(t(spark, sf_dir, "customer"), ["c_name"], "00"), ["c_mktsegment", "c_name"], "AUTO").select("c_custkey", "c_name")


@query("incident_edges", """
with n as (select c_custkey from customer where c_mktsegment = 'MACHINERY'), e as (select distinct o_custkey as source, o_orderkey as target from orders)
select source, target from e where source in (select c_custkey from n) or target in (select c_custkey from n)""")
def incident_edges(spark, sf_dir):
    return relational.incident(_order_edges(spark, sf_dir), t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'"), "c_custkey", "source", "target")


def _order_edges(spark, sf_dir):
    """An edge from the customer to the order for every order, by their whole keys; an order's key can be a customer's, so paths go on."""
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target")).distinct()


@query("element_match", "select distinct o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def element_match(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))).alias("o"))
    return relational.any_matches(rows, "o", p="1-URGENT", s="F").select("o_custkey")


@query("category_counts", "select event_type, count(*) as n, count(distinct user_id) as n_users from events group by event_type")
def category_counts(spark, sf_dir):
    return relational.counts(t(spark, sf_dir, "events"), "event_type", "user_id").select("event_type", "n", F.col("n_distinct").alias("n_users"))


@query("fallback_filter", "select doc_id, 'none' as wanted from documents union all select doc_id, 'fr' from documents where lang = 'fr'")
def fallback_filter(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    some = lambda lang: relational.or_all(d, F.col("lang") == lang).select("doc_id", F.lit(lang).alias("wanted"))
    return some("none").unionByName(some("fr"))


@query("first_wins", "select doc_id, source from documents qualify row_number() over (partition by lower(text[1:40]) order by doc_id) = 1")
def first_wins(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("key", F.lower(F.substring("text", 1, 40)))
    return relational.first_wins(d, ["key"], ["doc_id"]).select("doc_id", "source")


@query("cache_dedupe", "select sha256(text) as content_key, count(*) as n_copies, min(doc_id) as first_id from documents group by 1")
def cache_dedupe(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(X.content_key("text").alias("content_key")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"))


@query("ordered_union", """
with u as (select o_orderpriority as name, 0 as part, o_orderkey as o from orders where o_orderstatus = 'F' union all select c_mktsegment, 1, c_custkey from customer union all select o_orderpriority, 2, o_orderkey from orders)
select name, cast(min(part) as int) as part from u group by name""")
def ordered_union(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    a = o.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return relational.ordered_union([a.where("o_orderstatus = 'F'"), c.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord")), a], "name", "ord")


@query("map_merge", """select c_custkey, case when c_custkey % 2 = 0 then 'dev' else 'main' end as a, 'main' as b from customer""")
def map_merge(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("deps", F.create_map(F.lit("a"), F.lit("main"), F.lit("b"), F.lit("main"))).withColumn("dev", F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("dev"))))
    return c.withColumn("m", relational.merged_maps("deps", "dev")).select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("stack_division", """
with need as (select * from (values ('all', '1-URGENT'), ('all', '2-HIGH'), ('all', '3-MEDIUM'), ('low', '5-LOW'), ('low', '4-NOT SPECIFIED')) v(stack, item)),
g as (select o.o_custkey, n.stack, count(distinct n.item) as k from orders o join need n on n.item = o.o_orderpriority group by 1, 2), w as (select stack, count(*) as r from need group by 1)
select o_custkey, g.stack, k as n_matched, r as n_required, case when k >= r then 'full' else 'partial' end as match_type from g join w on g.stack = w.stack where k >= 2""")
def stack_division(spark, sf_dir):
    need = spark.createDataFrame([("all", "1-URGENT", 2), ("all", "2-HIGH", 2), ("all", "3-MEDIUM", 2), ("low", "5-LOW", 2), ("low", "4-NOT SPECIFIED", 2)], "stack string, item string, least int")
    return relational.division(t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("item")), F.broadcast(need), "o_custkey", "item", "stack", "least")


@query("islands", "with p as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 10), g as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from p) select l_orderkey, min(l_linenumber) as first_pos, max(l_linenumber) as last_pos, count(*) as n from g group by l_orderkey, g")
def islands(spark, sf_dir):
    return relational.islands(t(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("step_numbering", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as step, (row_number() over (partition by user_id order by ts, event_id) - 1) * 80 as y, greatest(4000, 800 * count(*) over (partition by user_id)) as total_ms from events")
def step_numbering(spark, sf_dir):
    s = graph.number_steps(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return graph.animate(s, "user_id").select("user_id", "event_id", F.col("step").cast("long").alias("step"), F.col("y").cast("long").alias("y"), F.col("total_ms").cast("long").alias("total_ms"))


@query("phase_groups", "with s as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as step from events) select user_id, event_type as phase, count(*) as n_steps, min(step) as first_step, max(step) as last_step, count(*) * 800 as duration_ms from s group by 1, 2")
def phase_groups(spark, sf_dir):
    s = graph.number_steps(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).withColumnRenamed("event_type", "phase")
    return graph.phase_groups(s, "user_id").withColumn("first_step", F.col("first_step").cast("long")).withColumn("last_step", F.col("last_step").cast("long"))


@query("relationship_graph", "select n_name as nation, r_name as region, case when n_name like '%A' then 'one-to-many' else 'one-to-one' end as kind from nation join region on r_regionkey = n_regionkey")
def relationship_graph(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    models = r.select(F.lit(1).alias("project_id"), F.initcap("r_name").alias("name"), "r_regionkey")
    fields = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(1).alias("project_id"), F.col("n_name").alias("model"), F.col("n_name").alias("name"), F.when(F.col("n_name").endswith("A"), "Array").otherwise("String").alias("type"), F.upper("r_name").alias("ref"))
    return graph.relationships(models, fields).where(~F.col("field").endswith("s")).select(F.col("from_model").alias("nation"), F.upper("to_model").alias("region"), "kind")


@query("layer_graph", """
with e as (select distinct cast(c_nationkey as varchar) as project_id, case c_mktsegment when 'BUILDING' then 'services' when 'MACHINERY' then 'models' else 'utils' end || '/c' || c_custkey || '.js' as source, 'routes/o' || o_orderkey || '.js' as target, case c_mktsegment when 'BUILDING' then 'service' when 'MACHINERY' then 'model' else 'util' end as source_layer from orders join customer on c_custkey = o_custkey)
select project_id, source_layer, 'route' as target_layer, count(*) as edge_count, count(distinct (source, target)) as file_pairs from e group by 1, 2""")
def layer_graph(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("project_id"))
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "services").when(F.col("c_mktsegment") == "MACHINERY", "models").otherwise("utils")
    e = t(spark, sf_dir, "orders").join(c, "o_custkey").select("project_id", F.concat(folder, F.lit("/c"), F.col("o_custkey").cast("string"), F.lit(".js")).alias("source"), F.concat(F.lit("routes/o"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("target"))
    return graph.layer_edges(e)


@query("disconnected", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def disconnected(spark, sf_dir):
    e = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", (F.lit(-1) * F.col("o_orderkey") - 1).alias("target"))
    return graph.disconnected(t(spark, sf_dir, "customer").select("c_custkey"), e, "c_custkey", "o_custkey", "target")


@query("recursive_reach", """
with recursive e as (select distinct o_custkey as source, o_orderkey as target from orders),
r as (select cast(30 as bigint) as node, 0 as depth union select e.target, r.depth + 1 from r join e on e.source = r.node where r.depth < 6)
select node, cast(min(depth) as int) as depth from r group by node""")
def recursive_reach(spark, sf_dir):
    roots = spark.createDataFrame([(0, 30)], "project_id int, root long")
    return graph.reach(_order_edges(spark, sf_dir).withColumn("project_id", F.lit(0)), roots, depth=6).select("node", "depth")


@query("cycles", """
with c as (select c_nationkey as project_id, 'c' || lpad(cast(c_custkey as varchar), 9, '0') as name from customer)
select project_id, string_agg(name, ' > ' order by name) || ' > ' || min(name) as cycle from c group by project_id""")
def cycles(spark, sf_dir):
    """Customers of a nation in a ring: each leads to the next, the last to the first."""
    w = Window.partitionBy("project_id").orderBy("source")
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("source"))
    e = c.withColumn("target", F.coalesce(F.lead("source").over(w), F.min("source").over(Window.partitionBy("project_id"))))
    return graph.cycles(e).select("project_id", graph.canonical_cycle("cycle").alias("cycle"))


@query("order_cycles")
def order_cycles(spark, sf_dir):
    """Cycles that the back edges of a depth-first walk close inside each strong component; all simple cycles of this graph are too many for recursive SQL."""
    key = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    found = graph.cycles_of_components(_order_edges(spark, sf_dir).select(key("source").alias("source"), key("target").alias("target")))
    found = found.select(graph.canonical_cycle("cycle").alias("cycle")).distinct()
    return found.select(F.array_join(F.transform(F.split("cycle", " > "), lambda x: x.cast("long").cast("string")), " > ").alias("cycle"))


@query("order_components", """
with recursive e as (select distinct o_custkey as s, o_orderkey as t from orders), f as (select * from e where t in (select s from e)),
r as (select s, t from f union select r.s, f.t from r join f on r.t = f.s),
c as (select a.s as node, min(a.t) as component from r a join r b on a.s = b.t and a.t = b.s group by a.s)
select node, component, count(*) over (partition by component) as size from c""")
def order_components(spark, sf_dir):
    """Nodes on a cycle of the whole graph of orders, by strong component."""
    return graph.strong_components(_order_edges(spark, sf_dir))


@query("library_rollup", r"""
with w as (select doc_id, source, lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) as lib from documents)
select lib, count(*) as usage_count, count(distinct doc_id) as n_files, count(distinct source) as n_specifiers, lib in ('the', 'of') as is_dev from w group by lib""")
def library_rollup(spark, sf_dir):
    """Every word of the documents, of whatever length."""
    from codeloom.operators.detect import library_usage

    d = t(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), F.lit(1))).alias("w"))
    return library_usage(d.select(F.lower("w").alias("lib"), "doc_id", "source"), "lib", "doc_id", "source", ("the", "of")).withColumnRenamed("name", "lib")


@query("concept_index", """
select lang as concept, string_agg(distinct source, ',' order by source) as technologies, count(distinct source) as n from documents join labels on labels.doc_id = documents.doc_id where quality = 1 group by lang""")
def concept_index(spark, sf_dir):
    from codeloom.operators.knowledge import concept_index as build

    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return build(d.select(F.col("source").alias("technology"), F.array("lang").alias("concepts"))).select("concept", F.array_join("technologies", ",").alias("technologies"), "n")


@query("question_stats", "select lang as category, source as difficulty, count(*) as n from documents group by grouping sets ((lang), (source))")
def question_stats(spark, sf_dir):
    from codeloom.operators.knowledge import question_stats as build

    return build(t(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("difficulty")))


@query("alias_lookup", """
with a as (select * from (values ('en', 'English'), ('fr', 'French'), ('de', 'German')) v(alias, name)) select doc_id, coalesce(a.name, lang) as name, a.name is not null as known from documents left join a on lower(lang) = a.alias""")
def alias_lookup(spark, sf_dir):
    from codeloom.operators.knowledge import canonical

    aliases = spark.createDataFrame([("en", "English"), ("fr", "French"), ("de", "German")], "alias string, name string")
    return canonical(t(spark, sf_dir, "documents"), "lang", aliases).select("doc_id", "name", "known")


@query("severity_summary", r"""
with c as (select * from (values ('shout', 'high', '!!'), ('table', 'low', ' \| '), ('mail', 'critical', '[a-z0-9]+@[a-z0-9.]+')) v(check_id, severity, pattern)),
h as (select doc_id, check_id, severity, len(regexp_extract_all(text, pattern)) as n from documents, c)
select severity, cast(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as int) as position, cast(sum(n) as bigint) as n_issues, count(*) as n_files from h where n > 0 group by severity""")
def severity_summary(spark, sf_dir):
    from codeloom.operators.audit import Check, scan, summary

    checks = [Check("shout", "high", "!!"), Check("table", "low", r" \| "), Check("mail", "critical", "[a-z0-9]+@[a-z0-9.]+")]
    return summary(scan(t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id", checks))


@query("dashboard", "select count(*) filter (where quality = 1) as completed, cast(sum(n_chars) as bigint) as total_size, count(distinct source) as n_projects, count(distinct lang) as n_technologies from documents left join labels on labels.doc_id = documents.doc_id")
def dashboard(spark, sf_dir):
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.dashboard(d, F.col("quality") == 1, "n_chars", "source", "lang")


@query("difficulty_overview", """
with d as (select source, cast(sum(n_chars) as double) / 100000 as score from documents group by source), l as (select *, case when score < 0.5 then 'Beginner' when score < 1 then 'Intermediate' when score < 2 then 'Advanced' else 'Expert' end as level from d)
select level, count(*) as n_projects, floor(avg(score) * 10 + 0.5) / 10 as avg_score from l group by level""")
def difficulty_overview(spark, sf_dir):
    d = t(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars").cast("double") / 100000).alias("score"))
    level = F.when(F.col("score") < 0.5, "Beginner").when(F.col("score") < 1, "Intermediate").when(F.col("score") < 2, "Advanced").otherwise("Expert")
    return metrics.difficulty_overview(d.withColumn("level", level))


@query("password_strength", r"""
with p as (select c_custkey, c_name || case c_custkey % 4 when 0 then 'aB1!' when 1 then 'abc' when 2 then '' else 'XY99' end as pw from customer),
s as (select c_custkey, cast((length(pw) >= 8)::int + (length(pw) >= 12)::int + regexp_matches(pw, '[a-z]')::int + regexp_matches(pw, '[A-Z]')::int + regexp_matches(pw, '[0-9]')::int + regexp_matches(pw, '[^A-Za-z0-9]')::int as int) as score from p)
select c_custkey, score, case when score <= 1 then 'Very Weak' when score = 2 then 'Weak' when score = 3 then 'Fair' when score <= 5 then 'Strong' else 'Very Strong' end as label from s""")
def password_strength(spark, sf_dir):
    tail = F.element_at(F.array(F.lit("aB1!"), F.lit("abc"), F.lit(""), F.lit("XY99")), (F.col("c_custkey") % 4 + 1).cast("int"))
    s = t(spark, sf_dir, "customer").select("c_custkey", relational.password_score(F.concat("c_name", tail)).alias("score"))
    return s.withColumn("label", relational.password_label(F.col("score")))


@query("validation", r"""
select c_custkey, array_to_string(list_filter([case when not (length(c_name) between 2 and 100) then 'name' end, case when not regexp_matches(lower(c_name), '^[^@\s]+@[^@\s]+\.[^@\s]+$') then 'email' end,
 case when length(c_mktsegment) < 8 then 'password_length' end, case when not regexp_matches(c_mktsegment, '[A-Z]') then 'password_upper' end, case when not regexp_matches(c_mktsegment, '[a-z]') then 'password_lower' end,
 case when not regexp_matches(c_mktsegment, '[0-9]') then 'password_digit' end], lambda x: x is not null), ',') as errors from customer""")
def validation(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.array_join(relational.registration_errors(F.col("c_name"), F.lower("c_name"), F.col("c_mktsegment")), ",").alias("errors"))


@query("repo_urls", r"""
with u as (select doc_id, case doc_id % 4 when 0 then 'https://github.com/' || source || '/r' || doc_id || '.git' when 1 then 'https://gitlab.com/' || source || '/r' || doc_id when 2 then 'git@bitbucket.org:' || source || '/r' || doc_id || '.git' else 'https://example.org/' || source end as url from documents)
select doc_id, case doc_id % 4 when 0 then 'github' when 1 then 'gitlab' when 2 then 'bitbucket' else 'other' end as provider, case when doc_id % 4 < 3 then split_part(url, case when doc_id % 4 = 2 then ':' else '.com/' end, 2) end as rest from u""".replace("as rest from u", "as r from u").replace("select doc_id, case doc_id % 4 when 0 then 'github'", "select doc_id, provider, split_part(r, '/', 1) as owner, regexp_replace(split_part(r, '/', 2), '\\.git$', '') as repo from (select doc_id, case doc_id % 4 when 0 then 'github'") + ") where r is not null")
def repo_urls(spark, sf_dir):
    from codeloom.sources.repositories import parse_repo_url

    k, d = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), "source", F.lit("/r"), d, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://gitlab.com/"), "source", F.lit("/r"), d)).when(
        k == 2, F.concat(F.lit("git@bitbucket.org:"), "source", F.lit("/r"), d, F.lit(".git"))).otherwise(F.concat(F.lit("https://example.org/"), "source"))
    return t(spark, sf_dir, "documents").select("doc_id", parse_repo_url(url).alias("u")).select("doc_id", "u.provider", "u.owner", "u.repo").where("provider <> 'other'")



@query("first_names", """
with s as (select o_orderpriority as kind, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as k, count(*) over (partition by o_orderpriority) as n from orders)
select kind, max(n) as n, string_agg(cast(o_orderkey as varchar), ',' order by k) filter (where k <= 20) as names from s group by kind""")
def first_names(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderkey")
    first = relational.first_n(o, ["kind"], ["o_orderkey"], 20).groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("names"))
    return o.groupBy("kind").agg(F.count("*").alias("n")).join(first, "kind").select("kind", "n", "names")
