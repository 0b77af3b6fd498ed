"""Queries of summaries, answers and models' JSON, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import answers, contexts, detect, graph, knowledge, reports
from codeloom.plans import sources
from codeloom.plans.registry import ORACLES, query
from codeloom.plans.synthetic import D, source_files, spec_sql, values
from codeloom.session import stored

_SUMMARY = "case " + " ".join(f"when regexp_matches(file_path, '{pattern}') then '{name}'" for name, pattern in X.SUMMARY_LAYERS) + " end"
_KINDS = "kinds as (select project_id, kind, count(*) as n, string_agg(name, ', ' order by file_path, line, name) filter (where p <= 20) as names, string_agg(name, ', ' order by file_path, line, name) filter (where p <= 5) as five from (select *, row_number() over (partition by project_id, kind order by file_path, line, name) as p from sym) group by 1, 2)"
_ARCH = f"arch as (select project_id, layer, count(*) as n_files, cast(sum(loc) as bigint) as n_lines, string_agg(file_path, ', ' order by file_path) filter (where p <= 20) as files from (select *, row_number() over (partition by project_id, layer order by file_path) as p from (select *, {_SUMMARY} as layer from f) where layer is not null) group by 1, 2)"


@query("symbols_by_kind", sources.ctes(D, sources.SYM, _KINDS) + "select project_id, kind, n, names from kinds")
def symbols_by_kind(spark, sf_dir):
    return reports.symbols_by_kind(sources.parts(spark, sf_dir)[2]).withColumn("names", F.array_join("names", ", "))


@query("architecture", sources.ctes(D, sources.F_SQL, _ARCH) + "select project_id, layer, n_files, n_lines, files from arch")
def architecture(spark, sf_dir):
    return reports.architecture(source_files(spark, sf_dir)).withColumn("files", F.array_join("files", ", "))


@query("code_summary", sources.ctes(D, sources.F_SQL, sources.SYM, _KINDS, _ARCH) + """
select f.project_id, 'Files: ' || count(*) || ', code lines: ' || sum(loc) || coalesce(chr(10) || 'Layers:' || chr(10) || (select string_agg('- ' || layer || ': ' || n_files, chr(10) order by '- ' || layer || ': ' || n_files) from arch where arch.project_id = f.project_id), '')
 || coalesce(chr(10) || 'Symbols:' || chr(10) || (select string_agg('- ' || kind || ' (' || n || '): ' || five, chr(10) order by '- ' || kind || ' (' || n || '): ' || five) from kinds where kinds.project_id = f.project_id), '') as summary from f group by f.project_id""")
def code_summary(spark, sf_dir):
    return reports.code_summary(source_files(spark, sf_dir), sources.parts(spark, sf_dir)[2])


_DIAGRAMS = ("mermaid_graph", "mermaid_er", "mermaid_sequence", "mermaid_flow")


@query("diagram_payloads", " union all ".join(f"select project_id, '{n}' as diagram, text from ({ORACLES[n]})" for n in _DIAGRAMS))
def diagram_payloads(spark, sf_dir):
    return reports.diagrams(**{n: getattr(sources, n)(spark, sf_dir) for n in _DIAGRAMS})


_T = "translate(text, '\"\\{}[]' || chr(10) || chr(13) || chr(9), '        ')"


@query("model_answers", f"""
with t as (select doc_id, doc_id % 6 as v, {_T} as title from documents)
select doc_id, v in (1, 2, 3) as was_repaired, case when v < 4 then sha256(title) end as title_sha, cast(case v when 0 then 2 when 2 then 1 when 3 then 2 end as int) as n_tags,
 case v when 1 then 'tags missing' when 4 then 'no JSON' when 5 then 'id not number, title missing, tags not array' else '' end as errors from t""")
def model_answers(spark, sf_dir):
    """Whole texts inside answers as models write them: plain, fenced, with bare keys, cut off, without JSON, of another shape."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.translate("text", '"\\{}[]\n\r\t', " " * 9).alias("t"), F.col("doc_id").cast("string").alias("i"))
    shapes = [('{"id": %i, "title": "%t", "tags": ["a", "b"]}'), ('Sure!\n```json\n{"id": %i, "title": "%t",}\n```\nDone.'), ('{id: %i, title: "%t", tags: ["a",],}'), ('Here it is: {"id": %i, "title": "%t", "tags": ["a", "b"'), "no object, only %t", '{"id": "%i", "tags": {"x": 1}}']
    said = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % 6 + 1).cast("int"))
    got = answers.model_json(d.select("doc_id", F.replace(F.replace(said, F.lit("%i"), F.col("i")), F.lit("%t"), F.col("t")).alias("answer")), "answer")
    v = F.try_parse_json("json")
    return got.select("doc_id", "was_repaired", F.sha2(F.try_variant_get(v, "$.title", "string"), 256).alias("title_sha"), F.size(F.try_variant_get(v, "$.tags", "array<string>")).alias("n_tags"),
                      F.array_join(answers.schema_errors("json", {"id": "number", "title": "string", "tags": "array"}), ", ").alias("errors")).withColumn("n_tags", F.when(F.col("n_tags") >= 0, F.col("n_tags")))


@query("rag_answers", r"""
with c as (select vec_id as id, cast(embedding as double[]) as v, text from embeddings join documents on doc_id = vec_id), q as (select vec_id as query_id, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0),
s as (select query_id, id, text, list_cosine_similarity(q.v, c.v) as score from q, c where query_id <> id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0.1)
select query_id, string_agg(cast(id as varchar), ', ' order by rank) as sources, max(array_to_string(regexp_split_to_array(text, '\s+')[1:40], ' ')) filter (where rank = 1) as answer from r where rank <= 5 group by 1""")
def rag_answers(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    e = read("embeddings")
    chunks = e.join(read("documents"), F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("Markdown").alias("language"), F.col("text").alias("content"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What is close to "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), F.col("embedding").alias("query_vector"))
    return answers.ask(asked, chunks).where("sources is not null").select("query_id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ", ").alias("sources"), "answer")


@query("prompt_budgets", r"""
with c as (select vec_id as id, cast(embedding as double[]) as v, text from embeddings join documents on doc_id = vec_id), q as (select vec_id as query_id, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0),
s as (select query_id, id, text, list_cosine_similarity(q.v, c.v) as score from q, c where query_id <> id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0.1),
b as (select query_id, rank, cast(ceil(length(chr(10) || '### documents/' || id || '.md (' || cast(floor(score * 100 + 0.5) as bigint) || '%)' || chr(10) || '```Markdown' || chr(10) || text[1:1200] || chr(10) || '```') / cast(3.5 as double)) as bigint) as t from r where rank <= 5),
u as (select *, sum(t) over (partition by query_id order by rank) as run from b)
select query_id, cast(coalesce(sum(t) filter (where run <= floor((5000 - ceil(39 / cast(3.5 as double)) - ceil(length('What is close to ' || query_id || '?') / cast(3.5 as double))) * 0.6)), 0) as bigint) as chunk_tokens from u group by 1""")
def prompt_budgets(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    e = read("embeddings")
    chunks = e.join(read("documents"), F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("Markdown").alias("language"), F.col("text").alias("content"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What is close to "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), F.col("embedding").alias("query_vector"))
    return answers.ask(asked, chunks).where("sources is not null").select("query_id", "chunk_tokens")


_CATALOGUE = values([(n, c, u, len(k.split(","))) for n, c, u, k in knowledge.CATALOGUE], "cname, category, url, n_concepts", "cat")
_ALIASES = values([(a, n) for n, o in knowledge.RESOURCE_ALIASES.items() for a in o], "alias, aname", "al")


@query("learning_resources", sources.ctes(D, sources.IMP, sources.TECH, sources.STACK) + f"""select distinct project_id, coalesce(cname, aname, r2.name) as name, cat.category, url, cast(n_concepts as int) as n_concepts
 from r2 left join {_ALIASES} on alias = lower(r2.name) left join {_CATALOGUE} on lower(cname) = lower(coalesce(aname, r2.name))""")
def learning_resources(spark, sf_dir):
    got = knowledge.learning_resources(sources._tech(spark, sf_dir)[1].select("project_id", "name"), knowledge.catalogue_rows(spark), knowledge.resource_alias_rows(spark))
    return got.select("project_id", "name", "category", "url", F.size("concepts").alias("n_concepts")).withColumn("n_concepts", F.when(F.col("n_concepts") >= 0, F.col("n_concepts")))


@query("not_collected", sources.ctes(D, sources.IMP, sources.TECH, sources.STACK) + f"select project_id, name from r2 where lower(name) not in (select lower(cname) from {_CATALOGUE} where category = 'frontend')")
def not_collected(spark, sf_dir):
    own = sources._tech(spark, sf_dir)[1].select("project_id", "name")
    known = own.join(F.broadcast(knowledge.catalogue_rows(spark).where("category = 'frontend'").select(F.lower("name").alias("l_"))), F.lower("name") == F.col("l_")).select("project_id", F.upper("name").alias("name"))
    return knowledge.not_collected(own, known)


@query("imported_resources", f"""with w as (select distinct doc_id % 4 as project_id, (list_value('reactjs', 'K8S', 'golang', 'Redis', 'odd thing', 'Postgres'))[1 + doc_id % 6] as said from documents)
select project_id, coalesce(cname, aname, said) as name, cname is not null as known, url from w left join {_ALIASES} on alias = lower(said) left join {_CATALOGUE} on lower(cname) = lower(coalesce(aname, said))""")
def imported_resources(spark, sf_dir):
    """Technologies as people write them, under their canonical names."""
    said = F.element_at(F.array(*map(F.lit, ("reactjs", "K8S", "golang", "Redis", "odd thing", "Postgres"))), (F.col("doc_id") % 6 + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 4).alias("project_id"), said.alias("name")).distinct()
    got = knowledge.learning_resources(d, knowledge.catalogue_rows(spark), knowledge.resource_alias_rows(spark))
    return got.select("project_id", "name", F.col("url").isNotNull().alias("known"), "url")


@query("session_history", """
with s as (select conv_id, min(turn) as first_turn from conversations where role = 'user' group by 1), m as (select c.* from conversations c join s using (conv_id) qualify row_number() over (partition by c.conv_id order by turn desc) <= 10)
select conv_id, first_turn, count(*) as n_messages, cast(max(turn) as bigint) as last_turn from m join s using (conv_id) group by 1, 2""")
def session_history(spark, sf_dir):
    """Sessions that a user began, with what is left of their messages."""
    from codeloom.operators import chat

    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    s = m.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    return chat.session_messages(s, m, ["conv_id"], "turn").groupBy("conv_id", "first_turn").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))


#: Tokens of a context in the query; smaller than the default, so that sections are dropped.
_BUDGET = 600
_BASE = "string_split(file, '/')[-1]"
_PLAN = values([(c, s, t, most, p, k) for c, own in contexts.CONTEXTS.items() for k, (s, t, most, p) in enumerate(own)], "context, section, title, most, priority, shown", "plan")
_METRIC_LINES = " union all ".join(f"select project_id, 'metrics', '{k:03}', '- {label}: ' || {c} from m" for k, (c, label) in enumerate(contexts.METRICS.items()))
_AT = "file || '/' || lpad(cast(line as varchar), 9, '0')"
_AUTH_TEST = " or ".join(f"contains(lower(path), '{x}')" for x in contexts.AUTH_PATHS)
_CONTEXTS = sources._FACTS + f""", {sources.TECH}, {sources.STACK}, {sources.FIELD}, {sources.REL},
 ms as (select project_id, model, count(*) as n, string_agg('  - ' || field || ': ' || type || coalesce(' → ref: ' || ref, '') || case when required then ' [required]' else '' end, chr(10) order by field) as f from field group by 1, 2),
 mw as ({spec_sql(sources._MIDDLEWARE, 'type, name, path', 'project_id, type, name, file_path as file', ('name', 'path'))}),
 env as (select project_id, name, detected from ({spec_sql(sources._ENV, 'name, n, value, detected', 'project_id, name, n, file_path as source, detected', ('name',))}) qualify row_number() over (partition by project_id, name order by source, n) = 1),
 lib as (select project_id, string_split(source, '/')[1] as name, count(*) as n, count(distinct file_path) as n_files from imp where not starts_with(source, '.') group by 1, 2),
 au as (select project_id, bool_or(c = 151) as jwt from d group by 1),
 said(project_id, section, place, line) as ({_METRIC_LINES}
  union all select project_id, 'scope', '', '- Files: ' || file_count || ' | Code lines: ' || total_loc from m
  union all select project_id, 'technologies', category, '- ' || category || ': ' || string_agg(name, ', ' order by confidence desc, rule_no) from r2 group by project_id, category
  union all select project_id, 'layers', layer, '- ' || layer || ': ' || count(*) || ' files' from (select project_id, {sources.LAYER} as layer from d) group by project_id, layer
  union all select project_id, 'endpoints', {_AT}, '- ' || method || ' ' || path || ' (' || {_BASE} || ')' from route
  union all select project_id, 'plain_endpoints', {_AT}, '- ' || method || ' ' || path from route where not contains(path, ':')
  union all select project_id, 'auth_endpoints', {_AT}, '- ' || method || ' ' || path from route where {_AUTH_TEST}
  union all select project_id, 'crud_endpoints', {_AT}, '- ' || method || ' ' || path from route where list_has_any(string_split(method, ','), {list(contexts.CRUD)})
  union all select project_id, 'models', model, '- ' || model || ' (' || n || ' fields)' || chr(10) || f from ms
  union all select project_id, 'model_names', model, '- ' || model || ': ' || n || ' fields' from ms
  union all select project_id, 'relations', from_model || '/' || field, '- ' || from_model || ' ' || kind || ' → ' || to_model || ' (via ' || field || ')' from rel
  union all select project_id, 'authentication', n, line from (select project_id, unnest([{{'n': '0', 'line': '- JWT: ' || case when jwt then 'Yes' else 'No' end}}, {{'n': '1', 'line': '- OAuth: No'}}, {{'n': '2', 'line': '- Passport: No'}}, {{'n': '3', 'line': '- bcrypt: No'}},
    {{'n': '4', 'line': case when jwt then '- JWT expiry: 15m' end}}, {{'n': '5', 'line': case when jwt then '- Middleware: authenticate' end}}], recursive := true) from au) where line is not null
  union all select project_id, 'auth_files', file_path, '- ' || file_path from d where c = 151
  union all select project_id, 'dependencies', n, line from (select project_id, unnest([{{'n': '0', 'line': '- Imports: ' || count(*)}}, {{'n': '1', 'line': '- Local: ' || count(to_file)}}, {{'n': '2', 'line': '- Unresolved: ' || count(*) filter (where class = 'local' and to_file is null)}}], recursive := true) from dep group by project_id)
  union all select project_id, 'libraries', lpad(cast(1000000000000 - n as varchar), 13, '0') || name, '- ' || name || ': used ' || n || ' times in ' || n_files || ' files' from lib
  union all select project_id, 'middleware', file || '/' || type || '/' || name, '- ' || name || ' (' || type || ') in ' || {_BASE} from mw
  union all select project_id, 'environment', name, '- ' || name || case when detected = 'file' then '' else ' [referenced]' end from env),
 placed as (select *, row_number() over (partition by project_id, section order by place, line) as r, count(*) over (partition by project_id, section) as n from said),
 body as (select project_id, context, priority, shown, '## ' || title || chr(10) || string_agg(line, chr(10) order by r) || case when any_value(n) > most then chr(10) || '  +' || any_value(n) - most || ' more' else '' end as body
  from placed join {_PLAN} using (section) where r <= most group by project_id, context, section, title, most, priority, shown),
 cost as (select *, cast(ceil(length(body) / 3.5) as bigint) as t from body), run as (select *, sum(t) over (partition by project_id, context order by priority, shown rows unbounded preceding) as s from cost)
 select project_id, context, count(*) filter (where s <= {_BUDGET}) as n_sections, count(*) filter (where s > {_BUDGET}) as n_dropped, cast(coalesce(sum(t) filter (where s <= {_BUDGET}), 0) as bigint) as n_tokens,
  coalesce(string_agg(body, chr(10) || chr(10) order by shown) filter (where s <= {_BUDGET}), '') as text from run group by 1, 2"""


@query("report_contexts", _CONTEXTS)
def report_contexts(spark, sf_dir):
    own = sources.parts(spark, sf_dir)
    files, _, symbols, imports, configs = own
    resolved = stored(graph.resolve(imports, files), "resolved")
    fields = detect.mongoose_models(files)
    relations = graph.relationships(fields.select("project_id", F.col("model").alias("name")).distinct(), fields.select("project_id", "model", F.col("field").alias("name"), "type", "ref"))
    tech = detect.by_category(detect.stacks(detect.technologies(files, configs, imports))[1])
    lines = contexts.sections(sources.project_facts(spark, sf_dir, own), tech, graph.layer_nodes(files), detect.routes(files), fields, relations, detect.authentication(files), resolved, detect.external_libraries(imports), detect.middleware(files), detect.environment(files))
    return contexts.report_contexts(stored(lines, "context-lines"), _BUDGET)
