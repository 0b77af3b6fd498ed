"""Queries over source files made of the documents table (synthetic.py): parsing, detection, graphs, views, each with its oracle.

What a file shows follows from its document's id, so the oracles list it by kind of file and never parse: lines begin at 1, {k} is the id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import audit, chunking, detect, graph, knowledge, metrics, ml, parsers, views
from codeloom.operators.rules import CATEGORIES, RULES, STACKS
from codeloom.plans.registry import query
from codeloom.plans.synthetic import D, literal, source_files, spec_sql, values
from codeloom.session import stored

# -- what the templates show -----------------------------------------------------------------------------------------

#: kind, name, symbol kind, line, extends, parameters, asynchronous, exported.
SYMBOLS = [
    (0, "list{k}", "arrow_function", 7, None, "req,res", True, True), (1, "s{k}", "function", 4, None, "data", True, True), (1, "hidden{k}", "function", 11, None, "a,b", False, False),
    (3, "a{k}", "arrow_function", 2, None, None, False, True), (4, "b{k}", "arrow_function", 3, None, None, False, True), (5, "C{k}", "component", 2, None, None, False, True), (5, "C{k}", "function", 2, None, None, False, True),
    (6, "Store{k}", "class", 4, "dict", None, False, True), (6, "put", "method", 5, "Store{k}", "self,key,value", False, True), (6, "things{k}", "function", 8, None, "", False, True), (6, "ping{k}", "function", 11, None, "a", True, True),
    (7, "A{k}", "class", 5, "Base{k}", None, False, True), (7, "books", "method", 7, None, "author", False, True),
    (8, "Shape{k}", "class", 3, "Base{k}", None, False, False), (8, "area{k}", "function", 5, None, "w,h", False, False),
    (9, "L{k}", "class", 2, "Base{k}", None, False, True), (9, "Count{k}", "method", 3, None, "xs", True, True),
    (10, "Server{k}", "class", 5, None, None, False, False), (10, "Run{k}", "method", 6, "Server{k}", "port", False, False), (10, "main{k}", "function", 9, None, None, False, False),
    (11, "Page{k}", "class", 3, "Base{k}", None, False, False), (11, "show{k}", "method", 4, None, "$id", False, False), (11, "helper{k}", "function", 8, None, "$x", False, False),
    (151, "authenticate", "function", 6, None, "req,res,next", False, True), (151, "sign{k}", "arrow_function", 10, None, "user", False, True),
]
_SYM = "name, kind, line, extends, params, is_async, exported"
SYM = "sym as (" + spec_sql(SYMBOLS, _SYM, f"k, c, project_id, file_path, language, {_SYM}", ("name", "extends", "params")) + ")"

#: kind, source, import kind, specifiers, line, class of the dependency, path and distance of the document that it resolves to, package.
IMPORTS = [
    (0, "express", "import", "express", 1, "external", None, 0, "express"), (0, "../services/s{n}", "import", "s{n}", 2, "local", "src/services/s{n}.js", 1, None),
    (1, "../models/m{n}", "import", "M{n}", 1, "local", "src/models/m{n}.js", 1, None), (1, "./missing{k}", "import", "gone", 2, "local", None, 0, None), (1, "fs", "require", "fs", 3, "builtin", None, 0, None),
    (2, "mongoose", "import", "mongoose", 1, "external", None, 0, "mongoose"), (3, "./b{n}", "import", "b{n}", 1, "local", "src/cycle/b{n}.js", 1, None),
    (4, "./a{b}", "import", "a{b}", 1, "local", "src/cycle/a{b}.js", -1, None), (4, "./b{k}", "import", "b{k}", 2, "local", "src/cycle/b{k}.js", 0, None),
    (5, "react", "import", "React,useState,useEffect", 1, "external", None, 0, "react"), (6, "os", "import", "os", 1, "builtin", None, 0, None), (6, "flask", "from_import", "Flask,jsonify", 2, "external", None, 0, "flask"),
    (7, "java.util.List", "import", "", 2, "builtin", None, 0, None), (7, "org.springframework.web.bind.annotation.RestController", "import", "", 3, "external", None, 0, "org.springframework.web.bind.annotation.RestController"),
    (8, "vector", "include", "", 1, "external", None, 0, "vector"), (8, "lib{k}.hpp", "include", "", 2, "external", None, 0, "lib{k}.hpp"), (9, "System.Linq", "using", "", 1, "local", None, 0, None),
    (10, "fmt", "import", "", 3, "external", None, 0, "fmt"), (11, "Demo", "use", "", 2, "local", None, 0, None),
    (13, "style{b}.css", "asset", "", 2, "external", None, 0, "style{b}.css"), (13, "app{k}.js", "asset", "", 2, "external", None, 0, "app{k}.js"), (13, "a{k}.png", "asset", "", 3, "external", None, 0, "a{k}.png"),
    (151, "jsonwebtoken", "import", "jwt", 1, "external", None, 0, "jsonwebtoken"),
]
_IMP = "source, ikind, specifiers, line, class, target, off, package"
IMP = "imp as (" + spec_sql(IMPORTS, _IMP, f"k, c, project_id, file_path, language, {_IMP}", ("source", "specifiers", "target", "package")) + ")"
#: Resolved imports: the target is there if its document is.
DEP = "dep as (select imp.*, t.file_path as to_file from imp left join d t on imp.target is not null and t.k = imp.k + imp.off and t.project_id = imp.project_id and t.file_path = imp.target)"
EDGE = "edge as (select project_id, file_path as source, to_file as target, line from dep where to_file is not null)"

#: kind, method, path, line, family.
ROUTES = [(0, "GET", "/items/{k}", 4, "express"), (0, "POST", "/items/{k}", 5, "express"), (0, "USE", "/base{k}", 6, "express"), (6, "GET,POST", "/things/{k}", 7, "python"), (6, "GET", "/ping{k}", 10, "python"), (7, "GET", "/api{k}/books", 6, "spring")]
ROUTE = "route as (" + spec_sql(ROUTES, "method, path, line, family", "k, project_id, method, path, file_path as file, line, family", ("path",)) + ")"

#: kind, table, kind of row, name, line, detail.
STRUCTURE = [
    (0, "export", "named", "list{k}", 7, None), (1, "export", "named", "s{k}", 4, None), (2, "export", "named", "M{k}", 7, None), (3, "export", "named", "a{k}", 2, None), (4, "export", "named", "b{k}", 3, None),
    (5, "export", "default", "C{k}", 2, None), (5, "hook", "hook", "useState", 3, None), (5, "hook", "hook", "useEffect", 4, None), (5, "child", "component", "Panel{k}", 5, None),
    (6, "framework", "web_framework", "Flask", 3, None), (6, "decorator", "decorator", "app.route", 7, "'/things/{k}'"), (6, "decorator", "decorator", "app.get", 10, "'/ping{k}'"), (7, "annotation", "annotation", "RequestMapping", 4, '"/api{k}"'), (7, "annotation", "annotation", "GetMapping", 6, '"/books"'),
    (12, "at_rule", "at_rule", "media", 1, None), (12, "selector", "selector", "body", 2, None), (12, "selector", "selector", ".card{k}, .tile", 4, None),
    (12, "declaration", "declaration", "color", 2, "black"), (12, "declaration", "declaration", "margin", 5, "0"),
    *((13, "tag", "tag", n, line, None) for n, line in (("html", 2), ("head", 2), ("link", 2), ("script", 2), ("body", 3), ("img", 3), ("p", 3))),
    (151, "export", "named", "authenticate", 6, None), (151, "export", "named", "sign{k}", 10, None),
]
_STR = "tbl, kind, name, line, detail"
STR = "str as (" + spec_sql(STRUCTURE, _STR, f"project_id, file_path, {_STR}", ("name", "detail")) + ")"

#: Code lines of each kind (a C++ include and a CSS block comment count as comments).
LOC = {0: 9, 1: 13, 2: 7, 3: 2, 4: 3, 5: 6, 6: 12, 7: 10, 8: 5, 9: 6, 10: 11, 11: 10, 12: 6, 13: 3, 140: 1, 141: 2, 142: 2, 150: 2, 151: 10, 152: 5}
LINES = "len(string_split(text, chr(10)))"
F_SQL = f"f as (select d.*, loc, case when c = 140 then 1 else n_lines + {LINES} + case when c = 12 then 1 else 0 end end as lines from d join {values(list(LOC.items()), 'c, loc')} using (c))"
_LAYERS = [(0, "route"), (1, "service"), (2, "model"), (151, "middleware")]
LAYER = f"coalesce((select l from {values(_LAYERS, 'lc, l', 'lay')} where lc = c), 'other')"


def ctes(*names: str) -> str:
    return "with " + ",\n".join(names) + "\n"


def parts(spark, sf_dir, once: bool = True):
    """Files, all rows of the parsers, symbols, imports, configurations; with ``once`` the parsers' rows are a table, however often a query reads them."""
    files = source_files(spark, sf_dir)
    parsed = parsers.parse_files(files)
    parsed = stored(parsed, "parsed") if once else parsed
    return files, parsed, parsers.symbols(parsed), parsers.imports(parsed), parsers.configs(files)


def resolved(spark, sf_dir):
    files, _, _, imports, _ = parts(spark, sf_dir)
    return graph.resolve(imports, files)


# -- parsing ---------------------------------------------------------------------------------------------------------

@query("parse_symbols", ctes(D, SYM) + f"select project_id, file_path, language, {_SYM} from sym")
def parse_symbols(spark, sf_dir):
    return parts(spark, sf_dir, once=False)[2].drop("owner", "implements").withColumn("params", F.array_join("params", ","))


@query("parse_imports", ctes(D, IMP) + "select project_id, file_path as from_file, language, source, ikind as kind, specifiers, line from imp")
def parse_imports(spark, sf_dir):
    return parts(spark, sf_dir, once=False)[3].withColumn("specifiers", F.array_join("specifiers", ","))


@query("source_structure", ctes(D, STR) + 'select project_id, file_path, tbl as "table", kind, name, line, detail from str')
def source_structure(spark, sf_dir):
    return parts(spark, sf_dir, once=False)[1].where("table not in ('symbol', 'import')").select("project_id", "file_path", "table", "kind", "name", "line", "detail")


_NAMES = lambda table, test: f"coalesce((select string_agg(distinct name, ',' order by name) from {table} x where x.project_id = p.project_id and {test}), '')"


@query("parser_rollup", ctes(D, STR, SYM) + f"""select project_id, {_NAMES('str', "tbl = 'hook'")} as hooks, {_NAMES('sym', "kind = 'component'")} as components, {_NAMES('str', "tbl = 'tag'")} as tags,
 {_NAMES('str', "tbl = 'selector'")} as selectors, {_NAMES('str', "tbl = 'at_rule'")} as at_rules, '' as namespaces from (select distinct project_id from (select project_id from str union all select project_id from sym
 union all select project_id from d where c in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11))) p""")
def parser_rollup(spark, sf_dir):
    r = parsers.rollup(parts(spark, sf_dir, once=False)[1])
    return r.select("project_id", *[F.array_join(c, ",").alias(c) for c in r.columns[1:]])


_CONFIGS = [(140, "package.json", "express,jsonwebtoken,mongoose,react,react-dom", None, None), (141, "requirements.txt", "flask,pandas", None, None), (142, "Dockerfile", None, None, "node:20"), (150, ".env", None, "PORT_{k},SECRET", None), (152, "docker-compose.yml", None, "web,db", None)]


@query("config_files", ctes(D) + spec_sql(_CONFIGS, "file_type, dependencies, keys, base_image", "project_id, file_path, file_type, dependencies, keys, base_image, cast(null as varchar) as parse_error", ("keys",)))
def config_files(spark, sf_dir):
    return parts(spark, sf_dir, once=False)[4].select("project_id", "file_path", "file_type", F.array_join(F.array_sort(F.map_keys("dependencies")), ",").alias("dependencies"), F.array_join("keys", ",").alias("keys"), "base_image", "parse_error")


@query("file_languages", ctes(D) + "select language, count(*) as n_files, count(distinct project_id) as n_projects from d group by language")
def file_languages(spark, sf_dir):
    return source_files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n_files"), F.count_distinct("project_id").alias("n_projects"))


#: kind, name, type, first and last line of functions and classes, from 0.
_SPANS = [
    (0, "list{k}", "function", 6, 8), (1, "s{k}", "function", 3, 9), (1, "hidden{k}", "function", 10, 12), (5, "C{k}", "component", 1, 5), (6, "Store{k}", "class", 3, 5), (6, "things{k}", "function", 7, 8), (6, "ping{k}", "function", 10, 11),
    (7, "A{k}", "class", 4, 9), (8, "Shape{k}", "class", 2, 3), (8, "area{k}", "function", 4, 6), (9, "L{k}", "class", 1, 5), (10, "Run{k}", "component", 5, 7), (10, "main{k}", "function", 8, 10), (11, "Page{k}", "class", 2, 6), (11, "helper{k}", "function", 7, 9),
    (151, "authenticate", "function", 5, 8),
]


@query("function_spans", ctes(D) + spec_sql(_SPANS, "function_name, symbol_type, start_line, end_line", "project_id, file_path, function_name, symbol_type, start_line, end_line", ("function_name",)))
def function_spans(spark, sf_dir):
    return chunking.chunk_files(source_files(spark, sf_dir)).where("function_name is not null").select("project_id", "file_path", "function_name", "symbol_type", "start_line", "end_line")


# -- graphs ----------------------------------------------------------------------------------------------------------

@query("dependencies", ctes(D, IMP, DEP) + "select project_id, file_path as from_file, source, class as kind, to_file, package as to_package, line from dep")
def dependencies(spark, sf_dir):
    return resolved(spark, sf_dir).select("project_id", "from_file", "source", "kind", "to_file", "to_package", "line")


@query("unresolved_imports", ctes(D, IMP, DEP) + "select project_id, file_path as from_file, source, line from dep where class = 'local' and to_file is null")
def unresolved_imports(spark, sf_dir):
    return graph.unresolved(resolved(spark, sf_dir)).select("project_id", "from_file", "source", "line")


@query("dependencies_by_file", ctes(D, IMP, DEP) + "select project_id, file_path as from_file, count(*) as n_dependencies, string_agg(line || ' ' || source || ' ' || class, ', ' order by line, source) as listed from dep group by 1, 2")
def dependencies_by_file(spark, sf_dir):
    g = graph.grouped_back(resolved(spark, sf_dir))
    return g.select("project_id", "from_file", F.size("dependencies").cast("long").alias("n_dependencies"), F.array_join(F.transform("dependencies", lambda x: F.concat_ws(" ", x["line"].cast("string"), x["source"], x["kind"])), ", ").alias("listed"))


@query("project_cycles", ctes(D, IMP, DEP, EDGE) + """select project_id, source || ' > ' || target || ' > ' || source as cycle from edge e where source like 'src/cycle/a%' and exists (select 1 from edge x where x.project_id = e.project_id and x.source = e.target and x.target = e.source)
 union all select project_id, source || ' > ' || target from edge where source = target""")
def project_cycles(spark, sf_dir):
    return graph.cycles(graph.local_edges(resolved(spark, sf_dir))).select("project_id", F.array_join("cycle", " > ").alias("cycle"))


@query("project_layers", ctes(D, F_SQL) + f"""select project_id, layer, upper(layer[1]) || layer[2:] as label, count(*) as file_count, cast(sum(loc) as bigint) as total_loc, string_agg(file_path, ',' order by file_path) as files
 from (select *, {LAYER} as layer from f) group by project_id, layer""")
def project_layers(spark, sf_dir):
    return graph.layer_nodes(source_files(spark, sf_dir)).select("project_id", "layer", "label", "file_count", "total_loc", F.array_join("files", ",").alias("files"))


@query("layers_by_code", ctes(D, F_SQL) + f"""select project_id, layer, total_loc, cast(row_number() over (partition by project_id order by total_loc desc, layer) as int) as place
 from (select project_id, layer, cast(sum(loc) as bigint) as total_loc from (select *, {LAYER} as layer from f) group by 1, 2)""")
def layers_by_code(spark, sf_dir):
    return graph.layers_by_code(graph.layer_nodes(source_files(spark, sf_dir))).select("project_id", "layer", "total_loc", "place")


_ENDS = ctes(D, IMP, DEP, EDGE, f"lf as (select project_id, file_path, {LAYER} as layer from d)", "le as (select edge.*, a.layer as source_layer, b.layer as target_layer from edge join lf a on a.project_id = edge.project_id and a.file_path = source join lf b on b.project_id = edge.project_id and b.file_path = target)")


@query("project_layer_edges", _ENDS + "select project_id, source_layer, target_layer, count(*) as edge_count, count(distinct (source, target)) as file_pairs from le where source_layer <> target_layer group by 1, 2, 3")
def project_layer_edges(spark, sf_dir):
    return graph.layer_edges(graph.local_edges(resolved(spark, sf_dir)))


def _knowledge(spark, sf_dir):
    files, _, symbols, imports, _ = parts(spark, sf_dir)
    r = graph.resolve(imports, files)
    return graph.knowledge_graph(files, symbols, graph.local_edges(r), r.where("to_package is not null").select("project_id", "from_file", "to_package"), detect.routes(files))


_KIND = "case when kind in ('function', 'arrow_function', 'method') then 'function' else kind end"


@query("knowledge_nodes", ctes(D, SYM, IMP, DEP, ROUTE) + f"""select distinct * from (select project_id, 'file:' || file_path as id, string_split(file_path, '/')[-1] as label, 'file' as type from d
 union all select project_id, {_KIND} || ':' || file_path || ':' || name, name, {_KIND} from sym union all select project_id, 'route:' || method || ':' || path, method || ' ' || path, 'route' from route
 union all select project_id, 'package:' || package, package, 'package' from dep where package is not null)""")
def knowledge_nodes(spark, sf_dir):
    return _knowledge(spark, sf_dir)[0]


@query("knowledge_edges", ctes(D, SYM, IMP, DEP, ROUTE, EDGE) + f"""select distinct * from (select project_id, 'file:' || file_path as source, {_KIND} || ':' || file_path || ':' || name as target, 'contains' as type from sym
 union all select project_id, 'file:' || file, 'route:' || method || ':' || path, 'defines' from route union all select project_id, 'file:' || source, 'file:' || target, 'imports' from edge
 union all select project_id, 'file:' || file_path, 'package:' || package, 'imports' from dep where package is not null)""")
def knowledge_edges(spark, sf_dir):
    return _knowledge(spark, sf_dir)[1]


@query("knowledge_view", ctes(D, SYM, IMP, DEP, ROUTE) + f"""select project_id, type, count(*) as n, cast(case type when 'file' then 12 when 'class' then 10 else 7 end as double) as radius from (select distinct * from (select project_id, 'file:' || file_path as id, 'file' as type from d
 union all select project_id, {_KIND} || ':' || file_path || ':' || name, {_KIND} from sym union all select project_id, 'route:' || method || ':' || path, 'route' from route union all select project_id, 'package:' || package, 'package' from dep where package is not null)) group by 1, 2""")
def knowledge_view(spark, sf_dir):
    nodes, _ = views.knowledge_view(*_knowledge(spark, sf_dir))
    return nodes.groupBy("project_id", "type").agg(F.count("*").alias("n"), F.max("radius").alias("radius"))


#: The walk from a project's entry: its handler, then that of the service it imports; its model shows no symbol.
@query("call_chain", ctes(D, SYM, IMP, DEP, EDGE) + """, e as (select distinct project_id, file_path as entry from d where file_path = 'src/routes/index.js'),
 s as (select e.project_id, entry as file, 0 as depth from e union all select e.project_id, target, 1 from e join edge on edge.project_id = e.project_id and source = entry),
 n as (select s.project_id, cast(row_number() over (partition by s.project_id order by depth, line) as int) as step, file, name as symbol, kind, line, depth from s join sym on sym.project_id = s.project_id and sym.file_path = file and exported)
 select *, case when depth = 0 then 'request' else 'service' end as phase, symbol || '() - ' || kind || ' in ' || string_split(file, '/')[-1] as description from n""")
def call_chain(spark, sf_dir):
    files, _, symbols, imports, _ = parts(spark, sf_dir)
    edges = graph.resolve(imports, files).select("project_id", "from_file", "to_file", "line")
    return graph.walk(files, symbols, edges, graph.entry_points(files))


@query("reached_files", ctes(D, IMP, DEP, EDGE) + """, e as (select distinct project_id, file_path as root from d where file_path = 'src/routes/index.js'),
 one as (select e.project_id, target as node, 1 as depth from e join edge on edge.project_id = e.project_id and source = root), two as (select one.project_id, target as node, 2 as depth from one join edge on edge.project_id = one.project_id and source = node)
 select project_id, root as node, 0 as depth from e union all select * from one union all select * from two""")
def reached_files(spark, sf_dir):
    files = source_files(spark, sf_dir)
    roots = graph.entry_points(files).where("entry = 'src/routes/index.js'").select("project_id", F.col("entry").alias("root"))
    return graph.reach(graph.local_edges(resolved(spark, sf_dir)), roots)


@query("controller_flow", ctes(D, SYM, IMP, DEP, EDGE, ROUTE) + """, r as (select *, row_number() over (partition by project_id order by file, line) as route_no from route qualify route_no <= 30)
 select r.project_id, cast(route_no as int) as route_no, method, path, file, target, name as symbol, sym.line as s_line from r join edge on edge.project_id = r.project_id and source = file
 left join sym on sym.project_id = r.project_id and sym.file_path = target qualify row_number() over (partition by r.project_id, route_no, target order by sym.line) <= 5""")
def controller_flow(spark, sf_dir):
    files, _, symbols, imports, _ = parts(spark, sf_dir)
    return graph.controller_flow(detect.routes(files), graph.local_edges(graph.resolve(imports, files)), symbols)


@query("request_flow", ctes(D) + """, s as (select distinct project_id, 0 as stage_no, 'request' as phase, null as file from d union all select distinct project_id, 6, 'response', null from d
 union all select project_id, 1, 'authentication', file_path from d where c = 151 union all select project_id, 4, 'service', file_path from d where c = 1
 union all (select project_id, 5, 'model', file_path from d where c = 2 qualify row_number() over (partition by project_id order by file_path) <= 2))
 select project_id, stage_no, phase, file, cast(row_number() over (partition by project_id order by stage_no, file) as int) as step from s""")
def request_flow(spark, sf_dir):
    return graph.request_flow(source_files(spark, sf_dir))


@query("flow_kind", ctes(D) + "select project_id, case when count(*) filter (where c in (0, 6, 7)) > 0 then 'request' when count(*) filter (where c in (1, 2, 151)) > 0 then 'database' else 'call_chain' end as flow from d group by project_id")
def flow_kind(spark, sf_dir):
    files = source_files(spark, sf_dir)
    return graph.flow_kind(files, detect.routes(files), detect.operations(files))


@query("phase_summary", ctes(D, SYM) + """select project_id, 'request' as phase, 1 as n_steps, 1 as first_step, 1 as last_step, 800 as duration_ms from sym where file_path = 'src/routes/index.js'
 union all select s.project_id, 'service', 1, 2, 2, 800 from sym s join d on d.project_id = s.project_id and d.file_path = 'src/routes/index.js' and s.k = d.k + 1 where s.exported""")
def phase_summary(spark, sf_dir):
    return graph.phase_groups(call_chain(spark, sf_dir))


# -- metrics ---------------------------------------------------------------------------------------------------------

def project_facts(spark, sf_dir, own=None):
    """Totals, counts and scores of a repository, from its tables (``own``, where a query has them)."""
    files, _, symbols, imports, _ = own or parts(spark, sf_dir)
    t = metrics.totals(files, "project_id").join(metrics.symbol_counts(symbols, "project_id"), "project_id", "left")
    # a row a file on both sides, guessed too small from compressed files: merges, nothing of it goes through the driver
    n = files.select("project_id", "file_path").join(symbols.groupBy("project_id", "file_path").agg(F.count("*").alias("n_symbols")).hint("merge"), ["project_id", "file_path"], "left").join(
        imports.groupBy("project_id", F.col("from_file").alias("file_path")).agg(F.count("*").alias("n_imports")).hint("merge"), ["project_id", "file_path"], "left").na.fill(0)
    r = graph.resolve(imports, files)
    deps = r.groupBy("project_id").agg(F.count_if(F.col("to_file").isNotNull()).alias("dep_chain_length"))
    cyc = graph.cycles(graph.local_edges(r)).groupBy("project_id").agg(F.count("*").alias("circular_dep_count"))
    rest = files.groupBy("project_id").agg(F.sum(audit.X.count_matches("content", metrics.ERROR_HANDLER)).alias("error_handler_count"))
    routes = detect.routes(files).groupBy("project_id").agg(F.count("*").alias("route_count"))
    m = t
    for part in (metrics.complexity(n, "project_id"), deps, cyc, rest, routes, metrics.folder_depth(files, "project_id")):
        m = m.join(part, "project_id", "left")
    m = m.na.fill(0).withColumn("comment_percent", metrics.comment_percent(F.col("total_lines"), F.col("total_loc")))
    m = m.withColumn("maintainability", metrics.maintainability(F.col("avg_cc"), F.col("total_loc"), F.col("total_files"), F.col("comment_percent")))
    return m.withColumnsRenamed({"total_files": "file_count", "max_depth": "folder_depth", "function_count": "total_funcs"})


_HANDLERS = "case c when 1 then 2 else 0 end"  # try {, throw new
_FACTS = ctes(D, F_SQL, SYM, IMP, DEP, EDGE, ROUTE) + f""",
 cc as (select d.project_id, d.file_path, (select count(*) from sym where sym.k = d.k) + (select count(*) from imp where imp.k = d.k) as n from d),
 cyc as (select project_id, count(*) as n from edge e where source = target or (source like 'src/cycle/a%' and exists (select 1 from edge x where x.project_id = e.project_id and x.source = e.target and x.target = e.source)) group by 1),
 fold as (select project_id, max(len(string_split(file_path, '/')) - 1) as depth from d group by 1),
 p as (select project_id, count(*) as file_count, cast(sum(lines) as bigint) as total_lines, cast(sum(loc) as bigint) as total_loc, count(distinct language) filter (where language <> 'Unknown') as n_languages from f group by 1),
 q as (select p.*, (select count(*) from sym where sym.project_id = p.project_id) as total_symbols, (select count(*) from sym where sym.project_id = p.project_id and kind in ('function', 'arrow_function')) as total_funcs,
  (select count(*) from sym where sym.project_id = p.project_id and kind = 'class') as class_count, (select count(*) from sym where sym.project_id = p.project_id and is_async) as async_count,
  (select floor(avg(n) * 100 + 0.5) / 100 from cc where cc.project_id = p.project_id) as avg_cc, (select max(n) from cc where cc.project_id = p.project_id) as max_cc, (select count(*) from edge where edge.project_id = p.project_id) as dep_chain_length,
  coalesce((select n from cyc where cyc.project_id = p.project_id), 0) as circular_dep_count, (select count(*) from route where route.project_id = p.project_id) as route_count, (select depth from fold where fold.project_id = p.project_id) as folder_depth,
  (select sum({_HANDLERS}) from d where d.project_id = p.project_id) as error_handler_count, floor((total_lines - total_loc) / cast(total_lines as double) * 1000 + 0.5) / 10 as comment_percent from p),
 m as (select *, floor(greatest(0, least(100, 100 - avg_cc * 3 - total_loc / cast(file_count as double) / 50 + comment_percent * 0.3)) * 100 + 0.5) / 100 as maintainability from q)
"""
_FACT_COLUMNS = ("project_id", "file_count", "total_lines", "total_loc", "n_languages", "total_symbols", "total_funcs", "class_count", "async_count", "avg_cc", "max_cc", "dep_chain_length", "circular_dep_count", "route_count", "folder_depth", "error_handler_count", "comment_percent", "maintainability")


@query("project_metrics", _FACTS + "select " + ", ".join(f"cast({c} as bigint) as {c}" if c in ("error_handler_count", "max_cc", "folder_depth") else c for c in _FACT_COLUMNS) + " from m")
def project_metrics(spark, sf_dir):
    return project_facts(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("error_handler_count", "max_cc", "folder_depth")}).select(*_FACT_COLUMNS)


@query("project_scores", _FACTS + """, s as (select project_id, total_loc / 1000.0 * 0.5 + file_count / 50.0 * 2.5 as a, avg_cc * 0.5 + max_cc * 0.1 as b, folder_depth * 0.8 + dep_chain_length * 0.3 + circular_dep_count * 0.4 as c,
 route_count / 40.0 * 2 + async_count / 80.0 * 2 + class_count / 20.0 * 2 as d, (100 - maintainability) * 0.08 + greatest(0, 30 - comment_percent) * 0.05 as e from m)
 select project_id, round_even(cast(least(10, greatest(1, a)) as double), 1) as size_score, round_even(cast(least(10, greatest(1, b)) as double), 1) as complexity_score, round_even(cast(least(10, greatest(1, c)) as double), 1) as architecture_score,
 round_even(cast(least(10, greatest(1, d)) as double), 1) as surface_score, round_even(cast(least(10, greatest(1, e)) as double), 1) as quality_score from s""")
def project_scores(spark, sf_dir):
    return metrics.dimension_scores(project_facts(spark, sf_dir)).select("project_id", "size_score", "complexity_score", "architecture_score", "surface_score", "quality_score")


@query("difficulty")
def difficulty(spark, sf_dir):
    model, _ = ml.train(ml.training_set(spark))
    got = ml.predict(project_facts(spark, sf_dir), model)
    return got.select("project_id", "level", "confidence", "score", "learning_hours", "experience", "size_score", "complexity_score", "architecture_score", "surface_score", "quality_score")


#: A class and its confidence that a project's number gives, in place of a model's, so that SQL can follow what is made of them.
_GIVEN = "cast(project_id[2:] as int) % 4 as level_no, 0.25 + (cast(project_id[2:] as int) % 7) / 10.0 as confidence"
_LEVELS = values([(k, *x) for k, x in enumerate(ml.LEVELS)], "level_no, level, color, least_h, most_h, experience", "lv")
_SCALED = {c: (*ml.FEATURES[c], "case when maintainability = 0 then 100.0 else maintainability end" if c == "maintainability" else c) for c in ml.FEATURES}


@query("difficulty_formulas", _FACTS + f""", g as (select *, {_GIVEN} from m) select project_id, level, color, experience, round_even(cast(least(10, greatest(1, (g.level_no + 1) * 2.5 + 1.5 * confidence)) as double), 1) as score,
 round_even(cast(least_h + (most_h - least_h) * (least(1.0, total_loc / 10000.0) + least(1.0, avg_cc / 15.0)) / 2 as double), 0) as learning_hours,
 """ + ", ".join(f"round((least(greatest(cast({x} as double), {low}), {high}) - {low}) / {float(high - low)}, 6) as {c}_s" for c, (low, high, x) in _SCALED.items()) + f" from g join {_LEVELS} using (level_no)")
def difficulty_formulas(spark, sf_dir):
    number = F.substring("project_id", 2, 9).cast("int")
    got = ml.difficulty(ml.scaled(ml.features(project_facts(spark, sf_dir).withColumns({"level_no": number % 4, "confidence": 0.25 + (number % 7) / 10.0}))))
    return got.select("project_id", "level", "color", "experience", "score", "learning_hours", *[F.round(f"{c}_s", 6).alias(f"{c}_s") for c in ml.FEATURES])


# -- detection -------------------------------------------------------------------------------------------------------

@query("routes", ctes(D, ROUTE) + "select project_id, method, path, file, line, family from route")
def routes(spark, sf_dir):
    return detect.routes(source_files(spark, sf_dir)).select("project_id", "method", "path", "file", "line", "family")


@query("route_methods", ctes(D, ROUTE) + """select project_id, count(*) as n_routes, (select string_agg(distinct m, ',' order by m) from (select unnest(string_split(method, ',')) as m from route x where x.project_id = r.project_id)) as methods,
 string_agg(method || ' ' || path, ', ' order by file, line) filter (where n <= 10) as key_routes from (select *, row_number() over (partition by project_id order by file, line) as n from route) r group by project_id""")
def route_methods(spark, sf_dir):
    return detect.route_summary(detect.routes(source_files(spark, sf_dir))).select("project_id", "n_routes", F.array_join("methods", ",").alias("methods"), F.array_join("key_routes", ", ").alias("key_routes"))


#: kind, order of the operation, phase, description, line.
_OPERATIONS = [(1, 3, "database", "Database query: find()", 6), (1, 19, "database", "Sort query results", 6), (2, 1, "model", "Define Mongoose model", 7), (2, 2, "model", "Define Mongoose schema", 2), (151, 0, "database", "Connect to MongoDB", 2)]


@query("db_operations", ctes(D) + f"select project_id, file, line, description, phase, cast(row_number() over (partition by project_id order by file, n, line) as int) as step from ({spec_sql(_OPERATIONS, 'n, phase, description, line', 'project_id, file_path as file, n, phase, description, line')})")
def db_operations(spark, sf_dir):
    return detect.operations(source_files(spark, sf_dir)).select("project_id", "file", "line", "description", "phase", "step")


#: kind, name, place among a file's finds, value, how it was found.
_ENV = [(150, "PORT_{k}", 0, "***masked***", "file"), (150, "SECRET", 0, "***masked***", "file"), (1, "KEY_{k}", 1, "***referenced***", "reference"), (151, "SECRET", 1, "***referenced***", "reference")]


@query("source_environment", ctes(D) + f"select project_id, name, value, source, detected from ({spec_sql(_ENV, 'name, n, value, detected', 'project_id, name, n, value, file_path as source, detected', ('name',))}) qualify row_number() over (partition by project_id, name order by source, n) = 1")
def source_environment(spark, sf_dir):
    return detect.environment(source_files(spark, sf_dir))


_MIDDLEWARE = [(0, "express_middleware", "list{k}", "/base{k}"), (151, "middleware_function", "authenticate", None)]


@query("middleware", ctes(D) + spec_sql(_MIDDLEWARE, "type, name, path", "project_id, type, name, path, file_path as file", ("name", "path")))
def middleware(spark, sf_dir):
    return detect.middleware(source_files(spark, sf_dir))


@query("authentication", ctes(D) + """, a as (select project_id, bool_or(c = 151) as jwt, min(file_path) filter (where c = 151) as file from d group by 1)
 select project_id, jwt, false as passport, false as oauth, false as bcrypt, false as session, false as api_keys, case when jwt then '15m' end as jwt_expiry, cast(null as int) as bcrypt_rounds, case when jwt then 'authenticate' else '' end as middleware, coalesce(file, '') as files from a""")
def authentication(spark, sf_dir):
    a = detect.authentication(source_files(spark, sf_dir))
    return a.select("project_id", "jwt", "passport", "oauth", "bcrypt", "session", "api_keys", "jwt_expiry", "bcrypt_rounds", F.array_join("middleware", ",").alias("middleware"), F.array_join("files", ",").alias("files"))


_FIELDS = [(2, "name", "String", None, True), (2, "owner", "ObjectId", "M{u}", False), (2, "parts", "Array", "m{d}", False)]
FIELD = "field as (" + spec_sql(_FIELDS, "field, type, ref, required", "k, project_id, file_path, 'schema' || k as schema_name, 'M' || k as model, 'm' || k || 's' as collection, field, type, case when ref not like '%-%' then ref end as ref, required, false as \"unique\"", ("ref",)) + ")"


@query("model_fields", ctes(D, FIELD) + 'select project_id, file_path, schema_name, model, collection, field, type, ref, required, "unique" from field')
def model_fields(spark, sf_dir):
    return detect.mongoose_models(source_files(spark, sf_dir))


REL = "rel as (select a.project_id, a.model as from_model, b.model as to_model, a.field, case when a.field = 'parts' then 'one-to-many' else 'one-to-one' end as kind from field a join (select distinct project_id, model from field) b on a.project_id = b.project_id and lower(a.ref) = lower(b.model))"


@query("er_relations", ctes(D, FIELD, REL) + "select * from rel")
def er_relations(spark, sf_dir):
    f = detect.mongoose_models(source_files(spark, sf_dir))
    return graph.relationships(f.select("project_id", F.col("model").alias("name")).distinct(), f.select("project_id", "model", F.col("field").alias("name"), "type", "ref"))


@query("external_libraries", ctes(D, IMP) + """, u as (select project_id, file_path, specifiers, string_split(source, '/')[1] as name from imp where not starts_with(source, '.'))
 select project_id, name, count(*) as usage_count, string_agg(distinct file_path, ',' order by file_path) as files,
  coalesce((select string_agg(distinct s, ',' order by s) from (select unnest(string_split(x.specifiers, ',')) as s from u x where x.project_id = u.project_id and x.name = u.name) where s <> ''), '') as specifiers, false as is_dev from u group by project_id, name""")
def external_libraries(spark, sf_dir):
    lib = detect.external_libraries(parts(spark, sf_dir)[3])
    return lib.withColumns({"files": F.array_join("files", ","), "specifiers": F.array_join("specifiers", ",")})


@query("path_roles", ctes(D, SYM) + """select d.project_id, case when c = 1 then 'service' else 'model' end as role, d.file_path, string_split(string_split(d.file_path, '/')[-1], '.')[1] as name, (select count(*) from sym where sym.k = d.k and kind in ('function', 'arrow_function')) as total_functions from d where c in (1, 2)""")
def path_roles(spark, sf_dir):
    files, _, symbols, _, _ = parts(spark, sf_dir)
    role = lambda name, *words: detect.by_path(files, symbols, words).select("project_id", F.lit(name).alias("role"), "file_path", "name", F.col("total_functions").cast("long").alias("total_functions"))
    return role("service", "services/").unionByName(role("model", "models/"))


#: Every signal of every rule, and what it meets: contents, names, folders, configuration files or imports.
_SIGNALS = values([(r.name, k, j, kind, value, float(w), file, exact) for k, r in enumerate(RULES) for j, (kind, value, w, file, exact) in enumerate(r.signals)], "tech, rule_no, signal_no, type, value, weight, file_type, exact", "sig")
_RULES = values([(k, r.name, r.category, float(sum(s[2] for s in r.signals)), r.parent, r.excludes) for k, r in enumerate(RULES)], "rule_no, name, category, total, parent, excludes", "rule")
_CODE = "code as (select d.*, code from d join " + values([(c, t[3]) for c, t in __import__("codeloom.plans.synthetic", fromlist=["TEMPLATES"]).TEMPLATES.items()], "c, code") + " using (c))"
_DEPS = values([(140, "package.json", x) for x in ("express", "mongoose", "react", "react-dom", "jsonwebtoken", "vite")] + [(141, "requirements.txt", x) for x in ("flask", "pandas")], "c, ftype, dep", "deps")
TECH = f"""{_CODE}, fp as (select code.*, lower(string_split(file_path, '/')[-1]) as base, string_split(file_path, '/')[:-2] as dirs, code || ' ' || text as said from code),
 hit as (select distinct project_id, rule_no, signal_no, weight from fp join {_SIGNALS} on
   (type in ('pattern', 'url') and contains(code, value)) or (type = 'extension' and value <> 'test_' and ends_with(lower(file_path), value)) or (type = 'extension' and value = 'test_' and (starts_with(base, 'test_') or ends_with(base, '_test.py')))
   or (type = 'file' and base = lower(value)) or (type = 'dir' and (list_contains(dirs, value) or contains(array_to_string(dirs, '/') || '/', value || '/') and contains(value, '/'))) or (type = 'docker' and contains(file_path, 'docker-compose') and contains(code, value))
  union select distinct project_id, rule_no, signal_no, weight from d join {_DEPS} using (c) join {_SIGNALS} on type = 'dep' and ftype = file_type and case when ftype = 'requirements.txt' then starts_with(lower(dep), lower(value)) when exact then dep = value else contains(dep, value) end
  union select distinct project_id, rule_no, signal_no, weight from imp join {_SIGNALS} on type = 'import' and contains(source, value)),
 t0 as (select project_id, rule_no, name, category, parent, excludes, least(5, count(*)) as n_evidence, sum(weight) / any_value(total) as s0 from hit join {_RULES} using (rule_no) group by all),
 t1 as (select t0.*, case when exists (select 1 from t0 x where x.project_id = t0.project_id and x.name = t0.excludes and x.s0 >= 0.3 and x.rule_no < t0.rule_no) then s0 * 0.1 else s0 end as s1 from t0),
 t2 as (select t1.*, case when exists (select 1 from t1 x where x.project_id = t1.project_id and x.name = t1.parent and x.s1 >= 0.3 and floor(x.s1 * 100 + 0.5) / 100 >= 0.5 and x.rule_no < t1.rule_no) then least(1, s1 * 1.2) else s1 end as s2 from t1),
 tech as (select project_id, name, category, rule_no, least(1.0, floor(s2 * 100 + 0.5) / 100) as confidence, case when s2 >= 0.9 then 'definite' when s2 >= 0.7 then 'high' when s2 >= 0.5 then 'medium' else 'low' end as classification, n_evidence from t2 where s2 >= 0.3)"""
_NEED = values([(s.name, k, r, float(s.bonus), len(s.required), s.at_least or len(s.required)) for k, s in enumerate(STACKS) for r in s.required], "stack, stack_no, name, bonus, n_required, least_", "need")
STACK = f"""st as (select project_id, stack, stack_no, n_required, bonus, count(*) as n from tech join {_NEED} using (name) where confidence >= 0.4 group by all having count(*) >= any_value(least_)),
 raised as (select tech.project_id, tech.name, category, rule_no, n_evidence, least(1.0, confidence + coalesce((select sum(st.bonus) from st join {_NEED} on need.stack = st.stack where st.project_id = tech.project_id and st.n >= st.n_required and need.name = tech.name), 0)) as confidence from tech),
 r2 as (select *, case when confidence >= 0.9 then 'definite' when confidence >= 0.7 then 'high' when confidence >= 0.5 then 'medium' when confidence >= 0.3 then 'low' else 'speculative' end as classification from raised)"""


def _detected(spark, sf_dir):
    files, _, _, imports, configs = parts(spark, sf_dir)
    return detect.technologies(files, configs, imports)


def _tech(spark, sf_dir):
    return detect.stacks(_detected(spark, sf_dir))


@query("technologies", ctes(D, IMP, TECH) + "select project_id, name, category, confidence, classification, cast(n_evidence as int) as n_evidence from tech")
def technologies(spark, sf_dir):
    return _detected(spark, sf_dir).select("project_id", "name", "category", "confidence", "classification", F.size("evidence").alias("n_evidence"))


@query("tech_near_ties", ctes(D, IMP, TECH) + """select a.project_id, a.category, a.name, b.name as other, abs(cast(round(a.confidence * 100) as int) - cast(round(b.confidence * 100) as int)) / cast(100 as double) as gap
 from tech a join tech b on a.project_id = b.project_id and a.category = b.category and a.name < b.name and abs(cast(round(a.confidence * 100) as int) - cast(round(b.confidence * 100) as int)) <= 10""")
def tech_near_ties(spark, sf_dir):
    return detect.near_ties(_detected(spark, sf_dir))


@query("tech_stacks", ctes(D, IMP, TECH, STACK) + "select project_id, stack as name, stack_no, case when n >= n_required then 'full' else 'partial' end as match_type, floor(n / cast(n_required as double) * 100 + 0.5) / 100 as confidence from st")
def tech_stacks(spark, sf_dir):
    return _tech(spark, sf_dir)[0]


_TOP = lambda *cats: "coalesce(" + ", ".join(f"arg_max(name, (confidence, -rule_no)) filter (where category = '{c}')" for c in cats)


@query("tech_summary", ctes(D, IMP, TECH, STACK) + f"""select project_id, count(*) as total_technologies, {_TOP('language', 'frontend', 'backend')}, 'Unknown') as primary_language, {_TOP('frontend', 'backend')}, 'Unknown') as primary_framework, {_TOP('database')}, 'None detected') as primary_database,
 bool_or(category = 'authentication') as has_authentication, bool_or(category = 'testing') as has_testing, {_TOP('deployment')}, 'None detected') as deployment_method from r2 group by project_id""")
def tech_summary(spark, sf_dir):
    return detect.summary(_tech(spark, sf_dir)[1])


@query("tech_by_category", ctes(D, IMP, TECH, STACK) + "select project_id, category, string_agg(name, ', ' order by confidence desc, rule_no) as names from r2 group by 1, 2")
def tech_by_category(spark, sf_dir):
    return detect.by_category(_tech(spark, sf_dir)[1]).withColumn("names", F.array_join("names", ", "))


@query("tech_names", ctes(D, IMP, TECH, STACK) + f"select project_id, string_agg(name, ', ' order by list_position({list(CATEGORIES)}, category), confidence desc, rule_no) as names from r2 group by 1")
def tech_names(spark, sf_dir):
    return detect.names(_tech(spark, sf_dir)[1]).withColumn("names", F.array_join("names", ", "))


@query("tech_frameworks", ctes(D, IMP, TECH, STACK) + "select project_id, name, category, confidence from r2 where category in ('frontend', 'backend', 'build') and confidence >= 0.5")
def tech_frameworks(spark, sf_dir):
    return detect.frameworks(_tech(spark, sf_dir)[1])


@query("tech_report", ctes(D, IMP, TECH, STACK) + """, l as (select project_id, category, '  ' || rpad(name, 20, ' ') || ' ' || rpad(upper(classification), 12, ' ') || ' (' || cast(floor(confidence * 100 + 0.5) as int) || '%)' as line, confidence, rule_no from r2),
 g as (select project_id, category, upper(category) || ':' || chr(10) || string_agg(line, chr(10) order by confidence desc, rule_no) as part from l group by 1, 2) select project_id, string_agg(part, chr(10) || chr(10) order by category) as report from g group by 1""")
def tech_report(spark, sf_dir):
    return detect.report_text(_tech(spark, sf_dir)[1])


@query("tech_from_configs", ctes(D) + f"select distinct project_id, name from ({spec_sql([(140, x) for x in ('Express.js', 'Mongoose', 'React', 'Vite')] + [(141, 'Flask'), (141, 'Pandas'), (142, 'Node.js')], 'name', 'project_id, name')})")
def tech_from_configs(spark, sf_dir):
    return detect.from_configs(parts(spark, sf_dir, once=False)[4])


@query("interview_questions", ctes(D, IMP, TECH, STACK) + f""", q as (select project_id, part, ord, category, difficulty, question, null as technology, fb from (select distinct project_id from r2), {values([(q[0], q[1], q[2], knowledge.CATEGORIES.index(q[0]), i, False) for i, q in enumerate(knowledge.QUESTIONS)] + [(q[0], q[1], q[2], len(knowledge.CATEGORIES) + 1, i, True) for i, q in enumerate(knowledge.FALLBACK)], 'category, difficulty, question, part, ord, fb', 'bank')}
 union all select project_id, {len(knowledge.CATEGORIES)}, ord, 'tech-stack', difficulty, question, technology, false from (select distinct project_id, technology from r2 join {values([(a.lower(), n) for n, o in knowledge.ALIASES.items() for a in sorted({n, *o})], 'alias, technology', 'al')} on alias = lower(name)) join {values([(q[0], q[1], q[2], i) for i, q in enumerate(knowledge.TECH_QUESTIONS)], 'technology, difficulty, question, ord', 'tq')} using (technology)),
 once as (select * from q qualify row_number() over (partition by project_id, lower(question[:{knowledge.KEY}]) order by part, ord) = 1)
 select project_id, category, difficulty, question, technology from once where not fb or (select count(*) from once x where x.project_id = once.project_id and not x.fb) < {knowledge.LEAST}""")
def interview_questions(spark, sf_dir):
    q = knowledge.generate_questions(_tech(spark, sf_dir)[1].select("project_id", "name"))
    return q.select("project_id", "category", "difficulty", "question", "technology")


# -- findings --------------------------------------------------------------------------------------------------------

@query("performance_findings", ctes(D) + spec_sql([(1, "unbounded_find", "medium", 1)], "check_id, severity, n", "project_id, file_path, check_id, severity, n"))
def performance_findings(spark, sf_dir):
    return audit.scan(source_files(spark, sf_dir), "project_id", "file_path", audit.PERFORMANCE)


@query("unused_imports", ctes(D) + spec_sql([(1, "gone", 2), (1, "fs", 3), (5, "React", 1)], "name, line", "project_id, file_path, line, name"))
def unused_imports(spark, sf_dir):
    files, _, _, imports, _ = parts(spark, sf_dir)
    return audit.unused_imports(files, imports)


# -- views -----------------------------------------------------------------------------------------------------------

TREE = """fold as (select distinct project_id, array_to_string(s[1:i], '/') as path, 'directory' as type, null as language from (select project_id, string_split(file_path, '/') as s, unnest(range(1, len(string_split(file_path, '/')))) as i from d)),
 node as (select project_id, file_path as path, 'file' as type, language from d union all select * from fold),
 named as (select *, string_split(path, '/')[-1] as name, array_to_string(string_split(path, '/')[:-2], '/') as parent_path, cast(len(string_split(path, '/')) - 1 as int) as depth from node),
 tree as (select *, cast(row_number() over w as int) as position, lead(name) over w is null as is_last from named window w as (partition by project_id, parent_path order by type = 'directory', lower(name), name desc))"""


@query("tree", ctes(D, TREE) + "select project_id, path, type, language, parent_path, name, depth, position, is_last from tree")
def tree(spark, sf_dir):
    return views.tree_nodes(source_files(spark, sf_dir)).drop("size_kb")


@query("tree_text", ctes(D, TREE) + """, up as (select t.project_id, t.path, t.name, t.type, string_agg(lpad(cast(a.position as varchar), 8, '0'), '.' order by a.depth) as place, coalesce(string_agg(case when a.is_last then '    ' else '│   ' end, '' order by a.depth) filter (where a.path <> t.path), '') as lead_, bool_or(a.is_last and a.path = t.path) as last_
  from tree t join tree a on a.project_id = t.project_id and (t.path = a.path or starts_with(t.path, a.path || '/')) group by all)
 select project_id, '.' || chr(10) || string_agg(lead_ || case when last_ then '└── ' else '├── ' end || name || case when type = 'directory' then '/' else '' end, chr(10) order by place) as text from up group by project_id""")
def tree_text(spark, sf_dir):
    return views.tree_text(views.tree_nodes(source_files(spark, sf_dir)))


@query("dependency_view", ctes(D, IMP, DEP, EDGE) + f"""select project_id, file_path as id, string_split(file_path, '/')[-1] as label, {LAYER} as "group", cast(6 as double) as radius, (select count(*) filter (where source = file_path) + count(*) filter (where target = file_path) from edge where edge.project_id = d.project_id) as n_edges from d""")
def dependency_view(spark, sf_dir):
    return views.dependency_nodes(source_files(spark, sf_dir), graph.local_edges(resolved(spark, sf_dir)))


@query("dependency_links", ctes(D, IMP, DEP, EDGE) + "select project_id, source, target, count(*) as weight from edge group by 1, 2, 3")
def dependency_links(spark, sf_dir):
    return views.dependency_links(graph.local_edges(resolved(spark, sf_dir)))


@query("module_view", ctes(D, IMP, DEP, EDGE) + "select project_id, id, count(distinct t) || ' deps' as label from (select project_id, array_to_string(string_split(source, '/')[:-2], '/') as id, array_to_string(string_split(target, '/')[:-2], '/') as t from edge) group by 1, 2")
def module_view(spark, sf_dir):
    return views.module_view(graph.local_edges(resolved(spark, sf_dir)))


@query("call_view", ctes(D, SYM) + """select project_id, file_path || ':' || name as id, name as label, 'request' as phase, 0 as depth from sym where file_path = 'src/routes/index.js'
 union all select s.project_id, s.file_path || ':' || s.name, s.name, 'service', 1 from sym s join d on d.project_id = s.project_id and d.file_path = 'src/routes/index.js' and s.k = d.k + 1 where s.exported""")
def call_view(spark, sf_dir):
    return views.call_view(call_chain(spark, sf_dir))


@query("mermaid_graph", _ENDS + """, n as (select project_id, layer, list(file_path order by file_path) as files from lf group by 1, 2),
 row as (select project_id, 0 as k, layer as o, '  ' || layer || '["' || layer || '<br/>' || array_to_string(files[:5], ', ') || case when len(files) > 5 then ' +' || (len(files) - 5) || ' more' else '' end || '"]' as l from n
 union all select project_id, 1, source_layer || '>' || target_layer, '  ' || source_layer || ' -->|' || count(*) || '| ' || target_layer from le where source_layer <> target_layer group by project_id, source_layer, target_layer)
 select project_id, 'flowchart TD' || chr(10) || string_agg(l, chr(10) order by k, o) as text from row group by 1""")
def mermaid_graph(spark, sf_dir):
    return views.mermaid_layers(graph.layer_nodes(source_files(spark, sf_dir)), graph.layer_edges(graph.local_edges(resolved(spark, sf_dir))))


@query("mermaid_er", ctes(D, FIELD, REL) + """, row as (select project_id, 0 as k, model as o, '  ' || model || ' {' || chr(10) || string_agg('    ' || type || ' ' || field, chr(10) order by '    ' || type || ' ' || field) || chr(10) || '  }' as l from field group by project_id, model
 union all select project_id, 1, from_model || '>' || to_model || '>' || field, '  ' || from_model || case when kind = 'one-to-many' then ' ||--o{ ' else ' ||--|| ' end || to_model || ' : ' || field from rel)
 select project_id, 'erDiagram' || chr(10) || string_agg(l, chr(10) order by k, o) as text from row group by 1""")
def mermaid_er(spark, sf_dir):
    return views.mermaid_er(detect.mongoose_models(source_files(spark, sf_dir)), er_relations(spark, sf_dir))


@query("mermaid_sequence", ctes(D, ROUTE) + """, r as (select *, row_number() over (partition by project_id order by file, line, method, path) as n from route qualify n <= 15)
 select project_id, 'sequenceDiagram' || chr(10) || string_agg('  Client->>Server: ' || method || ' ' || path || case when n <= 10 then chr(10) || '  Note over Server: ' || string_split(file, '/')[-1] else '' end
  || chr(10) || '  Server->>Database: query' || chr(10) || '  Database-->>Server: rows' || chr(10) || '  Server-->>Client: response', chr(10) order by n) as text from r group by 1""")
def mermaid_sequence(spark, sf_dir):
    return views.mermaid_sequence(detect.routes(source_files(spark, sf_dir)), database=True)


@query("mermaid_flow", ctes(D, SYM) + """, s as (select project_id, 1 as step, 'request' as phase, name || '   - arrow_function in index.js' as what from sym where file_path = 'src/routes/index.js'
 union all select s.project_id, 2, 'service', s.name || '   - function in ' || string_split(s.file_path, '/')[-1] from sym s join d on d.project_id = s.project_id and d.file_path = 'src/routes/index.js' and s.k = d.k + 1 where s.exported),
 row as (select project_id, 0 as k, step as o, '  subgraph ' || phase || chr(10) || '    S' || step || '["' || what || '"]' || chr(10) || '  end' as l from s union all select project_id, 1, step, '  S1 --> S2' from s where step = 2)
 select project_id, 'flowchart LR' || chr(10) || string_agg(l, chr(10) order by k, o) as text from row group by 1""")
def mermaid_flow(spark, sf_dir):
    return views.mermaid_flow(call_chain(spark, sf_dir))
