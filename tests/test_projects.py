"""Parsing, detection and graphs over the sample repository."""

from pyspark.sql import functions as F
from tests.conftest import rows

from codeloom.operators import audit, chunking, detect, graph, knowledge, parsers, relational, views


def test_sources_leave_out_what_is_ignored(files):
    paths = rows(files, "file_path")
    assert ".env" in paths and ".github/workflows/ci.yml" in paths
    assert not paths & {"node_modules/x/i.js", "a.min.js", "logo.png", "nul.txt"}
    assert dict(files.where("project_id = 'shelf'").select("file_path", "language").collect())["client/App.jsx"] == "JavaScript (React)"


def test_directories_and_archives_read_alike(spark, files, tmp_path):
    import io
    import zipfile

    from codeloom.plans.sample import FILES
    from codeloom.sources.repositories import archive_totals, count_files, read_directories, read_zips

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("top/../../evil.js", "x")
        for name, text in FILES.items():
            at = tmp_path / "shelf" / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
            z.writestr(f"top/{name}", text)
    want = rows(files.where("project_id = 'shelf'"), "file_path", "content", "language", "loc")
    landed = read_directories(spark, {"shelf": str(tmp_path / "shelf")})
    assert rows(landed, "file_path", "content", "language", "loc") == want
    assert rows(read_zips(spark.createDataFrame([("shelf", buffer.getvalue())], "project_id string, content binary")), "file_path", "content", "language", "loc") == want
    assert count_files(spark, {"shelf": str(tmp_path / "shelf")}).first().n_files == len(FILES) - 1
    assert archive_totals(landed).first().file_count == len(want)


def test_symbols(files):
    got = rows(parsers.symbols(parsers.parse_files(files)), "file_path", "name", "kind", "exported")
    assert {("src/app.js", "start", "function", True), ("src/controllers/user.controller.js", "list", "arrow_function", True), ("client/App.jsx", "App", "component", True), ("client/App.jsx", "App", "function", True),
            ("svc/api.py", "Store", "class", True), ("svc/api.py", "put", "method", True), ("svc/api.py", "ping", "function", True), ("Api.java", "Api", "class", True), ("lib.cpp", "Shape", "class", False), ("lib.cpp", "area", "function", False),
            ("Lib.cs", "Lib", "class", True), ("main.go", "Run", "method", False), ("main.go", "Server", "class", False), ("x.php", "Page", "class", False), ("x.php", "helper", "function", False)} <= got


def test_python_fallback_for_broken_sources():
    got = parsers.parse("def f(a, b=1):\n  return (\nimport os\n", "Python")
    assert ("symbol", "function", "f", 1) in {r[:4] for r in got}
    assert any(r[4] == "os" for r in got)
    assert parsers.parse(None, "Python") == [] and parsers.parse("x", "Unknown") == []
    assert parsers.parse("nothing here", "Java")[0][0] == "error"


def test_imports_of_both_kinds(files):
    got = rows(parsers.imports(parsers.parse_files(files)), "from_file", "source", "kind")
    assert {("src/app.js", "express", "import"), ("src/app.js", "mongoose", "require"), ("svc/api.py", "flask", "from_import"), ("index.html", "style.css", "asset"), ("main.go", "fmt", "import"), ("lib.cpp", "vector", "include"), ("Lib.cs", "System.Linq", "using")} <= got


def test_configs(files):
    got = {r.file_path: r for r in parsers.configs(files.where("project_id = 'shelf'")).collect()}
    assert got["package.json"].dependencies["express"] == "^4.19.0" and got["package.json"].dev_dependencies == {"vite": "^5.0.0"}
    assert set(got["requirements.txt"].dependencies) == {"flask", "pandas", "pytest"}
    assert got["Dockerfile"].base_image == "node:20" and got[".env"]["keys"] == ["PORT", "JWT_SECRET"] and got["Makefile"]["keys"] == ["all", "build"]
    assert set(got["go.mod"].dependencies) == {"github.com/gorilla/mux"} and set(got["Gemfile"].dependencies) == {"rake"}


def resolved(files):
    return graph.resolve(parsers.imports(parsers.parse_files(files)), files)


def test_resolution_and_cycles(files):
    r = resolved(files)
    to = dict(r.where("from_file = 'src/x.js'").select("source", "to_file").collect())
    assert to["./dup"] == "src/dup.js" and to["./missing"] is None
    assert ("src/x.js", "./missing") in rows(graph.unresolved(r), "from_file", "source")
    assert rows(r.where("from_file = 'src/x.js'"), "source", "kind", "to_package") >= {("lodash/fp", "external", "lodash"), ("@scope/pkg/x", "external", "@scope/pkg"), ("fs", "builtin", None)}
    cycles = rows(graph.cycles(graph.local_edges(r)).select(F.array_join("cycle", ">").alias("c")), "c")
    assert cycles == {"src/cycle/a.js>src/cycle/b.js>src/cycle/c.js>src/cycle/a.js", "src/cycle/c.js>src/cycle/c.js"}
    assert graph.grouped_back(r).where("from_file = 'src/x.js'").first().dependencies[0].line == 1


def test_canonical_cycle(spark):
    assert spark.createDataFrame([(["c", "a", "b", "c"],)], "cycle array<string>").select(graph.canonical_cycle().alias("x")).first().x == "a > b > c > a"


def test_layers_and_knowledge_graph(files):
    edges = graph.local_edges(resolved(files))
    nodes = graph.layer_nodes(files)
    assert sum(r.file_count for r in nodes.collect()) == files.count()
    assert ("controller", "service") in rows(graph.layer_edges(edges), "source_layer", "target_layer")
    parsed = parsers.parse_files(files)
    r = resolved(files)
    n, e = graph.knowledge_graph(files, parsers.symbols(parsed), edges, r.where("to_package is not null").select("project_id", "from_file", "to_package"), detect.routes(files))
    ids = rows(n, "project_id", "id")
    assert all((x.project_id, x.source) in ids and (x.project_id, x.target) in ids for x in e.collect())
    assert len(ids) == n.count()


def test_a_walk_is_computed_once(files):
    """Projects without a step are found by the steps of the others, which are not walked again for that."""
    symbols = parsers.symbols(parsers.parse_files(files))
    steps = graph.walk(files, symbols, resolved(files).select("project_id", "from_file", "to_file", "line"), graph.entry_points(files))
    assert steps._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 0
    assert rows(steps, "project_id") == {"shelf", "tiny"}


def test_walk_and_flows(files):
    symbols = parsers.symbols(parsers.parse_files(files))
    edges = resolved(files).select("project_id", "from_file", "to_file", "line")
    entry = files.select("project_id").distinct().withColumn("entry", F.lit("src/app.js"))
    steps = graph.walk(files, symbols, edges, entry).where("project_id = 'shelf'").orderBy("step").collect()
    assert [(s.symbol, s.depth) for s in steps][:3] == [("start", 0), ("list", 2), ("create", 2)]
    assert {s.symbol for s in steps} >= {"findUsers", "addUser", "authenticate"}
    assert graph.walk(files, symbols, edges, entry).where("project_id = 'tiny'").first().kind == "module"
    reach = {r.node: r.depth for r in graph.reach(graph.local_edges(resolved(files)), entry.select("project_id", F.col("entry").alias("root"))).where("project_id = 'shelf'").collect()}
    assert reach["src/app.js"] == 0 and reach["src/models/User.js"] == 4
    assert [r.phase for r in graph.request_flow(files).where("project_id = 'shelf'").orderBy("step").collect()][0] == "request"
    assert rows(graph.flow_kind(files, detect.routes(files), detect.operations(files)), "project_id", "flow") == {("shelf", "request"), ("tiny", "call_chain")}


def test_routes(files):
    got = rows(detect.routes(files), "method", "path", "file", "line")
    assert {("GET", "/health", "src/app.js", 8), ("USE", "/users", "src/app.js", 7), ("POST", "/", "src/routes/user.routes.js", 7), ("GET,POST", "/items", "svc/api.py", 12), ("GET", "/ping", "svc/api.py", 17), ("GET", "/api/books", "Api.java", 8)} <= got


def test_models_and_relations(files):
    f = detect.mongoose_models(files)
    assert rows(f, "model", "field", "type", "ref", "required", "unique") == {("Post", "title", "String", None, True, False), ("Post", "author", "ObjectId", "User", False, False), ("User", "name", "String", None, True, False), ("User", "email", "String", None, False, True), ("User", "posts", "Array", "Post", False, False)}
    rel = graph.relationships(f.select("project_id", F.col("model").alias("name")).distinct(), f.select("project_id", "model", F.col("field").alias("name"), "type", "ref"))
    assert rows(rel, "from_model", "to_model", "kind") == {("User", "Post", "one-to-many"), ("Post", "User", "one-to-one")}


def test_contents(files):
    env = {r.name: r for r in detect.environment(files).collect()}
    assert env["PORT"].value == "***masked***" and env["MONGO_URL"].detected == "reference" and env["JWT_SECRET"].detected == "file"
    a = detect.authentication(files).where("project_id = 'shelf'").first()
    assert a.jwt and a.bcrypt and not a.passport and a.jwt_expiry == "15m" and a.middleware == ["authenticate"]
    assert {"Database query: find()", "Sort query results", "Limit query results", "Define Mongoose model"} <= rows(detect.operations(files), "description")
    assert ("express_middleware", "router", "/users") in rows(detect.middleware(files), "type", "name", "path")
    lib = {r.name: r for r in detect.external_libraries(parsers.imports(parsers.parse_files(files))).where("project_id = 'shelf'").collect()}
    assert lib["express"].usage_count == 2 and lib["lodash"].usage_count == 1 and "." not in lib


def detect_of(spark, contents):
    from codeloom.sources.repositories import described

    f = described(spark.createDataFrame([("p", k, v, len(v)) for k, v in contents.items()], "project_id string, file_path string, content string, n_bytes long"))
    return detect.technologies(f, parsers.configs(f), parsers.imports(parsers.parse_files(f)))


def test_technology_scores(spark):
    assert rows(detect_of(spark, {"netlify.toml": "x"}), "name", "confidence", "classification") == {("Netlify", 1.0, "definite")}
    assert rows(detect_of(spark, {"vercel.json": "{}"}), "name", "confidence", "classification") == {("Vercel", 0.53, "medium")}
    assert rows(detect_of(spark, {"Dockerfile": "FROM x"}), "name") == set()
    assert rows(detect_of(spark, {"package.json": '{"dependencies": {"express": "4"}}'}), "name", "confidence", "classification") == {("Node.js", 0.35, "low")}
    assert ("GitHub Actions", 1.0) in rows(detect_of(spark, {".github/workflows/a.yml": "on: push"}), "name", "confidence")


def test_parent_raises_and_exclusion_lowers(spark):
    from codeloom.operators.rules import Rule, sig
    from codeloom.sources.repositories import described

    rules = (Rule("A", "backend", sig("file", 1.0, "a.txt")), Rule("B", "backend", (*sig("file", 0.5, "a.txt"), *sig("file", 0.5, "no.txt")), "A"), Rule("C", "build", sig("file", 1.0, "a.txt"), excludes="A"), Rule("D", "build", sig("file", 1.0, "a.txt"), excludes="Z"), Rule("Z", "build", sig("file", 1.0, "a.txt")))
    f = described(spark.createDataFrame([("p", "x/a.txt", "", 0)], "project_id string, file_path string, content string, n_bytes long"))
    got = detect.technologies(f, parsers.configs(f), parsers.imports(parsers.parse_files(f)), rules)
    assert rows(got, "name", "confidence") == {("A", 1.0), ("B", 0.6), ("D", 1.0), ("Z", 1.0)}


def test_stacks(spark):
    tech = spark.createDataFrame([("p", n, "backend", k, c, "low", []) for k, (n, c) in enumerate([("MongoDB", 0.5), ("Express.js", 0.45), ("React", 0.95), ("Node.js", 0.4), ("Next.js", 0.4), ("TypeScript", 0.6), ("Prisma", 0.5)])],
                                 "project_id string, name string, category string, rule_no int, confidence double, classification string, evidence array<string>")
    found, raised = detect.stacks(tech)
    assert rows(found, "name", "match_type", "confidence") == {("MERN Stack", "full", 1.0), ("T3 Stack", "partial", 0.75)}
    conf = dict(raised.select("name", "confidence").collect())
    assert round(conf["MongoDB"], 6) == 0.6 and conf["React"] == 1.0 and conf["TypeScript"] == 0.6
    assert detect.summary(raised).first().total_technologies == 7
    assert detect.names(raised).first().names[0] == "React"


def test_chunks(files):
    assert chunking.chunks_of("const a = 1;\n\nfunction add(x, y) {\n  return x + y;\n}", "JavaScript") == [(2, 4, "function add(x, y) {\n  return x + y;\n}", "add", "function", 11, False), (0, 1, "const a = 1;", None, None, 4, False)]
    assert chunking.chunks_of("", "Python") == []
    assert [f[2:] for f in chunking.functions("class A:\n    def f(self):\n        pass\n\ndef g():\n    return 1\n", "Python")] == [("A", "class"), ("g", "function")]
    long = "\n".join(f"line {i} of a text that is long" for i in range(300))
    parts = chunking.chunks_of(long, "Markdown")
    assert "\n".join(p[2] for p in parts) == long and all(p[5] <= 520 for p in parts)
    big = "function big() {\n" + "\n".join(f"  call({i});" for i in range(900)) + "\n}"
    assert all(c[6] and c[3] == "big" for c in chunking.chunks_of(big, "JavaScript"))
    got = chunking.chunk_files(files).groupBy("project_id", "file_path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("s")).collect()
    for r in got:
        spans = sorted((x.start_line, x.end_line) for x in r.s)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), r.file_path


def test_packs(spark):
    f = spark.createDataFrame([("p", f"f{i}", "x" * n) for i, n in enumerate((35, 35, 700, 35))], "project_id string, file_path string, content string")
    assert rows(chunking.pack_files(f, "project_id", 20), "file_path", "pack_no") == {("f0", 0), ("f1", 0), ("f2", 1), ("f3", 2)}


def test_questions(spark):
    detected = spark.createDataFrame([("p", "react-router-dom"), ("p", "GITHUB ACTIONS"), ("q", "none")], "project_id string, name string")
    q = knowledge.generate_questions(detected)
    assert rows(q.where("technology is not null"), "project_id", "technology") == {("p", "React"), ("p", "GitHub Actions")}
    few = knowledge.question_rows(spark, knowledge.QUESTIONS[:2])
    assert q.where("fallback").count() == 0 and knowledge.generate_questions(detected, few).where("fallback and project_id = 'q'").count() == 3
    assert {r.n for r in knowledge.question_stats(q.where("project_id = 'q'")).where("category is not null").collect()} == {2}


def test_resources(spark):
    catalogue = spark.createDataFrame([("React", "frontend", "https://react.dev", ["components", "state"])], "name string, category string, url string, concepts array<string>")
    aliases = spark.createDataFrame([("reactjs", "React")], "alias string, name string")
    got = knowledge.learning_resources(spark.createDataFrame([("p", "ReactJS"), ("p", "Odd")], "project_id string, name string"), catalogue, aliases)
    assert rows(got, "name", "url") == {("React", "https://react.dev"), ("Odd", None)}
    assert rows(knowledge.not_collected(spark.createDataFrame([("p", "React"), ("p", "Vue")], "project_id string, name string"), got), "name") == {"Vue"}
    assert rows(knowledge.top_concepts(knowledge.concept_index(catalogue.withColumnRenamed("name", "technology")), 1), "concept") == {"components"}


def test_audit(spark, files):
    f = spark.createDataFrame([("p", "a.js", "eval(x);\nconst password = 'hunter2hunter2';\nfor (const a of b) {\n  for (const c of a) {\n  }\n}\n"), ("p", "b.js", "ok")], "project_id string, file_path string, content string")
    found = audit.scan(f, "project_id", "file_path", audit.SECURITY)
    assert rows(found, "check_id", "severity") == {("eval", "high"), ("hardcoded_secret", "critical")}
    assert rows(audit.summary(found, "project_id"), "severity", "position", "n_issues") == {("critical", 0, 1), ("high", 1, 1)}
    assert rows(audit.nested_loops(f), "file_path") == {"a.js"}
    assert ("src/x.js", "gone") in rows(audit.unused_imports(files, parsers.imports(parsers.parse_files(files))), "file_path", "name")
    body = "function f() {\n" + "\n".join(f"  step{i}(a, b);" for i in range(30)) + "\n}"
    c = chunking.chunk_files(spark.createDataFrame([("p", "a.js", "JavaScript", body), ("p", "b.js", "JavaScript", body.replace("step7", "other"))], "project_id string, file_path string, language string, content string"))
    assert audit.similar_functions(c).first().similarity >= 0.8
    assert rows(audit.large_functions(c, 10), "function_name") == {"f"}


def test_views(files):
    f = detect.mongoose_models(files)
    rel = graph.relationships(f.select("project_id", F.col("model").alias("name")).distinct(), f.select("project_id", "model", F.col("field").alias("name"), "type", "ref"))
    assert "  User ||--o{ Post : posts" in views.mermaid_er(f, rel).first().text
    seq = views.mermaid_sequence(detect.routes(files)).where("project_id = 'shelf'").first().text
    assert seq.startswith("sequenceDiagram\n") and "Client->>Server: GET /health" in seq
    tree = {r.project_id: r.text for r in views.tree_text(views.tree_nodes(files)).collect()}["tiny"]
    assert tree == ".\n├── netlify.toml\n├── package.json\n└── src/\n    └── one.ts"
    nodes = graph.layer_nodes(files)
    text = views.mermaid_layers(nodes, graph.layer_edges(graph.local_edges(resolved(files)))).where("project_id = 'shelf'").first().text
    assert "controller -->|1| service" in text and " more" in text
    radius = rows(views.dependency_nodes(files, graph.local_edges(resolved(files))), "radius")
    assert all(6.0 <= r <= 24.0 for r in radius)


def test_event_frames(spark):
    lines = spark.createDataFrame([('data: {"phase":"a","user_id":1}',), ("data: [DONE]",), (": ping",), ("",)], "line string")
    got = views.parse_frames(lines).collect()
    assert [(r.event.phase, r.event.user_id) for r in got] == [("a", 1)]


def test_relational(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(relational.upsert(f, new, ["k"]), "k", "v") == {(1, "a"), (2, "c"), (3, "d")}
    assert relational.or_all(f, F.col("k") > 9).count() == 2 and relational.or_all(f, F.col("k") > 1).count() == 1


def test_imports_meet_files_without_a_broadcast(spark, tmp_path):
    """What an import finds grows with the files; a guess from compressed files had it broadcast, and the driver ran out of memory at 1 GB."""
    named = ["a.js", "a.jsx", "a/index.js", "lib/b", "lib/b.ts", "index.js", ".js", "lib/x.h", "lib/x.c", "y/index.py"]
    own = spark.createDataFrame([("p", f) for f in named] + [("p", "a.js")], "project_id string, file_path string")
    said = ["./a", "../a", "./b", "./x", "./index", "../y", "./gone", "react", "fs"]
    imports = spark.createDataFrame([("p", "lib/m.js", s, "JavaScript", k) for k, s in enumerate(said)], "project_id string, from_file string, source string, language string, line int")
    own.write.parquet(f"{tmp_path}/files")
    imports.write.parquet(f"{tmp_path}/imports")
    got = graph.resolve(spark.read.parquet(f"{tmp_path}/imports"), spark.read.parquet(f"{tmp_path}/files"))
    assert {r.source: r.to_file for r in got.collect()} == {"./a": None, "../a": "a.js", "./b": "lib/b", "./x": "lib/x.c", "./index": None, "../y": "y/index.py", "./gone": None, "react": None, "fs": None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
