"""What a repository uses: technologies, stacks, routes, middleware, environment, authentication, models, database operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.chunking import closing_brace, split_depth0
from codeloom.operators.relational import first_n, first_wins
from codeloom.operators.rules import CATEGORIES, RULES, STACKS, Rule
from codeloom.session import stored

P = "project_id"


def signal_rows(spark, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.name, k, j, kind, value, float(w), file, exact) for k, r in enumerate(rules) for j, (kind, value, w, file, exact) in enumerate(r.signals)]
    return spark.createDataFrame(rows, "tech string, rule_no int, signal_no int, type string, value string, weight double, file_type string, exact boolean")


def matched_signals(files: DataFrame, configs: DataFrame, imports: DataFrame, signals: DataFrame, import_mode: str = "source") -> DataFrame:
    """project_id, rule_no, signal_no, file (the first that shows it). Rules are a literal table of a few hundred rows; file
    names and directories meet them by equality, contents and extensions as one pass of each file over the table's values."""
    signals = F.broadcast(signals)
    of = lambda *kinds: signals.where(F.col("type").isin(*kinds))
    key = [P, "rule_no", "signal_no"]
    content = F.coalesce("content", F.lit(""))
    literals = [(r["rule_no"], r["signal_no"], r["type"], r["value"]) for r in of("pattern", "url", "extension", "docker").select("rule_no", "signal_no", "type", "value").collect()]  # a literal table
    path, base, compose = F.lower("file_path"), X.basename("file_path"), F.contains("file_path", F.lit("docker-compose"))

    def shows(kind: str, value: str):
        if kind == "extension":
            return base.startswith("test_") | base.endswith("_test.py") if value == "test_" else path.endswith(value)
        return compose & F.contains(content, F.lit(value)) if kind == "docker" else F.contains(content, F.lit(value))

    found = F.array(*[F.when(shows(kind, value), F.struct(F.lit(r).alias("rule_no"), F.lit(s).alias("signal_no"))) for r, s, kind, value in literals])
    inside = files.select(P, "file_path", F.explode(F.array_compact(found)).alias("s_")).select(P, "s_.rule_no", "s_.signal_no", "file_path") if literals else files.limit(0).select(P, F.lit(0).alias("rule_no"), F.lit(0).alias("signal_no"), "file_path")
    named = files.select(P, "file_path", F.lower(X.basename("file_path")).alias("v_")).join(of("file").withColumn("v_", F.lower("value")), "v_").select(*key, "file_path")
    parts = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.get(parts, i - 1), F.get(parts, i)))
    dirs = files.select(P, "file_path", F.explode(F.array_distinct(F.concat(parts, F.when(F.size(parts) > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("value")).join(of("dir"), "value").select(*key, "file_path")
    deps = F.map_keys(F.map_concat(F.coalesce("dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("dev_dependencies", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("dependencies"), k), F.lit(False)))))
    value = F.col("value")
    has = (F.when(F.col("file_type") == "requirements.txt", F.exists("d_", lambda d: F.lower(d).startswith(F.lower(value)))).when(F.col("file_type") == "pom.xml", F.contains("raw", value))
           .when(F.col("exact"), F.array_contains("d_", value)).otherwise(F.exists("d_", lambda d: F.contains(d, value))))
    by_dep = configs.select(P, "file_path", "file_type", "raw", deps.alias("d_")).join(of("dep"), "file_type").where(has).select(*key, "file_path")
    said = F.col("source") if import_mode == "source" else F.concat(F.lit("import "), F.array_join(F.coalesce("specifiers", F.array().cast("array<string>")), ", "), F.lit(" from '"), "source", F.lit("'"))
    by_import = imports.select(P, F.col("from_file").alias("file_path"), said.alias("s_")).join(of("import"), F.contains("s_", value)).select(*key, "file_path")
    every = inside
    for part in (named, dirs, by_dep, by_import):
        every = every.unionByName(part)
    return every.groupBy(*key).agg(F.min("file_path").alias("file"))


def technologies(files: DataFrame, configs: DataFrame, imports: DataFrame, rules: tuple[Rule, ...] = RULES, import_mode: str = "source", weak_factor: float = 1.0) -> DataFrame:
    """project_id, name, category, rule_no, confidence, classification, evidence (at most 5): matched weight over all weight; a tenth
    after an exclusive rule; a fifth more under a parent of 0.5 or above; classes are given before rounding. ``weak_factor`` (0.7, say; 1 is off) lowers a score
    that signals of less than 0.5 alone make."""
    spark = files.sparkSession
    signals = signal_rows(spark, rules)
    hit = matched_signals(files, configs, imports, signals, import_mode).join(F.broadcast(signals), ["rule_no", "signal_no"])
    total = {k: sum(s[2] for s in r.signals) for k, r in enumerate(rules)}
    meta = spark.createDataFrame([(k, r.name, r.category, float(total[k]), r.parent, r.excludes) for k, r in enumerate(rules)], "rule_no int, name string, category string, total double, parent string, excludes string")
    ev = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("signal_no", "type", "value", "file"))), 1, 5), lambda s: F.struct(s["type"].alias("signal"), s["value"].alias("value"), s["file"].alias("file")))
    got = hit.groupBy(P, "rule_no").agg(F.sum("weight").alias("matched"), F.max("weight").alias("strongest"), ev.alias("evidence"))
    # what follows meets itself several times: files are searched once; sizes guessed from compressed files are too small, so those joins are merges
    got = stored(got, "matched").join(F.broadcast(meta), "rule_no").withColumn("score", F.col("matched") / F.col("total"))
    if weak_factor != 1.0:
        got = got.withColumn("score", F.when(F.col("strongest") < 0.5, F.col("score") * weak_factor).otherwise(F.col("score")))
    # a rule sees only what comes before it: exclusion first, then parents, whose own parents come earlier still
    seen = got.select(P, F.col("name").alias("excludes"), F.lit(True).alias("x_"), F.col("rule_no").alias("xr_")).where(X.confidence_class("score") != "speculative")
    got = got.join(seen.hint("merge"), [P, "excludes"], "left").withColumn("score", F.when(F.coalesce(F.col("x_") & (F.col("xr_") < F.col("rule_no")), F.lit(False)), F.col("score") * 0.1).otherwise(F.col("score"))).drop("x_", "xr_")
    for level in _levels(rules):
        parent = got.where(X.confidence_class("score") != "speculative").select(P, F.col("name").alias("parent"), X.round_half_up("score", 2).alias("p_"), F.col("rule_no").alias("pr_"))
        got = got.join(parent.hint("merge"), [P, "parent"], "left").withColumn("score", F.when(F.col("rule_no").isin(*level) & F.coalesce((F.col("p_") >= 0.5) & (F.col("pr_") < F.col("rule_no")), F.lit(False)), F.least(F.lit(1.0), F.col("score") * 1.2)).otherwise(F.col("score"))).drop("p_", "pr_")
    out = got.withColumn("classification", X.confidence_class("score")).where("classification <> 'speculative'")
    return out.select(P, "name", "category", "rule_no", F.least(F.lit(1.0), X.round_half_up("score", 2)).alias("confidence"), "classification", "evidence")


def near_ties(tech: DataFrame, within: float = 0.1, exclusive: set[tuple[str, str]] | None = None) -> DataFrame:
    """project_id, category, name, other, gap: technologies of a category whose confidences are at most ``within`` apart, each pair once by name.

    ``exclusive`` keeps the pairs of names that rule each other out, either way round: those are conflicts. Confidences are hundredths, so the band
    is compared in whole numbers; a project and category hold at most one row a rule. Null projects, categories and confidences pair with nothing.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    a = tech.select(P, "category", "name", cents("confidence").alias("c_"))
    b = tech.select(P, "category", F.col("name").alias("other"), cents("confidence").alias("d_"))
    out = a.join(b.hint("merge"), [P, "category"]).where((F.col("name") < F.col("other")) & (F.abs(F.col("c_") - F.col("d_")) <= round(within * 100)))
    if exclusive is not None:
        pairs = [sorted(p) for p in exclusive]
        out = out.where(F.struct("name", "other").isin(*[F.struct(F.lit(x).alias("name"), F.lit(y).alias("other")) for x, y in pairs]) if pairs else F.lit(False))
    return out.select(P, "category", "name", "other", (F.abs(F.col("c_") - F.col("d_")) / 100).alias("gap"))


def _levels(rules: tuple[Rule, ...]) -> list[list[int]]:
    """Rules with a parent, those of rules without parents first."""
    parents, names = {r.name: r.parent for r in rules}, [r.name for r in rules]
    depth = lambda n: 0 if not parents.get(n) else 1 + depth(parents[n])
    deepest = max(map(depth, names))
    return [[k for k, n in enumerate(names) if depth(n) == d] for d in range(1, deepest + 1)]


def stacks(tech: DataFrame, table: tuple = STACKS) -> tuple[DataFrame, DataFrame]:
    """(stacks: project_id, name, match_type, confidence; tech with bonuses of the full ones, at most 1)."""
    spark = tech.sparkSession
    need = F.broadcast(spark.createDataFrame([(s.name, k, r, float(s.bonus), len(s.required), s.at_least or len(s.required)) for k, s in enumerate(table) for r in s.required], "stack string, stack_no int, name string, bonus double, n_required int, least int"))
    have = tech.where("confidence >= 0.4").select(P, "name")
    found = have.join(need, "name").groupBy(P, "stack", "stack_no", "n_required", "least", "bonus").agg(F.count("*").alias("k")).where("k >= least")
    full = found.where("k >= n_required")
    plus = full.select(P, "stack", "bonus").join(need.drop("bonus"), "stack").groupBy(P, "name").agg(F.sum("bonus").alias("plus_"))
    raised = tech.join(plus.hint("merge"), [P, "name"], "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("plus_", F.lit(0.0)))).withColumn("classification", X.confidence_class("confidence")).drop("plus_")
    return found.select(P, F.col("stack").alias("name"), "stack_no", F.when(F.col("k") >= F.col("n_required"), "full").otherwise("partial").alias("match_type"), X.round_half_up(F.col("k") / F.col("n_required"), 2).alias("confidence")), raised


def by_category(tech: DataFrame) -> DataFrame:
    return tech.groupBy(P, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("confidence").alias("c"), "rule_no", "name"))), lambda s: s["name"]).alias("names"))


def summary(tech: DataFrame) -> DataFrame:
    """One row a project: number of technologies and the first of each kind, with fallbacks."""
    top = lambda *cats: F.coalesce(*[F.max_by(F.when(F.col("category") == c, F.col("name")), F.when(F.col("category") == c, F.struct("confidence", F.negative("rule_no")))) for c in cats])
    any_ = lambda c: F.max((F.col("category") == c).cast("int")) == 1
    return tech.groupBy(P).agg(F.count("*").alias("total_technologies"), F.coalesce(top("language", "frontend", "backend"), F.lit("Unknown")).alias("primary_language"), F.coalesce(top("frontend", "backend"), F.lit("Unknown")).alias("primary_framework"),
                               F.coalesce(top("database"), F.lit("None detected")).alias("primary_database"), any_("authentication").alias("has_authentication"), any_("testing").alias("has_testing"), F.coalesce(top("deployment"), F.lit("None detected")).alias("deployment_method"))


def names(tech: DataFrame) -> DataFrame:
    """Names in the order of the report's categories, by confidence, each once."""
    order = F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORIES) for x in (c, k)])
    return tech.groupBy(P).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.try_element_at(order, F.col("category")).alias("k"), F.negative("confidence").alias("c"), "rule_no", "name"))), lambda s: s["name"])).alias("names"))


def report_text(tech: DataFrame) -> DataFrame:
    line = F.concat(F.lit("  "), F.rpad("name", 20, " "), F.lit(" "), F.rpad(F.upper("classification"), 12, " "), F.lit(" ("), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%)"))
    own = tech.groupBy(P, "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("confidence").alias("c"), "rule_no", line.alias("l")))), lambda s: s["l"]), "\n").alias("t_"))
    return own.groupBy(P).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "t_"))), lambda s: F.concat(F.upper(s["category"]), F.lit(":\n"), s["t_"])), "\n\n").alias("report"))


def frameworks(tech: DataFrame) -> DataFrame:
    return tech.where(F.col("category").isin("frontend", "backend", "build") & (F.col("confidence") >= 0.5)).select(P, "name", "category", "confidence")


#: Names that configuration files alone give away, by dependency and by base image.
PACKAGES = {"react": "React", "next": "Next.js", "vue": "Vue.js", "@angular/core": "Angular", "express": "Express.js", "fastify": "Fastify", "typescript": "TypeScript", "tailwindcss": "Tailwind CSS",
            "d3": "D3.js", "mermaid": "Mermaid", "mongoose": "Mongoose", "prisma": "Prisma", "jest": "Jest", "vitest": "Vitest", "webpack": "Webpack"}
PYTHON_PACKAGES = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI", "tensorflow": "TensorFlow", "pytorch": "PyTorch", "pandas": "Pandas", "numpy": "NumPy"}
IMAGES = {"node": "Node.js", "python": "Python", "openjdk": "Java", "nginx": "Nginx"}


def from_configs(configs: DataFrame) -> DataFrame:
    """project_id, name: technologies by configuration files alone."""
    spark = configs.sparkSession
    pairs = [("package.json", k, v) for k, v in PACKAGES.items()] + [("requirements.txt", k, v) for k, v in PYTHON_PACKAGES.items()]
    known = F.broadcast(spark.createDataFrame(pairs, "file_type string, dep string, name string"))
    deps = configs.select(P, "file_type", F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("dev_dependencies"), F.array().cast("array<string>"))))).alias("dep"))
    script = F.to_json("scripts")
    whole = [(F.col("file_type") == "go.mod", "Go"), (F.col("file_type") == "Cargo.toml", "Rust"), (F.contains(script, F.lit("vite")), "Vite"), (F.contains(script, F.lit("next")), "Next.js"), *((F.contains("base_image", F.lit(k)), v) for k, v in IMAGES.items())]
    rest = configs.select(P, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in whole]))).alias("name"))
    return deps.join(known, ["file_type", "dep"]).select(P, "name").unionByName(rest).distinct()


# -- one pass over contents ------------------------------------------------------------------------------------------

#: Routes of each family of languages; where the method is fixed it is named.
ROUTES = {
    "express": r"\b(?:app|router)\.(get|post|put|delete|patch|use)\s*\(\s*['\"]([^'\"]+)['\"]",
    "python": r"@(?:app|router|bp)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]",
    "flask": r"@(?:app|bp)\.route\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*methods\s*=\s*\[([^\]]+)\]",
    "spring": r"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*['\"]([^'\"]+)['\"]",
    "spring_request": r"@RequestMapping\s*\(\s*value\s*=\s*['\"]([^'\"]+)['\"]\s*,\s*method\s*=\s*RequestMethod\.(\w+)",
}


def content_lines(files: DataFrame) -> DataFrame:
    """files as rows of project_id, file_path, language, line (from 1), text."""
    return files.select(P, "file_path", "language", F.posexplode(X.lines("content")).alias("l_", "text")).select(P, "file_path", "language", (F.col("l_") + 1).alias("line"), "text")


def routes(files: DataFrame, per_family: int = 50, most: int = 100) -> DataFrame:
    """project_id, method, path, file, line, family; the first of each family and project in order of file, line and place."""
    rows = content_lines(files.where(F.col("language").rlike("JavaScript|TypeScript|^Python$|^Java$")))
    lang = F.col("language")

    def found(name: str, where, method: int, path: int) -> DataFrame:
        pattern = F.lit(ROUTES[name])
        both = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(method)).alias("m"), F.regexp_extract_all("text", pattern, F.lit(path)).alias("p"))
        return rows.where(where).select(P, "file_path", "line", F.posexplode(both).alias("k_", "x_"), F.lit(name.split("_")[0].replace("flask", "python")).alias("family")).select(P, F.upper(F.regexp_replace("x_.m", r"['\"\s]", "")).alias("method"), F.col("x_.p").alias("path"), F.col("file_path").alias("file"), "line", "family", "k_")

    every = found("express", lang.rlike("JavaScript|TypeScript"), 1, 2).unionByName(found("python", lang == "Python", 1, 2)).unionByName(found("flask", lang == "Python", 2, 1))
    java = found("spring", lang == "Java", 1, 2).unionByName(found("spring_request", lang == "Java", 2, 1))
    base = files.where("language = 'Java'").select(P, F.col("file_path").alias("file"), F.regexp_extract("content", r"@RequestMapping\s*\(\s*['\"]([^'\"]+)['\"]", 1).alias("b_"))
    java = java.join(base.hint("merge"), [P, "file"], "left").withColumn("path", F.concat(F.coalesce("b_", F.lit("")), "path")).select(every.columns)
    every = every.unionByName(java).withColumn("fam_no", F.when(F.col("family") == "express", 0).when(F.col("family") == "python", 1).otherwise(2))
    capped = first_n(every, [P, "family"], ["file", "line", "k_"], per_family)
    return first_n(capped, [P], ["fam_no", "file", "line", "k_"], most).drop("fam_no", "k_")


#: Database operations by pattern, description and phase.
OPERATIONS = (
    (r"mongoose\.connect\s*\(", "Connect to MongoDB", "database"),
    (r"mongoose\.model\s*\(", "Define Mongoose model", "model"),
    (r"new\s+mongoose\.Schema\s*\(", "Define Mongoose schema", "model"),
    (r"\.find\s*\(", "Database query: find()", "database"),
    (r"\.findOne\s*\(", "Database query: findOne()", "database"),
    (r"\.findById\s*\(", "Database query: findById()", "database"),
    (r"\.create\s*\(", "Database insert: create()", "database"),
    (r"\.save\s*\(", "Database save: save()", "database"),
    (r"\.updateOne\s*\(", "Database update: updateOne()", "database"),
    (r"\.updateMany\s*\(", "Database update: updateMany()", "database"),
    (r"\.deleteOne\s*\(", "Database delete: deleteOne()", "database"),
    (r"\.deleteMany\s*\(", "Database delete: deleteMany()", "database"),
    (r"\.findByIdAndUpdate\s*\(", "Database: findByIdAndUpdate()", "database"),
    (r"\.findByIdAndDelete\s*\(", "Database: findByIdAndDelete()", "database"),
    (r"\.populate\s*\(", "Populate referenced documents", "model"),
    (r"\.aggregate\s*\(", "MongoDB aggregation pipeline", "database"),
    (r"\.exec\s*\(", "Execute Mongoose query", "database"),
    (r"\.lean\s*\(", "Return plain JavaScript object", "model"),
    (r"\.select\s*\(", "Select specific fields", "database"),
    (r"\.sort\s*\(", "Sort query results", "database"),
    (r"\.limit\s*\(", "Limit query results", "database"),
    (r"\.skip\s*\(", "Skip documents (pagination)", "database"),
    (r"\.countDocuments\s*\(", "Count documents", "database"),
    (r"redis\.(?:get|set|del|hget|hset|lpush|rpush)\s*\(", "Redis operation", "database"),
    (r"\.query\s*\(", "SQL query execution", "database"),
    (r"\.execute\s*\(", "Execute query", "database"),
    (r"prisma\.\w+\.(?:findMany|findUnique|create|update|delete|upsert)\s*\(", "Prisma database operation", "database"),
    (r"sequelize\.(?:define|query|sync)\s*\(", "Sequelize database operation", "database"),
)


def operations(files: DataFrame, most: int = 100) -> DataFrame:
    """project_id, step, phase, description, file, line: the first database operations in order of file, pattern and line."""
    rows = content_lines(files).where(F.col("text").rlike("|".join(p for p, _, _ in OPERATIONS)))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_count("text", F.lit(p)).alias("n"), F.lit(d).alias("description"), F.lit(ph).alias("phase")) for k, (p, d, ph) in enumerate(OPERATIONS)])
    hit = rows.select(P, F.col("file_path").alias("file"), "line", F.explode(F.filter(each, lambda s: s["n"] > 0)).alias("o")).select(P, "file", "line", "o.k", "o.description", "o.phase", F.explode(F.sequence(F.lit(1), F.col("o.n"))).alias("i"))
    w = Window.partitionBy(P).orderBy("file", "k", "line", "i")
    return hit.withColumn("step", F.row_number().over(w)).where(F.col("step") <= most).drop("k", "i")


#: Own patterns of variables: a line of an .env file, process.env by name and by key, a read of the configuration.
ENV_LINE = r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*="
ENV_NAME, ENV_KEY, ENV_READ = r"\bprocess\.env\.([A-Za-z_]\w*)", r"\bprocess\.env\[\s*['\"]([^'\"]+)['\"]\s*\]", r"\bconfig\.get\(\s*['\"]([\w.]+)['\"]"


def environment(files: DataFrame) -> DataFrame:
    """project_id, name, value (masked), source, detected: variables of .env files, process.env and configuration reads, the first of each name."""
    all_of = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    named = lambda names, k, value, how: F.transform(names, lambda n, i: F.struct(F.lit(k).alias("k"), i.alias("i"), n.alias("name"), F.lit(value).alias("value"), F.lit(how).alias("detected")))
    lines = F.when(X.basename("file_path").startswith(".env"), all_of(ENV_LINE)).otherwise(F.array().cast("array<string>"))
    every = F.concat(named(lines, 0, "***masked***", "file"), named(F.concat(all_of(ENV_NAME), all_of(ENV_KEY)), 1, "***referenced***", "reference"), named(all_of(ENV_READ), 2, "***referenced***", "reference"))
    found = files.where(F.col("content").isNotNull()).select(P, F.col("file_path").alias("source"), F.explode(every).alias("v_")).select(P, "source", "v_.*")
    return first_wins(found, [P, "name"], ["source", "k", "i"]).select(P, "name", "value", "source", "detected")


#: Own patterns of middleware: what is mounted (path of either quotes, name), handlers of three arguments that pass on, hooks of requests, listed classes.
MOUNTED = r"\b(?:app|router|server)\.use\(\s*(?:'([^']*)'\s*,\s*|\"([^\"]*)\"\s*,\s*)?([A-Za-z_$][\w$.]*)"
HANDLER = r"\b(?:function\s+|const\s+)([A-Za-z_$][\w$]*)\s*(?:=\s*(?:async\s*)?)?\(\s*(?:req|request)\w*\s*,\s*(?:res|response)\w*\s*,\s*next\b"
REQUEST_HOOK, LISTED_CLASS = r"@\w+\.((?:before|after|teardown)_request)\b", r"['\"][\w.]*\bmiddleware\.([A-Z]\w*)['\"]"


def middleware(files: DataFrame) -> DataFrame:
    """project_id, type, name, path, file."""
    got = lambda p, g: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    path = lambda x: F.when(x["a"] != "", x["a"]).when(x["b"] != "", x["b"]).otherwise("/")
    mounted = F.transform(F.arrays_zip(got(MOUNTED, 3).alias("n"), got(MOUNTED, 1).alias("a"), got(MOUNTED, 2).alias("b")), lambda x: F.struct(F.lit("express_middleware").alias("type"), x["n"].alias("name"), path(x).alias("path")))
    plain = lambda kind, p: F.transform(got(p, 1), lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name"), F.lit(None).cast("string").alias("path")))
    every = F.concat(mounted, plain("middleware_function", HANDLER), plain("flask_middleware", REQUEST_HOOK), plain("django_middleware", LISTED_CLASS))
    return files.where(F.col("content").isNotNull()).select(P, F.explode(every).alias("m_"), F.col("file_path").alias("file")).select(P, "m_.type", "m_.name", "m_.path", "file")


#: What a content shows of each mechanism, of guards, and of a password policy.
AUTH_MARKS = {
    "jwt": ("jwt.sign", "jwt.verify", "jsonwebtoken"), "passport": ("passport",), "bcrypt": ("bcrypt.hash", "bcrypt.compare"), "session": ("express-session", "session(", "cookie-session"), "api_keys": ("apiKey", "api_key", "X-API-Key"),
}
GUARD_MARKS = ("authenticate", "authorize", "isAuthenticated", "isAuthorized")
POLICY_MARKS = ("uppercase", "lowercase", "minLength", "minlength")
#: Own patterns: how long a token lives, rounds of a hash, functions that guard, files about it, the least length of a password.
TOKEN_LIFE, HASH_ROUNDS = r"\bexpiresIn['\"]?\s*:\s*['\"]([^'\"]+)", r"\bbcrypt\.\w+\([^;]*?\b(\d+)\s*\)"
GUARD_NAME, AUTH_FILE, LEAST_LENGTH = r"\b(?:const|function)\s+(\w*(?i:auth|verif|protect)\w*)", "auth|passport", r"(?i)\bmin(?:imum)?_?(?:length)?['\"]?\s*[:=(]\s*(\d+)"


def authentication(files: DataFrame) -> DataFrame:
    """One row a project: mechanism flags, token expiry, hash rounds, middleware names, files, and the last file's password policy."""
    c = F.coalesce("content", F.lit(""))
    any_of = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(c, x))
    first = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    policy = F.struct(first(LEAST_LENGTH).try_cast("int").alias("min_length"), *[any_of(xs).alias(n) for n, xs in (("uppercase", ("uppercase",)), ("lowercase", ("lowercase",)), ("digit", ("digit", "number")), ("special", ("special", "symbol")))])
    marks = {n: any_of(xs) for n, xs in AUTH_MARKS.items()}
    own = files.select(P, "file_path", *[m.alias(n) for n, m in marks.items()], F.when(marks["jwt"], first(TOKEN_LIFE)).alias("expiry"), first(HASH_ROUNDS).try_cast("int").alias("rounds"), F.when(any_of(GUARD_MARKS), F.regexp_extract_all(c, F.lit(GUARD_NAME), F.lit(1))).alias("guards"),
                       F.when(F.col("file_path").rlike(AUTH_FILE), F.col("file_path")).alias("auth_file"), F.when(F.contains(c, F.lit("password")) & any_of(POLICY_MARKS), policy).alias("policy"))
    of_file = lambda name, pick: pick(name, F.when(F.col(name).isNotNull(), F.col("file_path")))
    return own.groupBy(P).agg(*[F.max(n).alias(n) for n in AUTH_MARKS], F.max("passport").alias("oauth"), of_file("expiry", F.min_by).alias("jwt_expiry"), of_file("rounds", F.max_by).alias("bcrypt_rounds"),
                              F.array_sort(F.array_distinct(F.flatten(F.collect_list("guards")))).alias("middleware"), F.array_sort(F.collect_set("auth_file")).alias("files"), of_file("policy", F.max_by).alias("password_policy"))


def route_summary(routes: DataFrame, sample: int = 10) -> DataFrame:
    """project_id, n_routes, methods (distinct, sorted), key_routes (the first, in order of file and line)."""
    w = Window.partitionBy(P).orderBy("file", "line", "method", "path")
    own = routes.withColumn("n_", F.row_number().over(w)).withColumn("text_", F.concat_ws(" ", "method", "path"))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("n_") <= sample, F.struct("n_", "text_")))), lambda s: s["text_"])
    return own.groupBy(P).agg(F.count("*").alias("n_routes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("method", ","))))).alias("methods"), first.alias("key_routes"))


def by_path(files: DataFrame, symbols: DataFrame, words: tuple[str, ...], exported_only: bool = False) -> DataFrame:
    """Files whose path has one of the words, with their functions: controllers, services, models."""
    own = files.where(F.greatest(*[F.contains("file_path", F.lit(w)) for w in words], F.lit(False))).select(P, "file_path", F.regexp_replace(X.basename("file_path"), r"(.)\.[^.]*$", "$1").alias("name"))
    fns = symbols.where(F.col("kind").isin("function", "arrow_function") & (F.col("exported") | F.lit(not exported_only)))
    got = fns.groupBy(P, "file_path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "is_async", "exported"))).alias("functions"))
    return own.join(got, [P, "file_path"], "left").withColumn("total_functions", F.coalesce(F.size("functions"), F.lit(0)))


def mongoose_models(files: DataFrame) -> DataFrame:
    """project_id, file_path, schema_name, model, collection, field, type, ref, required, unique: a row a field of every schema.

    Options of a field are told from fields by splitting at the top level only."""
    kind = files.schema[P].dataType.simpleString()
    import re

    options = {"type", "ref", "required", "unique", "default", "enum", "index", "trim", "lowercase", "min", "max", "minlength", "maxlength", "match", "select", "validate"}

    def fields(body: str) -> Iterator[tuple]:
        for part in split_depth0(body):
            m = re.match(r"['\"]?(\w+)['\"]?\s*:\s*(.+)", re.sub(r"^(?:\s*//[^\n]*\n)+", "", part).strip(), re.DOTALL)
            if not m or m[1] in options:
                continue
            value = m[2].strip()
            ref, typ = re.search(r"ref\s*:\s*['\"](\w+)['\"]", value), re.search(r"type\s*:\s*([\w.\[\]]+)", value)
            name = "Array" if value.startswith("[") else typ[1].split(".")[-1] if typ else value.split(".")[-1].split(",")[0].strip("{} ") or "Mixed"
            yield m[1], name, ref[1] if ref else None, bool(re.search(r"required\s*:\s*(?:true|\[\s*true)", value)), bool(re.search(r"unique\s*:\s*true", value))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, path, s in batch.itertuples(index=False):
                models = {m[2]: m[1] for m in re.finditer(r"\.?\bmodel\s*(?:<\w+>)?\(\s*['\"](\w+)['\"]\s*,\s*(\w+)", s or "")}
                for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(?:mongoose\s*\.\s*)?Schema\s*\(\s*\{", s or ""):
                    at = m.end() - 1
                    end = closing_brace(s, at)
                    if end > 0:
                        model = models.get(m[1])
                        name = model or re.sub(r"[sS]chema$", "", m[1])
                        rows += [(p, path, m[1], name, model.lower() + "s" if model else None, *f) for f in fields(s[at + 1:end])]
            yield pd.DataFrame(rows, columns=[P, "file_path", "schema_name", "model", "collection", "field", "type", "ref", "required", "unique"])

    return files.select(P, "file_path", "content").mapInPandas(run, f"{P} {kind}, file_path string, schema_name string, model string, collection string, field string, type string, ref string, required boolean, unique boolean")


#: Development tools among libraries.
DEV_TOOLS = ("vite", "webpack", "eslint", "prettier", "jest", "vitest", "mocha", "cypress", "playwright", "tailwindcss", "postcss", "autoprefixer", "@vitejs/plugin-react", "typescript")


def library_usage(rows: DataFrame, name: str, file: str, specifier: str, dev_tools: tuple[str, ...] = DEV_TOOLS) -> DataFrame:
    """name, usage_count, n_files, n_specifiers, is_dev of every library."""
    once = rows.groupBy(F.col(name).alias("name"), file, specifier).agg(F.count("*").alias("n_"))  # one row a file before distinct counts expand them
    return once.groupBy("name").agg(F.sum("n_").alias("usage_count"), F.count_distinct(file).alias("n_files"), F.count_distinct(specifier).alias("n_specifiers")).withColumn("is_dev", F.col("name").isin(*dev_tools))


def external_libraries(imports: DataFrame) -> DataFrame:
    """Per project: packages with usage, files and specifiers, most used first."""
    own = imports.withColumn("name", X.package_key("source")).where(F.col("name").isNotNull() & ~F.col("name").isin("node", "npm", "yarn", "pnpm"))
    sets = own.groupBy(P, "name").agg(F.count("*").alias("usage_count"), F.array_sort(F.collect_set("from_file")).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("specifiers", F.array().cast("array<string>")))))).alias("specifiers"))
    return sets.withColumn("is_dev", F.col("name").isin(*DEV_TOOLS)).orderBy(P, F.desc("usage_count"), "name")
