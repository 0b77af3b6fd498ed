"""Contexts of reports: what is known of a project as sections of lines, each context with its sections, caps and priorities under one token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X

P = "project_id"
CRUD = ("GET", "POST", "PUT", "PATCH", "DELETE")
#: Parts of a path that make an endpoint one of authentication; fields of a model that are listed.
AUTH_PATHS, FIELDS = ("auth", "login", "register", "oauth"), 15
#: Facts of a project and what a context calls them.
METRICS = {
    "file_count": "Files", "total_loc": "Code lines", "total_lines": "Lines", "total_symbols": "Symbols", "total_funcs": "Functions", "class_count": "Classes", "avg_cc": "Mean complexity", "max_cc": "Largest complexity",
    "comment_percent": "Comment percent", "maintainability": "Maintainability", "async_count": "Async functions", "error_handler_count": "Error handlers", "route_count": "Routes", "folder_depth": "Folder depth", "circular_dep_count": "Cycles",
}
#: Sections of each context in the order shown: section, title, most lines, priority (1 goes last when the budget is short).
CONTEXTS = {
    "full": (("metrics", "Project Metrics", 40, 1), ("technologies", "Technologies", 20, 2), ("layers", "Architecture Layers", 20, 3), ("endpoints", "API Endpoints", 50, 4), ("models", "Database Models", 40, 5), ("relations", "Database Relationships", 40, 6),
             ("authentication", "Authentication", 10, 7), ("dependencies", "Dependencies", 10, 8), ("libraries", "External Libraries", 30, 9), ("middleware", "Middleware", 15, 10), ("environment", "Environment Variables", 20, 11)),
    "light": (("scope", "Scope", 5, 1), ("technologies", "Technologies", 20, 2), ("layers", "Architecture Layers", 20, 3), ("plain_endpoints", "Key Routes", 8, 5), ("model_names", "Database Models", 40, 4), ("authentication", "Authentication", 10, 6)),
    "auth": (("technologies", "Technologies", 20, 3), ("authentication", "Authentication", 10, 1), ("auth_files", "Auth Files", 20, 2), ("auth_endpoints", "Auth Endpoints", 50, 4)),
    "database": (("technologies", "Technologies", 20, 4), ("models", "Database Models", 40, 1), ("relations", "Database Relationships", 40, 2), ("crud_endpoints", "API Endpoints", 20, 3)),
}


def section(rows: DataFrame, name: str, line: Column, *order: Column | str) -> DataFrame:
    """project_id, section, place, line of a table: a line a row, ``order`` (any values) decides which come first. A null line is none."""
    place = F.array(*[X.col(c).cast("string") for c in order]) if order else F.array(F.lit(""))
    return rows.select(P, F.lit(name).alias("section"), place.alias("place"), line.alias("line")).where("line is not null")


def _facts(rows: DataFrame, name: str, said: list[Column]) -> DataFrame:
    """Lines out of one row of a project, null ones left out."""
    own = rows.select(P, F.posexplode(F.array(*said)).alias("n_", "l_"))
    return section(own, name, F.col("l_"), F.lpad(F.col("n_").cast("string"), 3, "0"))


def sections(facts: DataFrame, technologies: DataFrame, layers: DataFrame, routes: DataFrame, fields: DataFrame, relations: DataFrame, authentication: DataFrame, dependencies: DataFrame, libraries: DataFrame, middleware: DataFrame, environment: DataFrame) -> DataFrame:
    """The lines of all sections, from the tables that the detectors, the graph and the metrics give."""
    text, yes = lambda c: X.col(c).cast("string"), lambda c: F.when(F.col(c), "Yes").otherwise("No")
    dash = lambda *x: F.concat(F.lit("- "), *[F.lit(a) if isinstance(a, str) else a for a in x])
    route = dash(F.col("method"), " ", F.col("path"))
    at = ("file", F.lpad(text("line"), 9, "0"))
    plain, lower = ~F.col("path").contains(":"), F.lower("path")
    is_auth = F.exists(F.array(*map(F.lit, AUTH_PATHS)), lambda x: F.contains(lower, x))
    own = fields.withColumn("k_", F.row_number().over(Window.partitionBy(P, "model").orderBy("field", "file_path", "type")))
    shown = F.concat(F.lit("  - "), "field", F.lit(": "), "type", F.coalesce(F.concat(F.lit(" → ref: "), "ref"), F.lit("")), F.when(F.col("required"), " [required]").otherwise(""))
    listed = F.array_sort(F.collect_list(F.when(F.col("k_") <= FIELDS, F.struct("k_", shown.alias("s_")))))
    models = own.groupBy(P, "model").agg(F.count("*").alias("n_"), listed.alias("f_"))
    auth = authentication
    kinds = dependencies.groupBy(P).agg(F.count("*").alias("n_"), F.count_if((F.col("kind") == "local") & F.col("to_file").isNull()).alias("lost_"), F.count_if(F.col("to_file").isNotNull()).alias("local_"))
    out = [
        _facts(facts, "metrics", [dash(label, ": ", text(c)) for c, label in METRICS.items()]),
        _facts(facts, "scope", [dash("Files: ", text("file_count"), " | Code lines: ", text("total_loc"))]),
        section(technologies, "technologies", dash(F.col("category"), ": ", F.array_join("names", ", ")), "category"),
        section(layers, "layers", dash(F.col("layer"), ": ", text("file_count"), " files"), "layer"),
        section(routes, "endpoints", F.concat(route, F.lit(" ("), X.basename("file"), F.lit(")")), *at),
        section(routes.where(plain), "plain_endpoints", route, *at),
        section(routes.where(is_auth), "auth_endpoints", route, *at),
        section(routes.where(F.arrays_overlap(F.split("method", ","), F.array(*map(F.lit, CRUD)))), "crud_endpoints", route, *at),
        section(models, "models", F.concat(dash(F.col("model"), " (", text("n_"), " fields)"), F.lit("\n"), F.array_join(F.transform("f_", lambda x: x["s_"]), "\n")), "model"),
        section(models, "model_names", dash(F.col("model"), ": ", text("n_"), " fields"), "model"),
        section(relations, "relations", dash(F.col("from_model"), " ", F.col("kind"), " → ", F.col("to_model"), " (via ", F.col("field"), ")"), "from_model", "field", "to_model"),
        _facts(auth, "authentication", [dash("JWT: ", yes("jwt")), dash("OAuth: ", yes("oauth")), dash("Passport: ", yes("passport")), dash("bcrypt: ", yes("bcrypt")), dash("JWT expiry: ", F.col("jwt_expiry")), dash("bcrypt rounds: ", text("bcrypt_rounds")),
                                        F.when(F.col("session"), "- Sessions: Yes"), F.when(F.size("middleware") > 0, dash("Middleware: ", F.array_join("middleware", ", ")))]),
        section(auth.select(P, F.explode("files").alias("file_")), "auth_files", dash(F.col("file_")), "file_"),
        _facts(kinds, "dependencies", [dash("Imports: ", text("n_")), dash("Local: ", text("local_")), dash("Unresolved: ", text("lost_"))]),
        section(libraries, "libraries", dash(F.col("name"), F.when(F.col("is_dev"), " [dev]").otherwise(""), ": used ", text("usage_count"), " times in ", text(F.size("files")), " files"), F.lpad((F.lit(10 ** 12) - F.col("usage_count")).cast("string"), 13, "0"), "name"),
        section(middleware, "middleware", dash(F.col("name"), " (", F.col("type"), ") in ", X.basename("file")), "file", "type", "name"),
        section(environment, "environment", dash(F.col("name"), F.when(F.col("detected") == "file", "").otherwise(" [referenced]")), "name", "source"),
    ]
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def report_contexts(lines: DataFrame, budget: int = 3_000, contexts: dict[str, tuple[tuple[str, str, int, int], ...]] = CONTEXTS) -> DataFrame:
    """project_id, context, n_sections, n_dropped, n_tokens, text.

    Of a section the first lines by place are shown, then how many more there are. Sections are taken by priority until the next would pass the budget; from
    there on all are dropped, the least important ones first to go. A section without lines is none; a project whose first section is too large has
    an empty text; a null project is one of its own. No group holds more than the capped lines: the first of a section are found before rows are
    gathered, its size is counted by partial sums.
    """
    spark = lines.sparkSession
    plan = [(c, s, title, most, priority, k) for c, parts in contexts.items() for k, (s, title, most, priority) in enumerate(parts)]
    wanted = F.broadcast(spark.createDataFrame(plan, "context string, section string, title string, most int, priority int, shown int"))
    cap = max(most for _, _, _, most, _, _ in plan)
    n = lines.groupBy(F.col(P).alias("p_"), F.col("section").alias("s_")).agg(F.count("*").alias("n_"))
    first = lines.withColumn("r_", F.row_number().over(Window.partitionBy(P, "section").orderBy("place", "line"))).where(F.col("r_") <= cap).drop("place")
    own = first.groupBy(P, "section").agg(F.array_sort(F.collect_list(F.struct("r_", "line"))).alias("l_"))
    own = own.join(n, own[P].eqNullSafe(n["p_"]) & (own["section"] == n["s_"])).join(wanted, "section")
    more = F.when(F.col("n_") > F.col("most"), F.concat(F.lit("\n  +"), (F.col("n_") - F.col("most")).cast("string"), F.lit(" more"))).otherwise("")
    body = F.concat(F.lit("## "), "title", F.lit("\n"), F.array_join(F.transform(F.slice("l_", F.lit(1), F.col("most")), lambda x: x["line"]), "\n"), more)
    said = own.select(P, "context", "priority", "shown", body.alias("body")).withColumn("t_", X.estimate_tokens("body"))
    said = said.withColumn("sum_", F.sum("t_").over(Window.partitionBy(P, "context").orderBy("priority", "shown")))
    fits = F.col("sum_") <= budget
    parts = F.array_sort(F.collect_list(F.when(fits, F.struct("shown", "body"))))
    return said.groupBy(P, "context").agg(F.count_if(fits).alias("n_sections"), F.count_if(~fits).alias("n_dropped"), F.coalesce(F.sum(F.when(fits, F.col("t_"))), F.lit(0)).cast("long").alias("n_tokens"),
                                          F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("text"))
