"""Project metrics over file rows: totals, complexity, comments, maintainability, dimension scores, vector quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.vectors import is_zero

#: What counts as an error handler, and as a decision point.
ERROR_HANDLER = r"\.catch\s*\(|try\s*\{|errorHandler|error\.message|next\(err\)|res\.status\(\d{3}\)|throw\s+(?:new\s+)?\w+"
DECISION = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])"


def totals(files: DataFrame, key: str) -> DataFrame:
    """files (key, language, content, n_bytes, loc): counts, lines, code lines, size and known languages by key."""
    return files.groupBy(key).agg(
        F.count("*").alias("total_files"), F.sum(F.size(X.lines("content"))).cast("long").alias("total_lines"), F.sum("loc").cast("long").alias("total_loc"),
        X.round_half_up(F.sum("n_bytes") / 1024.0, 2).alias("total_size_kb"), F.count_distinct(F.when(F.col("language") != "Unknown", F.col("language"))).alias("n_languages"),
        F.sum(X.estimate_tokens("content")).cast("long").alias("token_estimate"))


def symbol_counts(symbols: DataFrame, key: str) -> DataFrame:
    """symbols (key, kind, is_async): counts by kind in one pass."""
    return symbols.groupBy(key).agg(
        F.count("*").alias("total_symbols"), F.count_if(F.col("kind").isin("function", "arrow_function")).alias("function_count"), F.count_if(F.col("kind") == "class").alias("class_count"),
        F.count_if(F.col("kind") == "component").alias("component_count"), F.count_if(F.coalesce("is_async", F.lit(False))).alias("async_count"))


def complexity(files: DataFrame, key: str) -> DataFrame:
    """files (key, n_symbols, n_imports): mean (2 places) and largest of symbols plus imports per file."""
    cc = F.col("n_symbols") + F.col("n_imports")
    return files.groupBy(key).agg(X.round_half_up(F.avg(cc), 2).alias("avg_cc"), F.max(cc).alias("max_cc"))


def comment_percent(lines: Column, loc: Column) -> Column:
    """Share of lines that are not code, blank ones included, in percent with one place."""
    return F.when(lines > 0, F.floor((lines - loc) / lines * 1000.0 + 0.5).cast("double") / 10.0).otherwise(0.0)


def comment_percent_strict(lines: Column, loc: Column, blank: Column) -> Column:
    return comment_percent(lines, loc + blank)


def maintainability(avg_cc: Column, loc: Column, files: Column, comment: Column) -> Column:
    return F.when(loc > 0, X.round_half_up(X.clamp(100.0 - avg_cc * 3.0 - loc / files / 50.0 + comment * 0.3, F.lit(0.0), F.lit(100.0)), 2)).otherwise(100.0)


def decision_complexity(content: Column | str) -> Column:
    return X.count_matches(content, DECISION) + 1


def decision_class(cc: Column) -> Column:
    """Low to 5, moderate to 10, high to 20, very high to 50, else extreme."""
    return F.when(cc <= 5, "low").when(cc <= 10, "moderate").when(cc <= 20, "high").when(cc <= 50, "very high").otherwise("extreme")


def halstead_maintainability(volume: Column, cc: Column, loc: Column) -> Column:
    return 171.0 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * cc - 16.2 * F.log(F.greatest(loc, F.lit(1.0)))


def halstead_volume(content: Column | str) -> Column:
    """Number of tokens times the bits of the number of different ones."""
    tokens = F.regexp_extract_all(X.col(content), F.lit(r"(\w+|[^\s\w])"), F.lit(1))
    return F.size(tokens) * F.log2(F.greatest(F.size(F.array_distinct(tokens)), F.lit(1)).cast("double"))


def dimension_scores(m: DataFrame) -> DataFrame:
    """Adds the five scores, each 1 to 10, to rows of total_loc, file_count, avg_cc, max_cc, folder_depth, dep_chain_length,
    circular_dep_count, route_count, async_count, class_count, maintainability, comment_percent."""
    c = {x: F.col(x).cast("double") for x in m.columns}
    score = lambda x: F.bround(F.least(F.lit(10.0), F.greatest(F.lit(1.0), x)), 1)
    return m.withColumns({
        "size_score": score(c["total_loc"] / 1000 * 0.5 + c["file_count"] / 50 * 2.5),
        "complexity_score": score(c["avg_cc"] * 0.5 + c["max_cc"] * 0.1),
        "architecture_score": score(c["folder_depth"] * 0.8 + c["dep_chain_length"] * 0.3 + c["circular_dep_count"] * 0.4),
        "surface_score": score(c["route_count"] / 40 * 2 + c["async_count"] / 80 * 2 + c["class_count"] / 20 * 2),
        "quality_score": score((100 - c["maintainability"]) * 0.08 + F.greatest(F.lit(0.0), 30 - c["comment_percent"]) * 0.05),
    })


def vector_quality(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: share of zero vectors, with a warning above 20 and an error above 50 percent."""
    share = F.coalesce(F.avg(is_zero(column).cast("double")) * 100.0, F.lit(0.0))
    got = vectors.agg(F.count("*").alias("n_vectors"), F.coalesce(F.count_if(is_zero(column)), F.lit(0)).alias("n_zero"), share.alias("zero_percent"))
    return got.withColumn("status", F.when(F.col("zero_percent") > 50, "error").when(F.col("zero_percent") > 20, "warning").otherwise("ok"))


def folder_depth(paths: DataFrame, key: str, path: str = "file_path") -> DataFrame:
    """Deepest folder and number of folders by key."""
    parts = F.split(F.col(path), "/")
    own = paths.select(key, F.greatest(F.size(parts) - 1, F.lit(0)).alias("depth"), F.explode_outer(F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("folder"))
    return own.groupBy(key).agg(F.max("depth").alias("max_depth"), F.count_distinct("folder").alias("n_folders"))


def dashboard(projects: DataFrame, completed: Column, size: str, project: str, technology: str) -> DataFrame:
    """One row over all: completed ones, their size, projects and technologies."""
    return projects.agg(F.count_if(F.coalesce(completed, F.lit(False))).alias("completed"), F.sum(size).alias("total_size"), F.count_distinct(project).alias("n_projects"), F.count_distinct(technology).alias("n_technologies"))


def difficulty_overview(scores: DataFrame, level: str = "level", score: str = "score") -> DataFrame:
    """Projects and mean score (one place) of each level."""
    return scores.groupBy(level).agg(F.count("*").alias("n_projects"), X.round_half_up(F.avg(score), 1).alias("avg_score"))
