"""Pattern checks over lines and files: security and performance findings with severities."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X


class Check(NamedTuple):
    check_id: str
    severity: str
    pattern: str


#: Our own patterns for the sixteen kinds of weakness.
SECURITY = (
    Check("hardcoded_secret", "critical", r"(?i)\b(?:password|passwd|secret|api_?key|token)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]"), Check("aws_key", "critical", r"\bAKIA[0-9A-Z]{16}\b"), Check("private_key", "critical", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"),
    Check("sql_concatenation", "critical", r"(?i)['\"`](?:select|insert|update|delete)\b[^'\"`]*['\"`]\s*\+"), Check("eval", "high", r"\beval\s*\("), Check("new_function", "high", r"\bnew Function\s*\("), Check("shell_exec", "high", r"\b(?:exec|execSync|os\.system)\s*\([^)]*[+$]"),
    Check("inner_html", "high", r"\.innerHTML\s*=|dangerouslySetInnerHTML"), Check("open_cors", "medium", r"(?i)access-control-allow-origin['\"]?\s*[:,]\s*['\"]\*|cors\(\s*\)"), Check("weak_hash", "medium", r"(?i)createHash\(\s*['\"](?:md5|sha1)['\"]|hashlib\.(?:md5|sha1)\("),
    Check("weak_random", "low", r"\bMath\.random\(\)"), Check("http_url", "low", r"['\"]http://(?!localhost|127\.)"), Check("disabled_tls", "high", r"rejectUnauthorized\s*:\s*false|verify\s*=\s*False"), Check("jwt_none", "critical", r"(?i)algorithms?\s*[:=]\s*\[?\s*['\"]none['\"]"),
    Check("insecure_cookie", "medium", r"(?i)httpOnly\s*:\s*false|secure\s*:\s*false"), Check("debug_enabled", "low", r"(?i)\bdebug\s*=\s*true\b"),
)
#: Our own patterns for slow code; graph and size checks are below.
PERFORMANCE = (
    Check("sync_call", "medium", r"\b(?:readFileSync|writeFileSync|execSync)\s*\("), Check("unbounded_find", "medium", r"\.find\(\s*(?:\{\s*\})?\s*\)(?!\s*\.limit)"), Check("await_in_loop", "medium", r"for\s*\([^)]*\)\s*\{?[^}]*\bawait\b"),
    Check("console_log", "low", r"\bconsole\.log\s*\("), Check("select_star", "low", r"(?i)select\s+\*\s+from"), Check("deep_clone", "low", r"JSON\.parse\(\s*JSON\.stringify"), Check("regex_in_loop", "low", r"for\s*\([^)]*\)[^\n]*new RegExp"),
)
#: Severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low")


def scan(files: DataFrame, *keys_and_checks) -> DataFrame:
    """files (keys, content): keys, check_id, severity, n for every check with a match. All patterns in one pass of the contents."""
    *keys, checks = keys_and_checks
    each = F.array(*[F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), X.count_matches("content", c.pattern).alias("n")) for c in checks])
    return files.select(*keys, F.explode(F.filter(each, lambda s: s["n"] > 0)).alias("f_")).select(*keys, "f_.check_id", "f_.severity", "f_.n")


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings and files of each severity, with its position."""
    position = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    return findings.groupBy(*keys, "severity").agg(F.first(position).alias("position"), F.sum("n").cast("long").alias("n_issues"), F.count("*").alias("n_files"))


def large_functions(chunks: DataFrame, most_lines: int = 50) -> DataFrame:
    return chunks.where(F.col("function_name").isNotNull() & (F.col("end_line") - F.col("start_line") + 1 > most_lines)).select("project_id", "file_path", "function_name", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


def nested_loops(files: DataFrame, depth: int = 2) -> DataFrame:
    """Files with a loop inside a loop, by indentation of the lines that open one."""
    opens = F.filter(X.lines("content"), lambda s: s.rlike(r"^\s*(?:for|while)\b"))
    indents = F.transform(opens, lambda s: F.length(F.regexp_extract(s, r"^(\s*)", 1)))
    nested = F.size(F.filter(F.zip_with(indents, F.slice(F.concat(indents, F.array(F.lit(-1))), F.lit(2), F.greatest(F.size(indents), F.lit(1))), lambda a, b: b > a), lambda x: x))
    return files.select("project_id", "file_path", nested.alias("n_nested")).where(F.col("n_nested") >= depth - 1)


def unused_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Names that an import binds and no line but its own says."""
    own = imports.select("project_id", F.col("from_file").alias("file_path"), "line", F.explode("specifiers").alias("name")).where("name not in ('*', '')")
    both = own.join(files.select("project_id", "file_path", "content"), ["project_id", "file_path"])
    rest = F.array_join(F.filter(X.lines("content"), lambda _, i: i + 1 != F.col("line")), "\n")
    return both.where(~F.array_contains(F.split(rest, r"[^\w$]+"), F.col("name"))).select("project_id", "file_path", "line", "name")


def similar_functions(chunks: DataFrame, least: float = 0.8, size: int = 3) -> DataFrame:
    """Pairs of functions of a project whose word shingles have a Jaccard similarity of at least ``least``, found by MinHash and
    verified exactly; a project's functions are compared within their hash buckets only."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    words = F.filter(F.split("content", r"\W+"), lambda w: w != "")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))
    own = chunks.where("function_name is not null").select("project_id", F.concat_ws(":", "file_path", "start_line", "end_line").alias("id"), shingles.alias("s")).where(F.size("s") > 0)
    vectors = HashingTF(inputCol="s", outputCol="v", numFeatures=1 << 18, binary=True).transform(own)
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=8, seed=7).fit(vectors)
    near = model.approxSimilarityJoin(vectors, vectors, 1 - least + 1e-9, "d").where("datasetA.project_id = datasetB.project_id and datasetA.id < datasetB.id")
    a, b = F.col("datasetA.s"), F.col("datasetB.s")
    exact = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return near.select(F.col("datasetA.project_id").alias("project_id"), F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), exact.alias("similarity")).where(F.col("similarity") >= least)
