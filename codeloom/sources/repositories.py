"""Repositories as file tables: landed directories, ZIP archives, repository addresses, remote listings, landed web pages.

Spark's file sources leave out names that begin with '_' or '.', which are the configuration and test files that detection needs; so paths
are listed by tasks, one root each, filtered by name, and only what survives is read.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X

#: Directories that are left out, files that are, and extensions of binary files.
IGNORED_DIRS = ("node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", "__pycache__", ".pytest_cache", ".mypy_cache", ".next", ".nuxt", "coverage", ".nyc_output", "vendor", "bower_components", ".idea", ".vscode", ".vs")
IGNORED_FILES = r"^\.DS_Store$|^Thumbs\.db$|\.min\.js$|\.bundle\.js$|\.chunk\.js$|-lock\.json$|\.lock$"
BINARY = (".jpg", ".jpeg", ".png", ".gif", ".ico", ".svg", ".bmp", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".wav", ".webm", ".ogg", ".avi", ".mov", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
          ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz", ".exe", ".dll", ".so", ".dylib", ".o", ".obj", ".class", ".pyc", ".pyo", ".wasm", ".db", ".sqlite", ".sqlite3", ".map")
#: Languages by extension.
LANGUAGES = {
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript (React)", ".ts": "TypeScript", ".tsx": "TypeScript (React)", ".py": "Python", ".java": "Java", ".go": "Go", ".rs": "Rust", ".rb": "Ruby",
    ".php": "PHP", ".cs": "C#", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".r": "R", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".yaml": "YAML", ".yml": "YAML",
    ".json": "JSON", ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".less": "Less", ".md": "Markdown", ".graphql": "GraphQL", ".proto": "Protobuf", ".toml": "TOML", ".env": "Environment",
    ".dockerfile": "Dockerfile", ".prisma": "Prisma",
}
FILE = "file_path string, content string, n_bytes long"


def ignored_path(path: Column | str) -> Column:
    """Any directory of the path is ignored, or the name is."""
    p = X.col(path)
    dirs = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS))) | X.basename(p).rlike(IGNORED_FILES)


def is_binary_name(path: Column | str) -> Column:
    return F.lower(X.extname(path)).isin(*BINARY)


def is_binary_content(data: Column | str) -> Column:
    """A zero byte among the first 8192."""
    head = F.hex(F.substring(X.col(data), 1, 8192))
    return head.rlike("^(?:..)*?00")


def language_of(path: Column | str) -> Column:
    base, known = F.lower(X.basename(path)), F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(X.extname(path))), F.when(base == "dockerfile", "Dockerfile").when(base == "makefile", "Makefile").when(base == ".gitignore", "Git Config").when(base.startswith(".env"), "Environment"), F.lit("Unknown"))


def described(files: DataFrame) -> DataFrame:
    """Adds language, size_kb, loc and lines to rows of file_path, content, n_bytes."""
    return files.withColumn("language", language_of("file_path")).withColumn("size_kb", X.size_kb("n_bytes")).withColumn("loc", X.code_lines("content")).withColumn("lines", F.size(X.lines("content")))


def _wanted(path: str) -> bool:
    import re

    *dirs, name = path.split("/")
    ext = os.path.splitext(name)[1].lower()
    return not any(d in IGNORED_DIRS for d in dirs) and not re.search(IGNORED_FILES, name) and ext not in BINARY


def _text(data: bytes) -> str | None:
    return None if b"\0" in data[:8192] else data.decode("utf-8", "replace")


def read_directories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """roots (project_id to a directory that executors see): text files of every project, without ignored and binary ones."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, root in zip(batch.project_id, batch.root, strict=True):
                rows = []
                for at, dirs, names in os.walk(root):
                    dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS)
                    for n in sorted(names):
                        rel = os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/")
                        if _wanted(rel):
                            rows.append((project, root, rel))
                yield pd.DataFrame(rows, columns=["project_id", "root", "file_path"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, root, rel in batch.itertuples(index=False):
                with open(os.path.join(root, rel), "rb") as f:
                    data = f.read()
                rows.append((project, rel, _text(data), len(data)))
            yield pd.DataFrame(rows, columns=["project_id", "file_path", "content", "n_bytes"])

    start = spark.createDataFrame(list(roots.items()), "project_id string, root string").repartition(max(1, len(roots)))
    paths = start.mapInPandas(walk, "project_id string, root string, file_path string").repartition("file_path")
    return described(paths.mapInPandas(read, f"project_id string, {FILE}").where("content is not null"))


def read_zips(archives: DataFrame) -> DataFrame:
    """archives (project_id, content binary), such as binaryFile rows: their text files; a single top folder is taken off, members that leave the archive are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, data in zip(batch.project_id, batch.content, strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [i for i in z.infolist() if not i.is_dir()]
                    tops = {i.filename.split("/")[0] for i in names}
                    cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in i.filename for i in names) else 0
                    for i in names:
                        rel = i.filename[cut:]
                        if rel.startswith("/") or ".." in rel.split("/") or not _wanted(rel):
                            continue
                        raw = z.read(i)
                        rows.append((project, rel, _text(raw), len(raw)))
                yield pd.DataFrame(rows, columns=["project_id", "file_path", "content", "n_bytes"])

    kind = archives.schema["project_id"].dataType.simpleString()
    return described(archives.select("project_id", "content").mapInPandas(run, f"project_id {kind}, {FILE}").where("content is not null"))


def count_files(spark: SparkSession, roots: dict[str, str], ignored: tuple[str, ...] = ("node_modules", ".git", "dist", "build", "__pycache__", ".next", "coverage")) -> DataFrame:
    """project_id, n_files of every kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, root in batch.itertuples(index=False):
                n = 0
                for _, dirs, names in os.walk(root):
                    dirs[:] = [d for d in dirs if d not in ignored]
                    n += len(names)
                rows.append((project, n))
            yield pd.DataFrame(rows, columns=["project_id", "n_files"])

    return spark.createDataFrame(list(roots.items()), "project_id string, root string").mapInPandas(run, "project_id string, n_files long")


def explainable(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_path", "language", "loc").orderBy("project_id", "file_path")


def archive_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(F.count("*").alias("file_count"), X.round_half_up(F.sum("n_bytes") / 1024.0, 2).alias("total_size_kb"), F.sum("loc").cast("long").alias("total_loc"))


# -- addresses and listings ------------------------------------------------------------------------------------------

def parse_repo_url(url: Column | str) -> Column:
    """provider, owner, repo, clone_url of an https or ssh address; null parts where it has none."""
    u = F.regexp_replace(X.trim_space(url), r"[;&|`$(){}<>\\]", "")
    pattern = r"^(?:https?://(?:www\.)?|git@|ssh://git@)([^/:]+)[/:]([^/\s]+)/([^/\s?#]+?)(?:\.git)?/?(?:[?#/].*)?$"
    part = lambda k: F.nullif(F.regexp_extract(u, pattern, k), F.lit(""))
    host = F.lower(part(1))
    provider = F.when(host.contains("github"), "github").when(host.contains("gitlab"), "gitlab").when(host.contains("bitbucket"), "bitbucket").otherwise("other")
    return F.struct(provider.alias("provider"), part(2).alias("owner"), part(3).alias("repo"), F.when(part(3).isNotNull(), F.concat(F.lit("https://"), host, F.lit("/"), part(2), F.lit("/"), part(3), F.lit(".git"))).alias("clone_url"))


REMOTE = "id long, name string, full_name string, private boolean, description string, language string, stargazers_count long, default_branch string, updated_at string, clone_url string, owner struct<login:string>"


def repository_listing(pages: DataFrame, body: str = "body") -> DataFrame:
    """Landed pages of a provider's listing (JSON arrays) as one row a repository."""
    r = pages.select(F.explode(F.from_json(body, f"array<struct<{_struct(REMOTE)}>>")).alias("r"))
    return r.select("r.id", "r.name", "r.full_name", "r.private", "r.description", "r.language", F.col("r.stargazers_count").alias("stars"), "r.default_branch", "r.updated_at", "r.clone_url")


def _struct(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in ddl.split(", ")))


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, vector of both cache formats, lines of {key, vector, ts} and of {vectors: {key: vector}, ts}; the latest wins."""
    raw = spark.read.schema("key string, vector array<double>, vectors map<string,array<double>>, ts long").json(path)
    one = raw.where("key is not null").select(F.col("key").alias("cache_key"), "vector", "ts")
    many = raw.where("vectors is not null").select(F.explode("vectors").alias("cache_key", "vector"), "ts")
    return one.unionByName(many).groupBy("cache_key").agg(F.max_by("vector", F.coalesce("ts", F.lit(0))).alias("vector"))


def scrape_targets(names: DataFrame, per_name: int = 3, batch: int = 5) -> DataFrame:
    """names (technology, rank and more): the first of each technology, with the batch in which they are fetched, ``batch`` technologies in each."""
    from codeloom.operators.relational import first_n

    kept = first_n(names, ["technology"], ["rank"], per_name)
    # places without one sort of all: within buckets of hashes, after the sizes of the buckets before
    each = names.select("technology").distinct().withColumn("bucket_", F.pmod(F.xxhash64("technology"), F.lit(64)))
    before = each.groupBy("bucket_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).drop("n_")
    place = F.row_number().over(Window.partitionBy("bucket_").orderBy("technology")) - 1
    order = each.withColumn("place_", place).join(F.broadcast(before), "bucket_").select("technology", F.floor((F.col("before_") + F.col("place_")) / F.lit(batch)).alias("batch"))
    return kept.join(order, "technology")


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the title and the number of links of their html."""
    return pages.withColumn("title", F.regexp_extract(html, "<title>([^<]*)</title>", 1)).withColumn("n_links", F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))))
