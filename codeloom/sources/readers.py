"""Repositories and remote listings as Python data sources: ``spark.read.format("repositories")`` and ``format("repository_listing")`` after ``register``.

Files are opened through pyarrow's file systems, so a path may lie on any of them that executors reach. The driver lists names and sizes only; tasks read.
"""

from __future__ import annotations

import io
import json
import urllib.request
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.sources.repositories import REMOTE, _text, _wanted, described

FILES = "project_id string, file_path string, content string, n_bytes long"
LISTING = REMOTE.replace("stargazers_count long", "stars long").rsplit(", ", 1)[0]
#: Bytes of text that a task holds before it hands them over.
BATCH_BYTES = 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Seekable(io.RawIOBase):
    """A file of pyarrow as zipfile wants it: a place before the beginning is an OSError."""

    def __init__(self, store: fs.FileSystem, path: str):
        self._file = store.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        place = at + (0, self._file.tell(), self._file.size())[whence]
        if place < 0:
            raise OSError("before the beginning")
        return self._file.seek(place)

    def readinto(self, buffer) -> int:
        data = self._file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def close(self) -> None:
        self._file.close()
        super().close()


class Repositories(InputPartition):
    """Archives and directories that one task reads: project, uri."""

    def __init__(self, own: list[tuple[str, str]]):
        self.own = own


def planned(sized: list[tuple[str, str, int]], most: int) -> list[list[tuple[str, str]]]:
    """(project, uri, bytes) dealt into lists in order, each of at least one and then of at most ``most`` bytes; a directory counts as ``most``."""
    out, left = [], 0
    for project, uri, n in sized:
        if not out or n > left:
            out.append([])
            left = most
        out[-1].append((project, uri))
        left -= n
    return out


def members(uri: str) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of each wanted file of a ZIP archive (without a single top folder; members that leave it are refused) or of a directory."""
    store, path = opened(uri)
    if path.endswith(".zip"):
        with io.BufferedReader(_Seekable(store, path), 1 << 20) as f, zipfile.ZipFile(f) as z:
            names = [i for i in z.infolist() if not i.is_dir()]
            tops = {i.filename.split("/")[0] for i in names}
            cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in i.filename for i in names) else 0
            for i in names:
                rel = i.filename[cut:]
                if not rel.startswith("/") and ".." not in rel.split("/") and _wanted(rel):
                    yield rel, z.read(i)
        return
    todo = [path]
    while todo:
        at = todo.pop()
        for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
            rel = info.path[len(path.rstrip("/")) + 1:]
            if info.type == fs.FileType.Directory:
                # a name inside an unwanted folder is never wanted
                if _wanted(f"{rel}/x"):
                    todo.append(info.path)
            elif _wanted(rel):
                with store.open_input_stream(info.path) as f:
                    yield rel, f.read()


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("maxPartitionBytes", 128 << 20))
        self.projects = set(options["projects"].split(",")) if "projects" in options else None

    def partitions(self) -> list[Repositories]:
        store, path = opened(self.path)
        found = sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)
        scheme = self.path.split("://")[0] if "://" in self.path else "file"
        prefix = self.path.split("://")[1].removesuffix(path.lstrip("/").rstrip("/")) if scheme not in ("file", "hdfs") else ""
        sized = []
        for info in found:
            is_dir = info.type == fs.FileType.Directory
            project = info.base_name if is_dir else info.base_name.removesuffix(".zip")
            if (is_dir or info.base_name.endswith(".zip")) and not info.base_name.startswith((".", "_")) and (self.projects is None or project in self.projects):
                uri = f"{self.path.rstrip('/')}/{info.base_name}" if not prefix else f"{scheme}://{prefix}{info.path}"
                sized.append((project, uri, self.most if is_dir else info.size))
        return [Repositories(own) for own in planned(sized, self.most)] or [Repositories([])]

    def read(self, partition: Repositories) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for project, uri in partition.own:
            for rel, data in members(uri):
                held.append((project, rel, _text(data), len(data)))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["project_id", "file_path", "content", "n_bytes"])


class RepositorySource(DataSource):
    """Options: path (a folder of ZIP archives and directories, a project each), projects (names, comma-joined; others are never opened), maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


class Pages(InputPartition):
    """Pages that one task asks for: from, how many (0: until one is short)."""

    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.size, self.of_task = options["url"], int(options.get("perPage", 100)), int(options.get("pagesPerTask", 10))
        self.total = int(options["total"]) if "total" in options else None

    def partitions(self) -> list[Pages]:
        if self.total is None:
            return [Pages(1, 0)]
        pages = -(-self.total // self.size)
        return [Pages(k, min(self.of_task, pages - k + 1)) for k in range(1, pages + 1, self.of_task)] or [Pages(1, 1)]

    def _page(self, number: int) -> list[dict]:
        at = self.url.format(page=number, per_page=self.size)
        if at.startswith(("http://", "https://")):
            with urllib.request.urlopen(at, timeout=30) as f:  # noqa: S310
                return json.load(f)
        store, path = opened(at)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def read(self, partition: Pages) -> Iterator[tuple]:
        number = partition.first
        while not partition.n or number < partition.first + partition.n:
            page = self._page(number)
            for r in page:
                yield (r.get("id"), r.get("name"), r.get("full_name"), r.get("private"), r.get("description"), r.get("language"), r.get("stargazers_count"), r.get("default_branch"), r.get("updated_at"), r.get("clone_url"))
            if len(page) < self.size:
                return
            number += 1


class ListingSource(DataSource):
    """Options: url (with {page} and {per_page}; http or a file system), perPage, total (repositories there are; without it one task asks until a page is short), pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "repository_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (RepositorySource, ListingSource):
        spark.dataSource.register(source)


def read_repositories(spark: SparkSession, path: str, projects: list[str] | None = None, **options: str) -> DataFrame:
    """The text files of all archives and directories below ``path``, with language, size and lines; an empty folder gives no rows, a binary file none."""
    register(spark)
    own = {"path": path, **options} | ({"projects": ",".join(projects)} if projects is not None else {})
    return described(spark.read.format("repositories").options(**own).load().where("content is not null"))


def read_listing(spark: SparkSession, url: str, per_page: int = 100, total: int | None = None) -> DataFrame:
    """A provider's listing, a row a repository, in the columns of ``repository_listing``."""
    register(spark)
    own = {"url": url, "perPage": str(per_page)} | ({"total": str(total)} if total is not None else {})
    return spark.read.format("repository_listing").options(**own).load()
