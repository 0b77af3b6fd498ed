"""Archives, directories and listings as data sources."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.sources import readers, writers
from codeloom.sources.repositories import read_zips


@pytest.fixture()
def folder(tmp_path):
    for name, members in {"one": {"one-main/a.py": b"x = 1\n", "one-main/node_modules/b.js": b"no", "one-main/i.png": b"\x89", "one-main/bin.txt": b"a\0b"}, "two": {"a/x.md": b"# x", "b/y.md": b"caf\xc3\xa9", "../out.py": b"no"}, "none": {}}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for path, data in members.items():
                z.writestr(path, data)
    for path, data in {"dir/.env": "A=1", "dir/src/deep/m.js": "let a;\n\n", "dir/.git/config": "no", "dir/build/out.js": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(data)
    (tmp_path / "readme.txt").write_text("no project")
    (tmp_path / "_part.zip").write_text("no archive")
    return tmp_path


def seen(df):
    return {(r.project_id, r.file_path, r.content, r.n_bytes) for r in df.collect()}


ALL = {("one", "a.py", "x = 1\n", 6), ("two", "a/x.md", "# x", 3), ("two", "b/y.md", "café", 5), ("dir", ".env", "A=1", 3), ("dir", "src/deep/m.js", "let a;\n\n", 8)}


@pytest.mark.parametrize("most", ["1", "400", "1000000"])
def test_repositories_of_any_partitions(spark, folder, most):
    assert seen(readers.read_repositories(spark, str(folder), maxPartitionBytes=most)) == ALL
    assert seen(readers.read_repositories(spark, f"file://{folder}", maxPartitionBytes=most)) == ALL


def test_only_named_projects_are_opened(spark, folder):
    (folder / "broken.zip").write_bytes(b"not a zip")
    assert seen(readers.read_repositories(spark, str(folder), ["dir", "two"])) == {r for r in ALL if r[0] in ("dir", "two")}
    with pytest.raises(Exception, match="not a zip"):
        readers.read_repositories(spark, str(folder)).count()


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert readers.read_repositories(spark, str(tmp_path)).count() == 0


def test_archives_as_binary_files_read_alike(spark, folder):
    raw = spark.read.format("binaryFile").load(f"{folder}/two.zip").select(F.lit("two").alias("project_id"), "content")
    assert seen(read_zips(raw)) == {r for r in ALL if r[0] == "two"}


def test_planned():
    assert readers.planned([("a", "u", 5), ("b", "v", 5), ("c", "w", 90), ("d", "x", 1)], 10) == [[("a", "u"), ("b", "v")], [("c", "w")], [("d", "x")]]
    assert readers.planned([], 10) == []


def test_written_archives_come_back(spark, tmp_path):
    rows = [("p", "a.py", "x"), ("p", "b.py", None), (None, "c.py", "x"), ("q", None, "x"), ("q", "d.py", "é" * 70_000)]
    n = writers.write_archives(spark.createDataFrame(rows, "project_id string, file_path string, content string"), str(tmp_path))
    assert {tuple(r) for r in n.collect()} == {("p", 2), ("q", 1)}
    assert {tuple(r) for r in n.collect()} == {("p", 2), ("q", 1)}  # a task tried again
    assert seen(readers.read_repositories(spark, str(tmp_path))) == {("p", "a.py", "x", 1), ("p", "b.py", "", 0), ("q", "d.py", "é" * 70_000, 140_000)}


@pytest.mark.parametrize(("n", "total"), [(0, None), (0, 0), (7, None), (7, 7), (9, None), (9, 9), (8, 8)])
def test_listing_of_any_length(spark, tmp_path, n, total):
    rows = [{"id": k, "name": f"r{k}", "stargazers_count": k * 2, "private": k % 2 == 0, "owner": {"login": "x"}} for k in range(n)]
    (tmp_path / "3").mkdir()
    for page in range(-(-n // 3)):
        (tmp_path / "3" / f"{page + 1}.json").write_text(json.dumps(rows[page * 3:page * 3 + 3]))
    got = readers.read_listing(spark, f"{tmp_path}/{{per_page}}/{{page}}.json", 3, total)
    assert len(got.columns) == 10 and sorted((r.id, r.name, r.stars, r.private, r.language) for r in got.collect()) == [(k, f"r{k}", k * 2, k % 2 == 0, None) for k in range(n)]


def test_numbered_gives_every_place_once(spark):
    assert sorted(r.place_ for r in writers.numbered(spark.range(500), "id").collect()) == list(range(500))


def test_pages_are_written_without_copies_of_a_batch(spark, tmp_path):
    """Bodies of whole batches went through pandas, so a worker held each of them several times."""
    import json

    from codeloom.sources import writers

    rows = spark.range(25).selectExpr("id", "concat('repo', id, ' ü') as name", "cast(id div 10 as int) + 1 as page")
    made = writers.write_pages(rows, str(tmp_path / "pages"))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert sorted((r.page, r.n) for r in made.collect()) == [(1, 10), (2, 10), (3, 5)]
    assert json.loads((tmp_path / "pages" / "3.json").read_text()) == [{"id": k, "name": f"repo{k} ü"} for k in range(20, 25)]
