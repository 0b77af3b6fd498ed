"""Queries that write archives and listings of the documents table to the shared folder and read them back, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.plans.registry import query
from codeloom.session import own_dir, stored
from codeloom.sources import readers, writers

#: Documents of an archive, repositories of a page.
ARCHIVE, PAGE = 40, 100


@query("archive_files", f"""select 'a' || (doc_id // {ARCHIVE}) as project_id, case doc_id % 4 when 0 then 'docs/d' || doc_id || '.md' when 1 then '.github/d' || doc_id || '.yml' else 'src/d' || doc_id || '.py' end as file_path,
 case doc_id % 4 when 0 then 'Markdown' when 1 then 'YAML' else 'Python' end as language, md5(coalesce(text, '')) as content_md5, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
 cast(len(string_split(coalesce(text, ''), chr(10))) as bigint) as n_lines from documents where doc_id is not null and doc_id % 4 <> 3 and not contains(coalesce(text, ''), chr(0))""")
def archive_files(spark, sf_dir):
    """Every document as a member of an archive; a fourth of them lie in a folder or have a name that readers leave out."""
    k = F.col("doc_id").cast("long")
    number = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("docs/d"), number, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit(".github/d"), number, F.lit(".yml"))).when(k % 4 == 2, F.concat(F.lit("src/d"), number, F.lit(".py")))
    left_out = F.when(k % 8 == 3, F.concat(F.lit("node_modules/d"), number, F.lit(".js"))).otherwise(F.concat(F.lit("img/d"), number, F.lit(".png")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    files = docs.select(F.concat(F.lit("a"), F.floor(k / ARCHIVE).cast("string")).alias("project_id"), F.coalesce(path, left_out).alias("file_path"), F.col("text").alias("content"))
    folder = f"{own_dir(spark)}/archives-{uuid.uuid4().hex}"
    stored(writers.write_archives(files, folder), "archives-written")
    got = readers.read_repositories(spark, folder)
    return got.select("project_id", "file_path", "language", F.md5("content").alias("content_md5"), "n_bytes", F.col("lines").cast("long").alias("n_lines"))


@query("remote_listing", """select cast(o_orderkey as bigint) as id, 'repo' || o_orderkey as name, 'own' || o_custkey || '/repo' || o_orderkey as full_name, o_orderkey % 3 = 0 as private, o_orderpriority as description, case when o_orderkey % 5 <> 0 then 'Python' end as language,
 cast(o_custkey as bigint) as stars, 'main' as default_branch, cast(o_orderdate as date)::varchar as updated_at, 'https://example.org/own' || o_custkey || '/repo' || o_orderkey || '.git' as clone_url from orders""")
def remote_listing(spark, sf_dir):
    """Orders as repositories of a remote listing, landed as pages of 100 and read page by page."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    full = F.concat(F.lit("own"), customer, F.lit("/repo"), key)
    rows = o.select(F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("repo"), key).alias("name"), full.alias("full_name"), (F.col("o_orderkey") % 3 == 0).alias("private"), F.col("o_orderpriority").alias("description"),
                    F.when(F.col("o_orderkey") % 5 != 0, "Python").alias("language"), F.col("o_custkey").cast("long").alias("stargazers_count"), F.lit("main").alias("default_branch"), F.to_date("o_orderdate").cast("string").alias("updated_at"),
                    F.concat(F.lit("https://example.org/"), full, F.lit(".git")).alias("clone_url"))
    # pages are filled bucket by bucket
    total = rows.count()
    placed = stored(writers.numbered(rows, "id"), "listing-rows").withColumn("page", F.floor(F.col("place_") / PAGE) + 1).drop("place_")
    folder = f"{own_dir(spark)}/listing-{uuid.uuid4().hex}"
    stored(writers.write_pages(placed, f"{folder}/{PAGE}"), "pages-written")
    return readers.read_listing(spark, f"{folder}/{{per_page}}/{{page}}.json", PAGE, total)
