"""What a repository is, put together for readers and prompts: symbols by kind, files by layer, summaries, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.chunking import pack_files
from codeloom.session import stored

P = "project_id"
#: Names and files that a summary lists of each kind.
LISTED = 20


def symbols_by_kind(symbols: DataFrame, most: int = LISTED) -> DataFrame:
    """project_id, kind, n, names (the first by file, line and name)."""
    w = Window.partitionBy(P, "kind").orderBy("file_path", "line", "name")
    own = symbols.withColumn("k_", F.row_number().over(w))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k_") <= most, F.struct("k_", "name")))), lambda s: s["name"])
    return own.groupBy(P, "kind").agg(F.count("*").alias("n"), first.alias("names"))


def architecture(files: DataFrame, most: int = LISTED) -> DataFrame:
    """project_id, layer, n_files, n_lines, files (the first): files of the layers that a summary knows; others have none."""
    own = files.withColumn("layer", X.summary_layer("file_path")).where("layer is not null").withColumn("k_", F.row_number().over(Window.partitionBy(P, "layer").orderBy("file_path")))
    first = F.array_sort(F.collect_list(F.when(F.col("k_") <= most, F.col("file_path"))))
    return own.groupBy(P, "layer").agg(F.count("*").alias("n_files"), F.sum("loc").cast("long").alias("n_lines"), first.alias("files"))


def code_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """project_id, summary: totals, layers and symbols of a project as lines of text, for a prompt."""
    totals = files.groupBy(P).agg(F.concat(F.lit("Files: "), F.count("*").cast("string"), F.lit(", code lines: "), F.sum("loc").cast("string")).alias("a_"))
    joined = lambda line: F.array_join(F.array_sort(F.collect_list(line)), "\n")
    layers = architecture(files).groupBy(P).agg(joined(F.concat(F.lit("- "), "layer", F.lit(": "), F.col("n_files").cast("string"))).alias("b_"))
    kinds = symbols_by_kind(symbols).groupBy(P).agg(joined(F.concat(F.lit("- "), "kind", F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join(F.slice("names", 1, 5), ", "))).alias("c_"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(title + "\n"), c))
    return totals.join(layers, P, "left").join(kinds, P, "left").select(P, F.concat_ws("\n", "a_", part("Layers:", "b_"), part("Symbols:", "c_")).alias("summary"))


def diagrams(**texts: DataFrame) -> DataFrame:
    """project_id, diagram, text of several diagrams (project_id, text)."""
    out = None
    for name, rows in texts.items():
        own = rows.select(P, F.lit(name).alias("diagram"), "text")
        out = own if out is None else out.unionByName(own)
    return out


def codebase_summary(files: DataFrame, most: int = 5_000, fan: int = 16, largest: int = 5) -> DataFrame:
    """project_id, n_packs, n_files, n_tokens, summary: files packed to ``most`` tokens, packs summarised, then ``fan`` summaries at a time until one is left.

    The stand-in for a model keeps what merges without loss: totals, and the largest files (ties by path). No group holds more than a pack or ``fan``
    summaries of bounded size, whatever a project's size; rounds follow the logarithm of the number of packs. A null text has no tokens; a null
    project is one of its own; no files give no rows.
    """
    sized = files.select(P, "file_path", F.coalesce(X.estimate_tokens("content"), F.lit(0)).cast("long").alias("t_"))
    packs = pack_files(files, P, most).select(F.col(P).alias("p_"), F.col("file_path").alias("f_"), F.col("pack_no").cast("long").alias("node"))
    own = sized.join(packs, sized[P].eqNullSafe(packs["p_"]) & (sized["file_path"] == packs["f_"])).select(P, "node", "file_path", "t_")
    first = Window.partitionBy(P, "node").orderBy(F.desc("t_"), "file_path")
    entry = F.struct(F.negative("t_").alias("less"), F.col("file_path").alias("path"))
    nodes = own.withColumn("r_", F.row_number().over(first)).groupBy(P, "node").agg(F.lit(1).cast("long").alias("n_packs"), F.count("*").alias("n_files"), F.sum("t_").alias("n_tokens"), F.array_sort(F.collect_list(F.when(F.col("r_") <= largest, entry))).alias("top"))
    nodes = stored(nodes, "pack-summaries")
    left = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    while left > 1:
        merged = nodes.groupBy(P, F.floor(F.col("node") / fan).alias("node"))
        nodes = merged.agg(*[F.sum(c).alias(c) for c in ("n_packs", "n_files", "n_tokens")], F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, largest).alias("top"))
        left = -(-left // fan)
    listed = F.array_join(F.transform("top", lambda x: F.concat(x["path"], F.lit(" ("), F.negative(x["less"]).cast("string"), F.lit(")"))), ", ")
    return nodes.select(P, "n_packs", "n_files", "n_tokens", F.concat(F.col("n_files").cast("string"), F.lit(" files, "), F.col("n_tokens").cast("string"), F.lit(" tokens; largest: "), listed).alias("summary"))
