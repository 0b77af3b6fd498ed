"""Graph and diagram payloads built from tables: sized nodes, links, Mermaid texts, tree text, event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.session import cut

P = "project_id"


def capped_label(array: str, n: int, between: str = "<br/>"):
    """The first n, and how many more there are."""
    a = F.col(array)
    return F.concat(F.array_join(F.slice(a, 1, n), between), F.when(F.size(a) > n, F.concat(F.lit(" +"), (F.size(a) - n).cast("string"), F.lit(" more"))).otherwise(""))


def joined(rows: DataFrame, key, order, line, start: str, between: str = "\n") -> DataFrame:
    """One text a key: start, then lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line_")))), lambda s: s["line_"]), between)
    return rows.groupBy(*key).agg(F.concat(F.lit(start + between), body).alias("text"))


def dependency_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with radius by code lines (6 to 24), layer as group and number of edges."""
    ends = edges.select(P, F.col("source").alias("file_path")).union(edges.select(P, "target")).groupBy(P, "file_path").agg(F.count("*").alias("n_edges"))
    return files.join(ends, [P, "file_path"], "left").select(P, F.col("file_path").alias("id"), X.basename("file_path").alias("label"), X.layer("file_path").alias("group"), X.clamp(F.sqrt("loc"), F.lit(6.0), F.lit(24.0)).alias("radius"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def dependency_links(edges: DataFrame) -> DataFrame:
    return edges.groupBy(P, "source", "target").agg(F.count("*").alias("weight"))


def knowledge_view(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    size = F.when(F.col("type") == "file", 12.0).when(F.col("type") == "class", 10.0).otherwise(7.0)
    return nodes.withColumn("radius", size), links.select(P, "source", "target", F.col("type").alias("relationship"))


def module_view(edges: DataFrame) -> DataFrame:
    """Modules with 'n deps' labels."""
    return edges.groupBy(P, X.dirname("source").alias("id")).agg(F.count_distinct(X.dirname("target")).alias("n")).select(P, "id", F.concat(F.col("n").cast("string"), F.lit(" deps")).alias("label"))


def prefix_counts(routes: DataFrame, path) -> DataFrame:
    """Routes by the first segment of their path."""
    return routes.groupBy(F.concat(F.lit("/"), F.split_part(F.regexp_replace(path, "^/", ""), F.lit("/"), F.lit(1))).alias("prefix")).agg(F.count("*").alias("n_routes"))


def call_view(steps: DataFrame) -> DataFrame:
    return steps.select(P, F.concat_ws(":", "file", "symbol").alias("id"), F.col("symbol").alias("label"), "phase", "depth")


def mermaid_layers(nodes: DataFrame, edges: DataFrame, cap: int = 5) -> DataFrame:
    """nodes (project_id, layer, files); edges (project_id, source_layer, target_layer, edge_count): project_id, text."""
    box = F.concat(F.lit("  "), X.diagram_id("layer"), F.lit('["'), X.diagram_label("layer"), F.lit("<br/>"), X.diagram_label(capped_label("files", cap, ", ")), F.lit('"]'))
    link = F.concat(F.lit("  "), X.diagram_id("source_layer"), F.lit(" -->|"), F.col("edge_count").cast("string"), F.lit("| "), X.diagram_id("target_layer"))
    every = nodes.select(P, F.lit(0).alias("k"), F.col("layer").alias("o"), box.alias("l")).union(edges.select(P, F.lit(1), F.concat_ws(">", "source_layer", "target_layer"), link))
    return joined(every, [P], ["k", "o"], F.col("l"), "flowchart TD")


def mermaid_sequence(routes: DataFrame, most: int = 15, notes: int = 10, database: bool = False) -> DataFrame:
    """Requests in order, a note for the first of them; with a database its round trip."""
    w = Window.partitionBy(P).orderBy("file", "line", "method", "path")
    r = routes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    call = F.concat(F.lit("  Client->>Server: "), "method", F.lit(" "), X.diagram_label("path"))
    note = F.when(F.col("k") <= notes, F.concat(F.lit("\n  Note over Server: "), X.diagram_label(X.basename("file")))).otherwise("")
    back = F.lit(("\n  Server->>Database: query\n  Database-->>Server: rows" if database else "") + "\n  Server-->>Client: response")
    return joined(r, [P], ["k"], F.concat(call, note, back), "sequenceDiagram")


def mermaid_er(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """fields (project_id, model, field, type); relations (project_id, from_model, to_model, field, kind)."""
    entity = fields.groupBy(P, "model").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    "), X.diagram_id("type"), F.lit(" "), X.diagram_id("field")))), "\n").alias("b"))
    body = entity.select(P, F.lit(0).alias("k"), F.col("model").alias("o"), F.concat(F.lit("  "), X.diagram_id("model"), F.lit(" {\n"), "b", F.lit("\n  }")).alias("l"))
    sign = F.when(F.col("kind") == "one-to-many", "||--o{").otherwise("||--||")
    link = relations.select(P, F.lit(1), F.concat_ws(">", "from_model", "to_model", "field"), F.concat(F.lit("  "), X.diagram_id("from_model"), F.lit(" "), sign, F.lit(" "), X.diagram_id("to_model"), F.lit(" : "), X.diagram_id("field")))
    return joined(body.union(link), [P], ["k", "o"], F.col("l"), "erDiagram")


def mermaid_flow(steps: DataFrame) -> DataFrame:
    """A subgraph for each phase, steps linked in order."""
    box = F.concat(F.lit("    S"), F.col("step").cast("string"), F.lit('["'), X.diagram_label("description"), F.lit('"]'))
    parts = steps.groupBy(P, "phase").agg(F.min("step").alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", box.alias("b")))), lambda s: s["b"]), "\n").alias("b"))
    body = parts.select(P, F.lit(0).alias("k"), "o", F.concat(F.lit("  subgraph "), "phase", F.lit("\n"), "b", F.lit("\n  end")).alias("l"))
    link = steps.where("step > 1").select(P, F.lit(1), F.col("step").alias("o"), F.concat(F.lit("  S"), (F.col("step") - 1).cast("string"), F.lit(" --> S"), F.col("step").cast("string")))
    return joined(body.union(link), [P], ["k", "o"], F.col("l"), "flowchart LR")


def tree_nodes(files: DataFrame) -> DataFrame:
    """Files and the folders above them: project_id, path, parent_path, name, depth, type, size_kb, language, is_last."""
    parts = F.split("file_path", "/")
    folders = files.where(F.size(parts) > 1).select(P, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).where("path <> ''").distinct()
    every = files.select(P, F.col("file_path").alias("path"), F.lit("file").alias("type"), "size_kb", "language").unionByName(folders.select(P, "path", F.lit("directory").alias("type"), F.lit(None).cast("double").alias("size_kb"), F.lit(None).cast("string").alias("language")))
    every = every.withColumn("parent_path", F.when(F.instr("path", "/") > 0, X.dirname("path")).otherwise("")).withColumn("name", X.basename("path")).withColumn("depth", F.size(F.split("path", "/")) - 1)
    order = [(F.col("type") == "directory"), F.collate("name", "UNICODE")]
    w = Window.partitionBy(P, "parent_path").orderBy(*order)
    return every.withColumn("position", F.row_number().over(w)).withColumn("is_last", F.lead("name").over(w).isNull())


def tree_text(nodes: DataFrame) -> DataFrame:
    """One drawing a project; the order of a node is the chain of positions above it. The nodes are joined with themselves, so they are
    written first and windows over them run once."""
    nodes = cut(nodes)
    up = nodes.select(P, "path", "position", "is_last")
    chain = nodes.withColumn("above", F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/")))
    each = chain.select(P, "path", "name", "type", "depth", F.posexplode("above").alias("i", "a")).join(up.select(P, F.col("path").alias("a"), F.col("position").alias("p_"), F.col("is_last").alias("l_")), [P, "a"])
    rows = each.groupBy(P, "path", "name", "type", "depth").agg(F.array_sort(F.collect_list(F.struct("i", "p_", "l_"))).alias("c"))
    prefix = F.array_join(F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda s: F.when(s["l_"], "    ").otherwise("│   ")), "")
    line = F.concat(prefix, F.when(F.element_at("c", -1)["l_"], "└── ").otherwise("├── "), "name", F.when(F.col("type") == "directory", "/").otherwise(""))
    return joined(rows.withColumn("o", F.transform("c", lambda s: s["p_"])), [P], ["o"], line, ".")


def parse_frames(lines: DataFrame, column: str = "line", schema: str = "phase string, user_id long") -> DataFrame:
    """Lines of an event stream: 'data: ' frames as structs; [DONE] ends, other lines are left out."""
    body = F.substr(F.col(column), F.lit(7))
    return lines.where(F.col(column).startswith("data: ") & (body != "[DONE]")).withColumn("event", F.from_json(body, schema))
