"""Dependency, layer and knowledge graphs as edge and node tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.session import cut, stored

#: Extensions tried for an import, in order, first on the path itself and then on its index file.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".java", ".cpp", ".c", ".h")

#: Edges that one task walks, at most.
WALKED_EDGES = 100_000


def _named(files: DataFrame, key: str) -> DataFrame:
    """key, base_, to_file: what an import of each path finds, the file of the lowest rank. A file answers to its path, to that without its extension and, if it is
    an index file, to its folder, so there are at most three rows a file."""
    path = F.col("file_path")
    stems = [F.struct(path.alias("base_"), F.lit(0).alias("rank_"))]
    for at, mid in enumerate(("", "/index")):
        for k, e in enumerate(EXTENSIONS):
            ending = mid + e
            stems.append(F.when(path.endswith(ending), F.struct(F.substring(path, F.lit(1), F.length(path) - len(ending)).alias("base_"), F.lit(1 + at * len(EXTENSIONS) + k).alias("rank_"))))
    each = files.select(key, "file_path").distinct().select(key, "file_path", F.explode(F.array_compact(F.array(*stems))).alias("s_"))
    return each.groupBy(key, F.col("s_.base_").alias("base_")).agg(F.min_by("file_path", "s_.rank_").alias("to_file"))


def resolve(imports: DataFrame, files: DataFrame, key: str = "project_id") -> DataFrame:
    """imports (key, from_file, source, language, line) with kind, to_file (local) and to_package.

    A relative source names a path; it finds that path, else the path with an extension, else its index with an extension, in the order of ``EXTENSIONS``.
    Files say what they answer to, so imports meet them by one equality as they are. Both sides grow with the input and their sizes are guessed
    too small from compressed files, so the join is a merge and nothing of it goes through the driver.
    """
    base = X.normalise(F.concat_ws("/", X.dirname("from_file"), "source"))
    kinds = imports.withColumn("kind", X.dependency_class("source", "language")).withColumn("base_", F.when(F.col("kind") == "local", base))
    found = kinds.join(_named(files, key).hint("merge"), [key, "base_"], "left")
    return found.select(key, *[c for c in kinds.columns if c not in (key, "base_")], "to_file").withColumn("to_package", F.when(F.col("kind") == "external", X.package_key("source")))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'local' and to_file is null")


def local_edges(resolved: DataFrame, key: str = "project_id") -> DataFrame:
    return resolved.where("to_file is not null").select(key, F.col("from_file").alias("source"), F.col("to_file").alias("target"), "line")


def grouped_back(resolved: DataFrame, key: str = "project_id") -> DataFrame:
    """One row a file with its dependencies in order."""
    return resolved.groupBy(key, "from_file").agg(F.array_sort(F.collect_list(F.struct("line", "source", "kind", "to_file", "to_package"))).alias("dependencies"))


def cycles(edges: DataFrame, key: str = "project_id") -> DataFrame:
    """One row for every back edge of a depth-first walk over each project's files in order of name: key, cycle (array, closed).

    The walk needs one project's edges together, a graph of files; projects are independent and spread over tasks.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(pdf["source"], pdf["target"], strict=True))):
            out.setdefault(a, []).append(b)
        colour: dict[str, int] = {}
        rows = []
        for start in sorted(out):
            if colour.get(start):
                continue
            path, stack = [start], [iter(out.get(start, []))]
            colour[start] = 1
            while stack:
                for nxt in stack[-1]:
                    if colour.get(nxt) == 1:
                        rows.append((pdf[key].iloc[0], path[path.index(nxt):] + [nxt]))
                    elif not colour.get(nxt):
                        colour[nxt] = 1
                        path.append(nxt)
                        stack.append(iter(out.get(nxt, [])))
                        break
                else:
                    colour[path.pop()] = 2
                    stack.pop()
        return pd.DataFrame(rows, columns=[key, "cycle"])

    kind = edges.schema[key].dataType.simpleString()
    return edges.select(key, "source", "target").groupBy(key).applyInPandas(walk, f"{key} {kind}, cycle array<string>")


def trimmed(edges: DataFrame, enough: int = 0) -> DataFrame:
    """edges (a, b) without those that no cycle can take: from a node that nothing leads to, or to one that leads nowhere; or ``enough`` edges at most."""
    n = edges.count()
    while n > enough:
        edges = cut(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """node, colour of every end of edges (a, b): the largest node that leads to it, itself included."""
    colour = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("colour", F.col("node")))
    while True:
        best = edges.join(colour, edges["a"] == colour["node"]).groupBy("b").agg(F.max("colour").alias("most"))
        colour = cut(colour.join(best, colour["node"] == best["b"], "left").select("node", F.greatest("colour", "most").alias("colour"), (F.col("most") > F.col("colour")).alias("moved")))
        if colour.where("moved").isEmpty():
            return colour.select("node", "colour")
        colour = colour.select("node", "colour")


def walked_components(edges: pd.DataFrame) -> pd.DataFrame:
    """node, root of edges (a, b) in memory: a depth-first walk with low links, without recursion."""
    out: dict = {}
    for a, b in zip(edges.a.tolist(), edges.b.tolist(), strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    seen, low, held, stack, rows = {}, {}, set(), [], []
    for start in out:
        if start in seen:
            continue
        work = [(start, iter(out[start]))]
        seen[start] = low[start] = len(seen)
        stack.append(start)
        held.add(start)
        while work:
            node, ahead = work[-1]
            for nxt in ahead:
                if nxt not in seen:
                    seen[nxt] = low[nxt] = len(seen)
                    stack.append(nxt)
                    held.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in held:
                    low[node] = min(low[node], seen[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    while True:
                        member = stack.pop()
                        held.discard(member)
                        rows.append((member, node))
                        if member == node:
                            break
    return pd.DataFrame(rows, columns=["node", "root"])


def strong_components(edges: DataFrame, source: str = "source", target: str = "target", walked: int = WALKED_EDGES) -> DataFrame:
    """node, component (its smallest node), size of every node that lies on a cycle; edges are of one graph of any size.

    Edges that no cycle can take are trimmed. Every node left takes the largest node that leads to it as its colour (forward); what leads back to that node
    through nodes of its colour is its component (backward). Components and edges between colours go, and the rest starts again. All
    steps are joins over edge tables: no node's neighbours and no component are gathered. Rounds follow the longest way inside a component. Once no more
    than ``walked`` edges are left, one task walks them, which saves the rounds of small rests and gives the same components.
    Null ends are no edges, repeated edges are one, a loop makes a component of one node, no edges give no rows.
    """
    all_edges = stored(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    loops = all_edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    left, found = all_edges.where("a <> b"), None
    while True:
        left = trimmed(left, walked)
        n = left.count()
        if n <= walked:
            if n:
                kind = left.schema["a"].dataType.simpleString()
                got = left.withColumn("all_", F.lit(0)).groupBy("all_").applyInPandas(lambda pdf: walked_components(pdf[["a", "b"]]), f"node {kind}, root {kind}")
                got = stored(got, "walked")
                found = got if found is None else found.unionByName(got)
            break
        colour = coloured(left)
        at = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731  used at once
        inside = cut(left.join(at("a"), "a").join(at("b"), "b").where("a_colour = b_colour").select("a", "b", F.col("a_colour").alias("root")))
        got = front = cut(colour.where("node = colour").select("node", F.col("colour").alias("root")))
        while True:
            step = inside.join(front.select(F.col("node").alias("b"), "root"), ["b", "root"]).select(F.col("a").alias("node"), "root").distinct()
            front = cut(step.join(got, ["node", "root"], "left_anti"))
            if front.isEmpty():
                break
            got = got.unionByName(front)
        got = cut(got)
        found = got if found is None else found.unionByName(got)
        gone = lambda end: got.select(F.col("node").alias(end))  # noqa: B023, E731
        left = cut(inside.select("a", "b").join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"))
    if found is None:
        return loops.select("node", F.col("root").alias("component"), F.lit(1).cast("long").alias("size"))
    several = found.groupBy("root").agg(F.count("*").alias("size"), F.min("node").alias("component")).where("size > 1")
    named = found.join(several, "root").select("node", "component", "size")
    return named.unionByName(loops.join(named, "node", "left_anti").select("node", F.col("root").alias("component"), F.lit(1).cast("long").alias("size")))


def cycles_of_components(edges: DataFrame) -> DataFrame:
    """component, cycle (array, closed): what ``cycles`` finds inside of each strong component of one graph (source, target), all others being on none.

    A walk in order of name needs one component's edges together; components are independent and spread over tasks.
    """
    own = stored(strong_components(edges), "components")
    at = lambda end: own.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    inside = edges.select("source", "target").distinct().join(at("source"), "source").join(at("target"), "target").where("source_component = target_component")
    return cycles(inside.select(F.col("source_component").alias("component"), "source", "target"), "component")


def canonical_cycle(cycle: str = "cycle"):
    """The cycle as it reads from its smallest member, as text."""
    body = F.slice(F.col(cycle), 1, F.size(cycle) - 1)
    at = F.array_position(body, F.array_min(body)).cast("int")
    turned = F.concat(F.slice(body, at, F.size(body)), F.slice(body, F.lit(1), at - 1))
    return F.concat(F.array_join(turned, " > "), F.lit(" > "), F.array_min(body))


def layer_nodes(files: DataFrame, key: str = "project_id") -> DataFrame:
    """files (key, file_path, loc): file count, code lines and files of each layer."""
    own = files.withColumn("layer", X.layer("file_path"))
    return own.groupBy(key, "layer").agg(F.initcap(F.first("layer")).alias("label"), F.count("*").alias("file_count"), F.sum("loc").cast("long").alias("total_loc"), F.array_sort(F.collect_list("file_path")).alias("files"))


def layers_by_code(nodes: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of layer_nodes with their place in a project, most code lines first."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total_loc"), "layer")))


def layer_edges(edges: DataFrame, key: str = "project_id") -> DataFrame:
    """Edges between files as counts between different layers; the layer is a function of the path, so nothing is joined."""
    both = edges.select(key, X.layer("source").alias("source_layer"), X.layer("target").alias("target_layer"), "source", "target").where("source_layer <> target_layer")
    return both.groupBy(key, "source_layer", "target_layer").agg(F.count("*").alias("edge_count"), F.count_distinct("source", "target").alias("file_pairs"))


def disconnected(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Nodes on no edge."""
    ends = edges.select(F.col(source).alias(node)).union(edges.select(F.col(target).alias(node))).distinct()
    return nodes.join(ends, node, "left_anti")


def knowledge_graph(files: DataFrame, symbols: DataFrame, edges: DataFrame, packages: DataFrame, routes: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """(nodes: key, id, label, type; edges: key, source, target, type), each once."""
    file_id = lambda c: F.concat(F.lit("file:"), c)
    kind = F.when(F.col("kind").isin("function", "arrow_function", "method"), "function").when(F.col("kind") == "class", "class").when(F.col("kind") == "component", "component")
    own = symbols.withColumn("type", kind).where("type is not null").withColumn("id", F.concat_ws(":", "type", "file_path", "name"))
    r = routes.withColumn("id", F.concat(F.lit("route:"), "method", F.lit(":"), "path"))
    nodes = (files.select(key, file_id(F.col("file_path")).alias("id"), X.basename("file_path").alias("label"), F.lit("file").alias("type"))
             .union(own.select(key, "id", F.col("name").alias("label"), "type")).union(r.select(key, "id", F.concat_ws(" ", "method", "path").alias("label"), F.lit("route").alias("type")))
             .union(packages.select(key, F.concat(F.lit("package:"), "to_package").alias("id"), F.col("to_package").alias("label"), F.lit("package").alias("type")))).dropDuplicates([key, "id"])
    links = (own.select(key, file_id(F.col("file_path")).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
             .union(r.select(key, file_id(F.col("file")).alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type")))
             .union(edges.select(key, file_id(F.col("source")).alias("source"), file_id(F.col("target")).alias("target"), F.lit("imports").alias("type")))
             .union(packages.select(key, file_id(F.col("from_file")).alias("source"), F.concat(F.lit("package:"), "to_package").alias("target"), F.lit("imports").alias("type")))).dropDuplicates([key, "source", "target", "type"])
    return nodes, links


def reach(edges: DataFrame, roots: DataFrame, key: str = "project_id", depth: int = 10) -> DataFrame:
    """Files reached from each project's root with the smallest depth, by rounds of joins: each round meets only what the last one found."""
    front = cut(roots.select(key, F.col("root").alias("node"), F.lit(0).alias("depth")))
    found = front
    hops = edges.select(key, F.col("source").alias("node"), "target")
    for d in range(1, depth + 1):
        step = front.join(hops, [key, "node"]).select(key, F.col("target").alias("node"), F.lit(d).alias("depth")).distinct()
        front = cut(step.join(found.select(key, "node"), [key, "node"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def walk(files: DataFrame, symbols: DataFrame, imports: DataFrame, entries: DataFrame, key: str = "project_id", imports_of: int = 10, symbols_of: int = 10, modules: int = 30) -> DataFrame:
    """Steps of a preorder walk from the entry file: the first exported symbols of each file, then its first local imports.

    symbols (key, file_path, name, kind, line, exported); imports (key, from_file, to_file, line); entries (key, entry). A project is one group.
    """
    s = symbols.where("exported").select(key, F.col("file_path").alias("file"), "name", "kind", "line", F.lit(None).cast("string").alias("to_file"))
    i = imports.where("to_file is not null").select(key, F.col("from_file").alias("file"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), "line", "to_file")
    rows = s.unionByName(i).join(entries, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file", "line"], kind="stable")
        names, to = {}, {}
        for f, name, what, line, target in zip(*(pdf[c].tolist() for c in ("file", "name", "kind", "line", "to_file")), strict=True):
            if isinstance(name, str) and len(own := names.setdefault(f, [])) < symbols_of:
                own.append((name, what, int(line)))
            if isinstance(target, str) and len(own := to.setdefault(f, [])) < imports_of:
                own.append(target)
        seen, stack, out = set(), [(pdf.entry.iloc[0], 0)], []
        while stack:
            f, depth = stack.pop()
            if f in seen:
                continue
            seen.add(f)
            for symbol in names.get(f, []):
                out.append((pdf[key].iloc[0], len(out) + 1, f, *symbol, depth))
            stack += [(t, depth + 1) for t in reversed(to.get(f, []))]
        return pd.DataFrame(out, columns=[key, "step", "file", "symbol", "kind", "line", "depth"])

    kind = files.schema[key].dataType.simpleString()
    steps = stored(rows.groupBy(key).applyInPandas(run, f"{key} {kind}, step int, file string, symbol string, kind string, line int, depth int"), "steps")
    # a project without a step shows its first files
    w = Window.partitionBy(key).orderBy("file_path")
    rest = files.join(steps.select(key).distinct(), key, "left_anti").withColumn("step", F.row_number().over(w)).where(F.col("step") <= modules)
    steps = steps.unionByName(rest.select(key, "step", F.col("file_path").alias("file"), X.basename("file_path").alias("symbol"), F.lit("module").alias("kind"), F.lit(1).alias("line"), F.lit(0).alias("depth")))
    return steps.withColumn("phase", X.phase(F.concat_ws(" ", "symbol", "file"), "kind")).withColumn("description", F.concat(F.col("symbol"), F.lit("() - "), "kind", F.lit(" in "), X.basename("file")))


def number_steps(steps: DataFrame, key: str, order: list) -> DataFrame:
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def phase_groups(steps: DataFrame, key: str = "project_id") -> DataFrame:
    """Count, first and last step of each phase, in order of first appearance, with animation times."""
    return steps.groupBy(key, "phase").agg(F.count("*").alias("n_steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step")).withColumn("duration_ms", F.col("n_steps") * 800)


def animate(steps: DataFrame, key: str = "project_id") -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key))
    return steps.withColumn("y", (F.col("step") - 1) * 80).withColumn("delay_ms", (F.col("step") - 1) * 800).withColumn("total_ms", F.greatest(F.lit(4000), n * 800))


#: Entry points by path, best first.
ENTRY_POINTS = (r"(^|/)index\.(js|ts|jsx|tsx)$", r"(^|/)app\.(js|ts|jsx|tsx)$", r"(^|/)server\.(js|ts)$", r"(^|/)main\.(js|ts|py|java|cpp)$", r"(^|/)App\.(jsx|tsx)$")
#: Entry points of the summary; the least deep wins.
ENTRY_NAMES = ("index.js", "index.ts", "index.jsx", "app.js", "app.ts", "app.jsx", "main.js", "main.ts", "main.py", "app.py", "main.java", "main.cpp")


def entry_points(files: DataFrame, key: str = "project_id") -> DataFrame:
    """The file of the best pattern, else the first file, of each project."""
    rank = F.coalesce(*[F.when(F.col("file_path").rlike(p), k) for k, p in enumerate(ENTRY_POINTS)], F.lit(len(ENTRY_POINTS)))
    return files.groupBy(key).agg(F.min_by("file_path", F.struct(rank, "file_path")).alias("entry"))


def summary_entry(files: DataFrame, key: str = "project_id") -> DataFrame:
    own = files.where(F.lower(X.basename("file_path")).isin(*ENTRY_NAMES))
    return own.groupBy(key).agg(F.min_by("file_path", F.struct(F.size(F.split("file_path", "/")), "file_path")).alias("entry"))


def controller_flow(routes: DataFrame, edges: DataFrame, symbols: DataFrame, key: str = "project_id", routes_of: int = 30, symbols_of: int = 5) -> DataFrame:
    """Route, then the controller files it imports, then their first symbols: rows by route and order. Symbols grow with the input and their size is
    guessed too small from compressed files, so they meet routes by a merge."""
    w = Window.partitionBy(key).orderBy("file", "line")
    r = routes.withColumn("route_no", F.row_number().over(w)).where(F.col("route_no") <= routes_of)
    hop = r.join(edges.select(key, F.col("source").alias("file"), "target"), [key, "file"])
    s = Window.partitionBy(key, "route_no", "target").orderBy("s_line")
    own = symbols.select(key, F.col("file_path").alias("target"), F.col("name").alias("symbol"), F.col("line").alias("s_line"))
    return hop.join(own.hint("merge"), [key, "target"], "left").withColumn("rn_", F.row_number().over(s)).where(F.col("rn_") <= symbols_of).select(key, "route_no", "method", "path", "file", "target", "symbol", "s_line")


#: Stages of a request, files each shows at most, and what puts a file there.
REQUEST_STAGES = (("authentication", 3, "auth|passport|jwt"), ("validation", 1, "valid|schema"), ("controller", 3, "controller"), ("service", 3, "service"), ("model", 2, "model"))


def request_flow(files: DataFrame, key: str = "project_id") -> DataFrame:
    """request, then files of each stage in order of path up to its cap, then response."""
    ends = files.select(key).distinct()
    out = ends.select(key, F.lit(0).alias("stage_no"), F.lit("request").alias("phase"), F.lit(None).cast("string").alias("file"))
    for k, (name, cap, pattern) in enumerate(REQUEST_STAGES, 1):
        w = Window.partitionBy(key).orderBy("file_path")
        own = files.where(F.lower("file_path").rlike(pattern)).withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= cap)
        out = out.union(own.select(key, F.lit(k), F.lit(name), "file_path"))
    out = out.union(ends.select(key, F.lit(len(REQUEST_STAGES) + 1), F.lit("response"), F.lit(None).cast("string")))
    return number_steps(out, key, ["stage_no", "file"])


def flow_kind(projects: DataFrame, routes: DataFrame, operations: DataFrame, key: str = "project_id") -> DataFrame:
    """request where there are routes, else database where there are operations, else call_chain."""
    r = routes.groupBy(key).agg(F.count("*").alias("n_routes"))
    d = operations.groupBy(key).agg(F.count("*").alias("n_operations"))
    return projects.select(key).distinct().join(r, key, "left").join(d, key, "left").select(key, F.when(F.col("n_routes") > 0, "request").when(F.col("n_operations") > 0, "database").otherwise("call_chain").alias("flow"))


def relationships(models: DataFrame, fields: DataFrame, key: str = "project_id") -> DataFrame:
    """models (key, name); fields (key, model, name, type, ref): a relation for each reference to a known model, whatever the case."""
    m = models.select(key, F.col("name").alias("to_model"), F.lower("name").alias("l_"))
    many = F.coalesce(F.contains(F.col("type"), F.lit("Array")) | F.col("type").startswith("["), F.lit(False)) | F.col("name").endswith("s")
    return (fields.where("ref is not null").withColumn("l_", F.lower("ref")).join(m, [key, "l_"])
            .select(key, F.col("model").alias("from_model"), "to_model", F.col("name").alias("field"), F.when(many, "one-to-many").otherwise("one-to-one").alias("kind")))
