"""Exact top-k inner-product search by best-first traversal of M-trees.

Inner product becomes distance by one more component: with M² the largest squared norm, x gets sqrt(M² - |x|²) and a
query gets 0, so that |q' - x'|² = |q|² + M² - 2 q·x and the nearest vectors are those of largest inner product.

Index: pivots are fitted on a bounded sample (``SAMPLE`` rows by hash of the id; at most ``PIVOTS``, farthest first, then moved to the
means of what is nearest them). Every vector goes to its nearest pivot, so a tree covers a small ball; a pivot's vectors are dealt to
several trees where they are more than one holds, by a number of the row, so copies are spread too. Each part is built into one M-tree of paged
nodes (routing vectors, covering radii, distances to the parent's routing vector) and kept as a file in the shared folder; a
directory file has the centre and covering radius of every tree.

Search, in two rounds. A query first searches the tree nearest to it, whose k best give it a bound. Then it meets only those
trees whose ball the bound reaches: tasks get (tree, block of queries) where at least one query of the block needs the tree.
Within a tree a node's entries are first bounded with the stored parent distances alone, |d(q, parent) - d(parent, child)| - radius, so
that no distance is computed for those that cannot hold one of the k best; the rest are visited nearest bound first. Leaf
scores are exact integers. The k best of a query in each tree are merged by a partial top-k aggregation.

Where vectors have no clusters (equal directions in many dimensions) every ball reaches every query, and all distances are computed; where a
query's bound leaves out less than half of a tree, the tree is scanned in one product.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do empty ones; a query
meets vectors of its own number of components only; rows that repeat a vec_id are candidates each, all but those
with the query's id; equal scores go to the smaller vec_id; fewer than k candidates give fewer rows; columns beside vec_id
and embedding are ignored. Scores must fit in 64 bits.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import fresh_path, opened, saved, table

#: Vectors of a tree, entries of a page, queries of a block; rows that pivots are fitted on, and pivots, at most.
TREE, PAGE, BLOCK = 8_192, 64, 1_024
SAMPLE, PIVOTS = 4_096, 512


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v (array of long floor(scale * x)), n_ (components); without the vectors that take no part."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"), F.size(x).alias("n_")))


class Node:
    """A page. Leaf: a span of the tree's vectors. Inner: children with covering radii, and the span of all below. Both: distance of each
    entry to the page's own routing vector."""

    __slots__ = ("children", "parent", "points", "radius", "span")

    def __init__(self, points, parent, span, radius=None, children=None):
        self.points, self.parent, self.span, self.radius, self.children = points, parent, span, radius, children


class Tree:
    """A root page, its routing vector, and all ids and vectors in the order of the leaves."""

    __slots__ = ("centre", "ids", "root", "vectors")

    def __init__(self, root: Node, centre: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.root, self.centre, self.ids, self.vectors = root, centre, ids, vectors


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def exact(most: float) -> bool:
    """Whether inner products of integer vectors with squared norms of at most ``most`` are exact in doubles."""
    return most < 2.0 ** 52


def build(ids: np.ndarray, vectors: np.ndarray, most: float, page: int = PAGE) -> Tree:
    """Bulk load: entries go to the nearest of up to ``page`` routing vectors, recursively, until they fit a page."""
    points, order = lifted(vectors, most), []

    def node(rows: np.ndarray, centre: np.ndarray) -> Node:
        start = sum(map(len, order))
        if len(rows) <= page:
            order.append(rows)
            return Node(None, np.linalg.norm(points[rows] - centre, axis=1), (start, start + len(rows)))
        seeds = rows[np.linspace(0, len(rows) - 1, min(page, -(-2 * len(rows) // page))).astype(int)]
        heads = np.unique(points[seeds], axis=0)
        near = nearest(points[rows], heads)
        parts = [rows[near == k] for k in range(len(heads))]
        if max(map(len, parts)) > 0.9 * len(rows):  # repeated vectors: halve by order
            parts = np.array_split(rows, min(page, -(-len(rows) // page)))
            heads = np.array([points[x[0]] for x in parts])
        kept = [k for k, x in enumerate(parts) if len(x)]
        heads, parts = heads[kept], [parts[k] for k in kept]
        radius = np.array([np.linalg.norm(points[x] - h, axis=1).max() for x, h in zip(parts, heads, strict=True)])
        below = [node(x, h) for x, h in zip(parts, heads, strict=True)]
        return Node(heads, np.linalg.norm(heads - centre, axis=1), (start, start + len(rows)), radius, below)

    centre = points.mean(0)
    root = node(np.arange(len(ids)), centre)
    rows = np.concatenate(order)
    return Tree(root, centre, ids[rows], vectors[rows].astype(np.float64) if exact(most) else vectors[rows])


def search(tree: Tree, query_id: int, q: np.ndarray, most: float, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """(the k best (score, vec_id) of a tree that score at least ``floor``, distances computed). A bound is loosened by the
    rounding of its distances, so none is lost.

    Where the bounds leave out less than half of the tree, the rest of it is scanned at once, page order being of no use.
    """
    x = np.append(q.astype(np.float64), 0.0)
    q = x[:-1].copy() if exact(most) else q
    norm = float((x * x).sum()) + most
    slack = 1e-7 * (1.0 + norm ** 0.5)
    best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
    reach = float("inf") if floor is None else max(norm - 2.0 * floor, 0.0) ** 0.5 + slack
    queue = [(0.0, 0, tree.root, float(np.linalg.norm(x - tree.centre)))]
    n, looked, asked = 0, 1, False
    while queue:
        bound, _, node, d = heapq.heappop(queue)
        if bound > reach:
            break
        low = np.abs(d - node.parent) if node.radius is None else np.abs(d - node.parent) - node.radius
        rows = np.flatnonzero(low <= reach)
        if not len(rows):
            continue
        looked += len(rows)
        if node.children is None:
            a, b = node.span
            scores = (tree.vectors[a:b] if len(rows) == len(low) else tree.vectors[a + rows]) @ q
            ids = tree.ids[a + rows]
            if len(best) == k:
                near = np.flatnonzero((scores > best[0][0]) | ((scores == best[0][0]) & (ids < -best[0][1])))
            else:
                near = np.argsort(-scores, kind="stable") if floor is None else np.flatnonzero(scores >= floor)
            for score, i in zip(scores[near].tolist(), ids[near].tolist(), strict=True):
                if i != query_id and (len(best) < k or (score, -i) > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (int(score), -i))
            if len(best) == k:
                reach = min(reach, max(norm - 2.0 * best[0][0], 0.0) ** 0.5 + slack)
        else:
            away = np.linalg.norm(node.points[rows] - x, axis=1)
            for j, dj in zip(rows.tolist(), away.tolist(), strict=True):
                if (least := max(bound, dj - float(node.radius[j]))) <= reach:
                    n += 1
                    heapq.heappush(queue, (least, n, node.children[j], dj))
        if not asked and reach < float("inf") and queue:
            asked = True
            if 2 * sum(e[2].span[1] - e[2].span[0] for e in queue if e[0] <= reach) >= len(tree.ids):
                scores = np.where(tree.ids == query_id, -np.inf, tree.vectors @ q) if exact(most) else tree.vectors @ q
                ok = np.flatnonzero(tree.ids != query_id)
                least = max(-np.inf if floor is None else floor, np.partition(scores[ok], len(ok) - k)[len(ok) - k] if len(ok) > k else -np.inf)
                ok = ok[scores[ok] >= least]
                ok = ok[np.lexsort((tree.ids[ok], -scores[ok]))][:k]
                return [(int(scores[r]), int(tree.ids[r])) for r in ok], looked + len(tree.ids)
    return sorted(((s, -i) for s, i in best), key=lambda t: (-t[0], t[1])), looked


def pivots_of(points: np.ndarray, n: int) -> np.ndarray:
    """n pivots of sampled points: each the farthest from those before it, then three rounds of means."""
    chosen = [points[0]]
    away = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(points[int(away.argmax())])
        away = np.minimum(away, ((points - chosen[-1]) ** 2).sum(1))
    made = np.array(chosen)
    for _ in range(3):
        near = nearest(points, made)
        made = np.array([points[near == k].mean(0) if (near == k).any() else made[k] for k in range(len(made))])
    return made


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots * pivots).sum(1)[None] - 2 * points @ pivots.T).argmin(1)


def spread(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows (with row_, a number of its own for each) with salt_: no (keys, salt_) has many more than ``most`` rows."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("long").alias("salts_"))
    return rows.join(sizes, keys).withColumn("salt_", F.pmod(F.xxhash64("row_"), F.col("salts_"))).drop("salts_")


def groups(batches: Iterator[pd.DataFrame], keys: list[str], most: int | None = None) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of consecutive rows with equal keys across batches, one at a time; with ``most``, in parts of so many rows."""
    held, n, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        for key, part in batch.groupby(keys, sort=False):
            if held and (key != last or (most and n >= most)):
                yield last, pd.concat(held)
                held, n = [], 0
            last = key
            for at in range(0, len(part), most or len(part)):
                if held and most and n >= most:
                    yield last, pd.concat(held)
                    held, n = [], 0
                held.append(part.iloc[at:at + (most or len(part))])
                n += len(held[-1])
    if held:
        yield last, pd.concat(held)


def stacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows.vec_id.to_numpy(), np.stack(rows.v.to_list()).astype(np.int64)


def index(vectors: DataFrame, scale: float = 256.0, tree: int = TREE, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(quantised rows; trees: a row for each number of components, n_, with M² and the name of the directory file of its trees)."""
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, scale).withColumn("row_", F.monotonically_increasing_id()), "vectors")
    folder = fresh_path(spark, "mtree")
    # squared norms decide M, for each number of components
    norms = saved(rows.groupBy("n_").agg(F.count("*").alias("count_"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("most")), "norms")
    picked = rows.orderBy(F.xxhash64("vec_id"), "row_").limit(SAMPLE).join(norms, "n_").select("n_", "count_", "most", "vec_id", "v").toArrow().to_pandas()  # at most SAMPLE rows
    pivots = {}
    for n, part in picked.groupby("n_"):
        wanted = int(min(PIVOTS, len(part), -(-2 * int(part.count_.iloc[0]) // tree)))
        pivots[n] = pivots_of(lifted(stacked(part.sort_values("vec_id"))[1], float(part.most.iloc[0])), max(1, wanted))
    sent = spark.sparkContext.broadcast(pivots)  # at most SAMPLE vectors

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.zeros(len(batch), dtype=np.int64)
            for (n, most), at in batch.groupby(["n_", "most"]).indices.items():
                if n in sent.value:
                    near[at] = nearest(lifted(stacked(batch.iloc[at])[1], most), sent.value[n])
            yield batch.assign(pivot=near)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for (n, _, _, most), part in groups(batches, ["n_", "pivot", "salt_", "most"]):
            ids, v = stacked(part.sort_values("vec_id", kind="stable"))
            made_tree = build(ids, v, most, page)
            far = float(np.linalg.norm(lifted(v, most) - made_tree.centre, axis=1).max())
            made.append((n, most, kept(folder, made_tree), made_tree.centre, far))
        yield pd.DataFrame(made, columns=["n_", "most", "tree", "centre", "radius"])

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(n, most, kept(folder, (part.tree.tolist(), np.stack(part.centre.to_list()), part.radius.to_numpy()))) for (n, most), part in groups(batches, ["n_", "most"])]
        yield pd.DataFrame(made, columns=["n_", "most", "directory"])

    shape = "n_ int, most double, row_ long, vec_id long, v array<long>, pivot long"
    near = saved(rows.join(norms.select("n_", "most"), "n_").select("n_", "most", "row_", "vec_id", "v").mapInPandas(assign, shape), "assigned")
    keys = ["n_", "pivot", "salt_"]
    trees = saved(spread(near, ["n_", "pivot"], tree).repartition(*keys).sortWithinPartitions(*keys).select(*keys, "most", "vec_id", "v")
                  .mapInPandas(make, "n_ int, most double, tree string, centre array<double>, radius double"), "mtree-names")
    return rows, saved(trees.repartition("n_").sortWithinPartitions("n_", "tree").mapInPandas(direct, "n_ int, most double, directory string"), "directories")


def kept(folder: str, what) -> str:
    """Writes an object as a new file in the shared folder; its name."""
    name = f"{folder}/{uuid.uuid4().hex}"
    with opened(name, "w") as out:
        out.write(pickle.dumps(what))
    return name


def loaded(name: str):
    with opened(name, "r") as stream:
        return pickle.loads(stream.read())


def to_trees(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of queries to the centres of trees."""
    x = np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))


def searched(queries: DataFrame, trees: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each query in every tree that it meets, and looked (distances computed, beside a null vec_id)."""
    spark = queries.sparkSession
    folder = fresh_path(spark, "queries")
    found = "query_id long, vec_id long, score long, looked long, n_ int, most double, directory string, tree string, block string"
    names = [x.split()[0] for x in found.split(", ")]

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for batch in batches:
            made = np.empty(len(batch), dtype=object)
            for name, rows in batch.groupby("directory").indices.items():
                if name != last:
                    last, at = name, loaded(name)
                away = to_trees(stacked(batch.iloc[rows])[1], at[1])
                low = np.maximum(away - at[2][None], 0)
                made[rows] = np.array(at[0], dtype=object)[np.where(low == low.min(1)[:, None], away, np.inf).argmin(1)]
            yield batch.assign(tree=made)

    def rows_of(hits: list[tuple], looked: list[tuple], blocks: list[tuple]) -> pd.DataFrame:
        every = [(q, i, s, None, None, None, None, None, None) for q, i, s in hits] + [(q, None, None, n, None, None, None, None, None) for q, n in looked] + [(None, None, None, None, *b) for b in blocks]
        made = pd.DataFrame(every, columns=names, dtype=object)
        for c in ("query_id", "vec_id", "score", "looked", "n_"):
            made[c] = pd.array(made[c].tolist(), dtype="Int64")
        return made.astype({"most": "float64"})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tree = None, None
        for (n, most, directory, name, _), part in groups(batches, ["n_", "most", "directory", "tree", "salt_"], block):
            if name != last:
                last, tree = name, loaded(name)
            ids, v = stacked(part)
            hits, looked, floors = [], [], []
            for i, q in zip(ids.tolist(), v, strict=True):
                best, m = search(tree, i, q, most, k)
                hits += [(i, j, s) for s, j in best]
                looked.append((i, m))
                floors.append(best[-1][0] if len(best) == k else None)
            yield rows_of(hits, looked, [(n, most, directory, name, kept(folder, (ids, v, floors)))])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The trees that at least one query of a block needs."""
        for batch in batches:
            made = []
            for most, directory, own, name in zip(batch.most, batch.directory, batch.tree, batch.block, strict=True):
                trees_, centres, radius = loaded(directory)
                _, v, floors = loaded(name)
                norm = (v.astype(np.float64) ** 2).sum(1) + most
                reach = np.array([np.inf if f is None else max(x - 2.0 * f, 0.0) ** 0.5 for x, f in zip(norm.tolist(), floors, strict=True)]) + 1e-6 * (1.0 + norm ** 0.5)
                need = (to_trees(v, centres) - radius[None] <= reach[:, None]).any(0)
                made += [(t, most, name) for t, x in zip(trees_, need.tolist(), strict=True) if x and t != own]
            yield pd.DataFrame(made, columns=["tree", "most", "block"])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tree = None, None
        for batch in batches:
            for name, most, block_name in zip(batch.tree, batch.most, batch.block, strict=True):
                if name != last:
                    last, tree = name, loaded(name)
                hits, looked = [], []
                for i, q, floor in zip(*loaded(block_name), strict=True):
                    best, m = search(tree, int(i), q, most, k, floor)
                    hits += [(int(i), j, s) for s, j in best]
                    looked.append((int(i), m))
                yield rows_of(hits, looked, [])

    at_home = saved(queries.join(F.broadcast(trees), "n_").select("n_", "most", "directory", F.monotonically_increasing_id().alias("row_"), "vec_id", "v")
                    .mapInPandas(home, "n_ int, most double, directory string, row_ long, vec_id long, v array<long>, tree string"), "homes")
    keys = ["n_", "tree", "salt_"]
    one = saved(spread(at_home, ["n_", "tree"], 4 * block).repartition(max(8, min(10_000, -(-at_home.count() // 64))), *keys).sortWithinPartitions(*keys).select("n_", "most", "directory", "tree", "salt_", "vec_id", "v").mapInPandas(first, found), "first-round")
    needed = saved(one.where("block is not null").select("most", "directory", "tree", "block").repartition("block").mapInPandas(meet, "tree string, most double, block string"), "needed")
    two = needed.repartition(max(1, min(10_000, needed.count())), "tree", "block").sortWithinPartitions("tree", "block").mapInPandas(second, found)
    return one.where("block is null").unionByName(two).select("query_id", "vec_id", "score", "looked")


def top_k(queries: DataFrame, trees: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """queries (vec_id, v, n_): the k best of each over all trees: query_id, rank, vec_id, score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = searched(queries, trees, k, block).where("vec_id is not null")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, trees = index(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), trees, 5)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
