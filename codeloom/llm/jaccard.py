"""N-gram Jaccard join over whole documents: prefix filter, then a prefix tree in each candidate bucket; exact.

1. Every text becomes the sorted set of the fingerprints of its word n-grams; texts of equal sets are one class, whose
   id is a fingerprint of the set. From here on a class counts once, however many copies it has.
2. Sets are ordered by rarity: tokens that many sets have among their candidates for the prefix come last, by class of their
   count (of all documents), ties by value. The order is the same everywhere, so sets that link share one of their
   first n - ceil(t n) + 1 tokens; at most ``ORDERED`` counts are broadcast, which changes the order but not the result.
3. The smallest class with a prefix token leads it; the bucket of a leader holds all classes that it leads by any token. Both ends of a
   link have a token in common and so meet in its leader's bucket. No pairs are made. A member of a bucket that is not split stays there
   only if the size and the sketch of another allow a link: a sketch has the parity of the tokens in each of ``SKETCH`` bits, so where
   sketches differ in more bits than two sets that link differ in tokens, they don't link. Sets that meet by chance go before any is sent.
   Classes that sizes and sketches allow to link, in buckets that are not split, form groups; a group of up to ``BUCKET`` classes is one
   bucket, so a set that is a member of many mostly goes out once. Larger groups keep their buckets.
4. In its bucket a class walks a prefix tree of the sets before it, in the same order everywhere with frequent tokens first: edges hold
   runs of tokens, an overlap counted on the way down is shared by all sets below, and a subtree is left when the tokens that remain
   on either side, or the sizes below, cannot reach the threshold, or when all below are linked with the class already.
   Buckets of more than ``BUCKET`` classes are split into blocks, each of which has the leader. Only classes not linked with the leader
   go on to other blocks, and only to those with which they share a further token: of two sets that link, the first
   n - ceil(t n) + 1 + ``EXTRA`` tokens share 1 + ``EXTRA``, so one is left when the ``EXTRA`` most frequent of the bucket are set aside.
5. The links found (a spanning forest of each bucket) give components by alternating stars.

Fingerprints have 64 bits; two different n-grams or sets are taken for one with a probability of about 2^-64 a pair.

Defined results: null or empty texts have no set, size 0 and are their own component; fewer words than n are one n-gram; rows that
repeat a doc_id are members each; a null doc_id takes part but is never the smallest id (a component of nulls alone has a null
component_id); columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import saved, small_batches, table
from codeloom.llm.graphs import components
from codeloom.llm.hashing import mix, shingle_set, word_hashes

SIZE, PERCENT = 3, 90
#: Token counts that are broadcast; classes of a bucket that one task takes together; tokens of the prefix by which hot buckets are split.
ORDERED, BUCKET, EXTRA = 6_000_000, 300, 2
#: Bits a candidate class has in the filter of them, and bits of the filter at most (64 MB are broadcast).
CLASS_BITS, FILTER_BITS = 16, 1 << 29
#: Bits of a class's sketch. Sets by chance differ in half of them; those of n tokens that link differ in about n / 10 tokens, so sets of up to 4,000 tokens are told apart.
SKETCH = 1_024
#: Bits of the filter of candidates that a fingerprint has, as shifts of it.
SHIFTS = (0, 16, 32)
TOGETHER = 500_000
SEEN = 1_000_000


def class_id(tokens: np.ndarray) -> int:
    """Fingerprint of a sorted set: sums of its mixed tokens, so one pass and no order."""
    with np.errstate(over="ignore"):
        a = mix(tokens).sum(dtype=np.uint64)
        b = mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        return int(mix(np.array([mix(np.array([a ^ np.uint64(len(tokens))]))[0] + b]))[0].view(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Overlap at which sets of n and m tokens link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def sketch(tokens: np.ndarray, size: int = SKETCH) -> list[int]:
    """Parity of the number of tokens in each of ``size`` bits, as whole numbers: two sketches differ in as many bits as their sets differ in tokens, at most."""
    bits = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def wide(tokens: np.ndarray) -> list[int] | None:
    """Sketch of a set that SKETCH bits are too few for: a bit for every two to four tokens, a power of two."""
    return sketch(tokens, 1 << (len(tokens) // 4 - 1).bit_length()) if len(tokens) > 4 * SKETCH else None


def may_link(a, b, percent: int = PERCENT):
    """Whether sizes and sketches of two classes (structs of node, n, sketch) allow a link."""
    both = a["n"] + b["n"]
    apart = both - 2 * F.ceil(percent * both / F.lit(100 + percent))
    differ = sum((F.bit_count(a["sketch"][k].bitwiseXOR(b["sketch"][k])) for k in range(SKETCH // 64)), F.lit(0))
    return (a["node"] != b["node"]) & (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (differ <= apart)


def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        for row, text in zip(batch.row_ if "row_" in batch else batch.doc_id, batch.text, strict=True):
            yield row, shingle_set(word_hashes(text), size)


class _New:
    """Whether a class is new to the task; forgets when full, which costs repeated rows only."""

    def __init__(self):
        self.known: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.known:
            return False
        if len(self.known) >= SEEN:
            self.known.clear()
        self.known.add(node)
        return True


def classes(docs: DataFrame, size: int, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, t_ (hash of the text), n, node of every row of docs; counts: h, c of tokens that several sets have in their candidates
    for the prefix)."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (b.assign(row_=list(zip(b.doc_id, b.t_, strict=True))) for b in batches)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, rows, low, held = _New(), [], [], 0

        def out() -> pd.DataFrame:
            # whole numbers beside nulls: never by way of floats
            whole = lambda k: pd.array([r[k] for r in rows], dtype="Int64")
            made = pd.DataFrame({"doc_id": [r[0][0] for r in rows], "t_": [r[0][1] for r in rows], "n": whole(1), "node": whole(2), "bucket": -1, "keys": None, "counts": None})
            if low:
                keys, counts = np.unique(np.concatenate(low), return_counts=True)
                edge = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets))
                packed = [(k, a.tobytes(), c.astype("<u4").tobytes()) for k, (a, c) in enumerate(zip(np.split(keys, edge), np.split(counts, edge), strict=True)) if len(a)]
                made = pd.concat([made, pd.DataFrame({"doc_id": None, "t_": 0, "n": 0, "node": pd.array([None] * len(packed), dtype="Int64"), "bucket": [p[0] for p in packed], "keys": [p[1] for p in packed], "counts": [p[2] for p in packed]})], ignore_index=True)
            return made

        for row, tokens in _sets(named(batches), size):
            n = len(tokens)
            node = class_id(tokens) if n else None
            rows.append((row, n, node))
            if n and new(node):
                low.append(tokens[:2 * prefix_size(n, percent) + 8])
                held += len(low[-1])
            if held >= TOGETHER or len(rows) >= 50_000:
                yield out()
                rows, low, held = [], [], 0
        if rows:
            yield out()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for k, keys, counts in zip(batch.bucket, batch["keys"], batch["counts"], strict=True):
                found.setdefault(k, []).append((np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4")))
        for parts in found.values():
            keys, at = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            c = np.bincount(at, np.concatenate([b for _, b in parts])).astype(np.int64)
            yield pd.DataFrame({"h": keys[c > 1].view(np.int64), "c": c[c > 1]})

    # ids as text: whole numbers beside nulls never by way of floats
    made = saved(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("t_"), F.col("text").cast("string").alias("text"))
                 .mapInPandas(run, "doc_id string, t_ long, n long, node long, bucket int, keys binary, counts binary").withColumn("doc_id", F.col("doc_id").cast("long")), "classes")
    counts = made.where("bucket >= 0").select("bucket", "keys", "counts").repartition(buckets, "bucket").mapInPandas(merge, "h long, c long")
    return made.where("bucket < 0").select("doc_id", "t_", "n", "node"), saved(counts, "token-counts")


def rarity(counts: DataFrame, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, class of their count), at most ``most``: those of the highest classes that fit."""
    step = F.floor(F.log2("c")).cast("int")
    sizes = counts.groupBy(step.alias("q")).agg(F.count("*").alias("k")).orderBy(F.desc("q")).collect()  # at most 64 rows
    total, least = 0, None
    for r in sizes:
        total += r["k"]
        if total > most:
            break
        least = r["q"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(batch.h.to_numpy(dtype="<i8").tobytes(), batch.q.to_numpy(dtype="u1").tobytes())], columns=["h", "q"])

    # row by row: the driver never holds them as rows
    got = counts.where(step >= least).select("h", step.alias("q")).mapInPandas(pack, "h binary, q binary").toLocalIterator()
    parts = [(np.frombuffer(r["h"], "<u8"), np.frombuffer(r["q"], "u1")) for r in got]
    keys, q = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    order = np.argsort(keys)
    return keys[order], q[order]


def frequencies(tokens: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class of the count of each token, 0 where it is not in the order."""
    keys, q = order
    if not len(keys):
        return np.zeros(len(tokens), dtype=np.uint8)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, q[at], 0).astype(np.uint8)


def prefixes(docs: DataFrame, order, size: int, percent: int) -> DataFrame:
    """node, n (size), p (size of its prefix), all_ (its prefix with EXTRA tokens more does not have 1 + EXTRA of every overlap), tokens (the prefix and
    EXTRA more), sketch, wide of every class, once for each task that meets it; saved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, made, columns = _New(), [], ["node", "n", "p", "all_", "tokens", "sketch", "wide"]
        for _, tokens in _sets(batches, size):
            if not len(tokens) or not new(node := class_id(tokens)):
                continue
            drawn = sketch(tokens), wide(tokens)
            tokens = tokens[np.argsort(frequencies(tokens, order.value), kind="stable")]
            p = prefix_size(len(tokens), percent)
            made.append((node, len(tokens), p, len(tokens) - p < EXTRA, tokens[:p + EXTRA].view(np.int64), *drawn))
            if len(made) >= 5_000:
                yield pd.DataFrame(made, columns=columns)
                made = []
        if made:
            yield pd.DataFrame(made, columns=columns)

    return saved(docs.select("doc_id", "text").mapInPandas(run, "node long, n long, p int, all_ boolean, tokens array<long>, sketch array<long>, wide array<long>"), "prefixes")


def _near(members: DataFrame, first: DataFrame, percent: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(leader, node and what first knows of its size and sketches, a bucket's rows together, of buckets that are not split; leader, node of the others)."""
    sized = members.join(members.groupBy("leader").agg(F.count("*").alias("k")).where("k > 1"), "leader")
    small = sized.where(F.col("k") <= bucket).select("leader", "node")
    known = ["node", *[c for c in ("n", "sketch", "wide") if c in first.columns]]
    drawn = first.select(*known).join(small.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    met = small.join(drawn, "node").groupBy("leader").agg(F.collect_list(F.struct(*known)).alias("all_"))
    near = met.select("leader", F.explode(F.filter("all_", lambda a: F.exists("all_", lambda b: may_link(a, b, percent)))).alias("x")).select("leader", "x.*")
    return near, sized.where(F.col("k") > bucket).select("leader", "node")


def near_members(members: DataFrame, first: DataFrame, percent: int, bucket: int) -> DataFrame:
    """members (leader, node) without those of whose bucket no other may link with them; buckets of more than ``bucket`` classes stay whole."""
    near, hot = _near(members, first, percent, bucket)
    return near.select("leader", "node").unionByName(hot)


def linkable(n: np.ndarray, sketches: list, wides: list, percent: int) -> np.ndarray:
    """Which pairs of sets sizes and sketches allow to link; long sets by the wider sketch that both have."""
    both = n[:, None] + n[None]
    apart = both - 2 * -(-percent * both // (100 + percent))
    words = [np.asarray(x if y is None else y, dtype=np.int64) for x, y in zip(sketches, wides, strict=True)]
    widths = np.array([len(x) for x in words])
    may = 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
    for width in np.unique(widths):
        at = np.flatnonzero(widths >= width)
        # a sketch of more bits is folded to one of fewer
        folded = np.stack([np.bitwise_xor.reduce(words[k].reshape(-1, width)) for k in at])
        close = np.stack([np.bitwise_count((row ^ folded).view(np.uint64)).sum(1) for row in folded]) <= apart[np.ix_(at, at)]
        may[np.ix_(at, at)] &= close | (np.minimum(widths[at][:, None], widths[at][None]) != width)
    return may


def near_groups(members: DataFrame, first: DataFrame, percent: int, bucket: int) -> DataFrame:
    """leader, node of groups instead of buckets. The classes of a bucket that is not split fall into parts that sizes and sketches allow to link inside. A class
    takes the smallest of its parts' names, a part the smallest of its classes, and parts of one name are one group. As a part stays together, no link is lost.
    Parts of groups of more than ``bucket`` classes keep the rows of their buckets, and split buckets stay whole."""
    near, hot = _near(members, first, percent, bucket)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for (leader,), g in _groups(batches, ["leader"]):
            may, nodes = linkable(g.n.to_numpy(), g.sketch.tolist(), g.wide.tolist(), percent), g.node.to_numpy()
            np.fill_diagonal(may, True)
            name, most = nodes, np.iinfo(np.int64).max
            while (low := np.where(may, name[None], most).min(1)).tolist() != name.tolist():
                name = low
            made.append(pd.DataFrame({"leader": leader, "part": name, "node": nodes})[may.sum(1) > 1])
            if len(made) >= 1_000:
                yield pd.concat(made)
                made = []
        if made:
            yield pd.concat(made)

    parts = saved(near.mapInPandas(run, "leader long, part long, node long"), "near-parts")
    least = parts.join(parts.groupBy("node").agg(F.min("part").alias("least")), "node").groupBy("leader", "part").agg(F.min("least").alias("least"))
    named = saved(parts.join(least, ["leader", "part"]), "near-groups")
    sizes = named.groupBy("least").agg(F.count_distinct("node").alias("k"))
    # a name of its own, so that a group is never taken for a bucket
    group = F.when(F.col("k") <= bucket, F.xxhash64(F.lit("group"), "least")).otherwise(F.col("leader"))
    return named.join(sizes, "least").select(group.alias("leader"), "node").unionByName(hot).distinct()


def node_filter(nodes: DataFrame) -> np.ndarray:
    """Bits for every node's fingerprint, by its shifts modulo the size, which follows the number of nodes; a false hit costs a set that no bucket asks for."""
    size = 1 << 15
    n = nodes.count()
    while size < min(CLASS_BITS * n, FILTER_BITS):
        size *= 2
    at = F.col("at") + 1
    made = np.zeros(size // 8, dtype=np.uint8)
    each = nodes.select(F.explode(F.array(*[F.pmod(F.shiftright("node", s), F.lit(size)) for s in SHIFTS])).alias("at"))
    parts = each.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for r in parts.toLocalIterator():  # at most FILTER_BITS bits, 4 KiB a row
        made[(r["k"] - 1) * 4096:r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return made


def candidate_sets(docs: DataFrame, nodes: DataFrame, order, size: int) -> DataFrame:
    """node, tokens (binary, sorted), q (binary, classes of their counts) of the classes of nodes, with the other columns of nodes."""
    sent = docs.sparkSession.sparkContext.broadcast(node_filter(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, bits, made, held = _New(), sent.value, [], 0
        for _, tokens in _sets(batches, size):
            if not len(tokens):
                continue
            node = class_id(tokens)
            if all(bits[at >> 3] >> (at & 7) & 1 for at in ((node >> s) % (8 * len(bits)) for s in SHIFTS)) and new(node):
                made.append((node, tokens.tobytes(), frequencies(tokens, order.value).tobytes()))
                held += len(tokens)
                if held >= TOGETHER:
                    yield pd.DataFrame(made, columns=["node", "tokens", "q"])
                    made, held = [], 0
        if made:
            yield pd.DataFrame(made, columns=["node", "tokens", "q"])

    sets = docs.select("doc_id", "text").mapInPandas(run, "node long, tokens binary, q binary")
    return sets.join(nodes, "node").dropDuplicates(["node"])


class _Tree:
    """A node of the prefix tree: a run of tokens, then sets that end here and children by their first token."""

    __slots__ = ("children", "ends", "largest", "run", "smallest", "tail", "who")

    def __init__(self, run: np.ndarray, n: int, who: int):
        self.run, self.children, self.ends = run, {}, []
        self.smallest = self.largest = n
        self.tail = 0  # most tokens below this run
        self.who: int | None = who  # a member, if all below are linked with it


class Linker:
    """Prefix tree of sets (arrays of token ranks, ascending) with the components of its members."""

    def __init__(self, ranks: int, percent: int):
        self.percent, self.parent, self.sizes, self.root = percent, [], [], {}
        self.has = np.zeros(ranks, dtype=bool)
        self.edges: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = a = self.parent[self.parent[a]]
        return a

    def join(self, a: int, b: int) -> None:
        if (x := self.find(a)) != (y := self.find(b)):
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def member(self, n: int) -> int:
        self.parent.append(len(self.parent))
        self.sizes.append(n)
        return len(self.parent) - 1

    def probe(self, me: int, s: np.ndarray) -> None:
        """Links ``me`` with every component of the tree that has a member similar to s."""
        n = len(s)
        least, most = -(-self.percent * n // 100), 100 * n // self.percent
        self.has[s] = True
        stack = [(t, 0) for f, t in self.root.items() if not self.has[f]] + [(t, 0) for f, t in self.root.items() if self.has[f]]
        while stack:
            t, overlap = stack.pop()
            if t.largest < least or t.smallest > most or (t.who is not None and self.find(t.who) == self.find(me)):
                continue
            overlap += int(np.count_nonzero(self.has[t.run]))
            ahead = n - int(np.searchsorted(s, t.run[-1], side="right"))
            if overlap + min(t.tail, ahead) < needed(n, max(t.smallest, least), self.percent):
                continue
            for k in t.ends:
                if overlap >= needed(n, self.sizes[k], self.percent):
                    self.join(k, me)
            off = [(c, overlap) for f, c in t.children.items() if not self.has[f]]
            stack += off
            stack += [(c, overlap) for f, c in t.children.items() if self.has[f]]
        self.has[s] = False

    def insert(self, me: int, s: np.ndarray) -> None:
        n, at, level = len(s), 0, self.root
        while True:
            t = level.get(int(s[at]))
            if t is None:
                t = level[int(s[at])] = _Tree(s[at:], n, me)
                t.ends.append(me)
                return
            k = min(len(t.run), n - at)
            differ = np.flatnonzero(t.run[:k] != s[at:at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(t.run):  # split the run
                top = _Tree(t.run[:same], t.smallest, t.who if t.who is not None else me)
                top.who, top.smallest, top.largest, top.tail = t.who, t.smallest, t.largest, t.tail + len(t.run) - same
                t.run = t.run[same:]
                top.children[int(t.run[0])] = t
                level[int(s[at])] = t = top
            t.smallest, t.largest, t.tail = min(t.smallest, n), max(t.largest, n), max(t.tail, n - at - same)
            if t.who is not None and self.find(t.who) != self.find(me):
                t.who = None
            at += same
            if at == n:
                t.ends.append(me)
                return
            level = t.children


def link(sets: list[np.ndarray], classes_: list[np.ndarray], percent: int, hosts: int | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """(links: a spanning forest as index pairs, root of each set). Tokens stand in the tree by class of their count, frequent ones first, then by
    value: paths part late. With ``hosts``, only links between the first ``hosts`` sets and the others are looked for."""
    flat = np.concatenate(sets)
    keys, first, at = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.lexsort((keys, -np.concatenate(classes_)[first].astype(np.int64)))] = np.arange(len(keys))
    ranked = [np.sort(x) for x in np.split(rank[at], np.cumsum([len(s) for s in sets])[:-1])]
    made = Linker(len(keys), percent)
    for s in sets:
        made.member(len(s))
    inside = len(sets) if hosts is None else hosts
    for k in sorted(range(inside), key=lambda k: len(sets[k])):
        if hosts is None:
            made.probe(k, ranked[k])
        made.insert(k, ranked[k])
    for k in range(inside, len(sets)):
        made.probe(k, ranked[k])
    return made.edges, [made.find(k) for k in range(len(sets))]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of consecutive rows with equal keys, across batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[a].tolist())
            if held and key != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
            last = key
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def _unpacked(g: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, "<u8") for x in g.tokens], [np.frombuffer(x, "u1") for x in g.q]


def bucket_links(members: DataFrame, sets: DataFrame, first: DataFrame, percent: int, bucket: int, parts: int) -> DataFrame:
    """Links a, b found in the buckets of members (leader, node); sets say whether a class is in a split bucket (hot)."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("k"))
    hot = saved(sizes.where(F.col("k") > bucket).select("leader", F.ceil(F.col("k") / bucket).cast("int").alias("blocks")), "hot-buckets")
    many = members.join(sizes.where("k > 1").select("leader"), "leader", "left_semi").join(hot, "leader", "left").select("leader", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the leader is in every block of its bucket
    dealt = many.withColumn("block", F.explode(F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    full = dealt.join(sets, "node").select("leader", "block", "blocks", "node", "tokens", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, apart = [], []
        for (leader, block), g in _groups(batches, ["leader", "block"]):
            nodes = g.node.tolist()
            edges, roots = link(*_unpacked(g), percent)
            made += [(nodes[a], nodes[b], None, None) for a, b in edges]
            if g.blocks.iloc[0] > 1:
                root = roots[nodes.index(leader)]
                apart += [(leader, n, block, int(g.blocks.iloc[0])) for n, r in zip(nodes, roots, strict=True) if r != root]
            if len(made) + len(apart) > 50_000:
                yield _edge_rows(made, apart)
                made, apart = [], []
        yield _edge_rows(made, apart)

    found = saved(full.repartition(parts, "leader", "block").sortWithinPartitions("leader", "block")
                  .select("leader", "block", "blocks", "node", "tokens", "q").mapInPandas(run, "a long, b long, block int, blocks int"), "links")
    links = found.where("block is null").select("a", "b")
    if not hot.count():
        return links
    apart = found.where("block is not null").select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("block").alias("home"), "blocks")
    visits = further_blocks(dealt.where("blocks > 1").select("leader", "node", "block"), apart, first)
    split = sets.where("hot")
    probes = visits.join(split, "node").select("leader", "block", "node", "tokens", "q", F.lit(True).alias("probe"))
    hosts = (dealt.where("blocks > 1").join(split, "node").join(visits.select("leader", "block").distinct(), ["leader", "block"], "left_semi")
             .select("leader", "block", "node", "tokens", "q", F.lit(False).alias("probe")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ordered by block, its hosts before its probes, which come so many at a time."""
        for _, g in _groups(batches, ["leader", "block"]):
            own, others = g[~g.probe], g[g.probe]
            for at in range(0, len(others), bucket):
                both = pd.concat([own, others.iloc[at:at + bucket]])
                nodes = both.node.tolist()
                edges, _ = link(*_unpacked(both), percent, len(own))
                yield pd.DataFrame([(nodes[a], nodes[b]) for a, b in edges], columns=["a", "b"], dtype="int64")

    more = (hosts.unionByName(probes).repartition(parts, "leader", "block").sortWithinPartitions("leader", "block").mapInPandas(meet, "a long, b long"))
    return links.unionByName(saved(more, "more-links"))


def further_blocks(dealt: DataFrame, apart: DataFrame, first: DataFrame) -> DataFrame:
    """leader, node, block: the blocks of its bucket, besides its home, that a class apart from the leader shares a token with, the EXTRA most frequent tokens
    of the bucket set aside; all other blocks where its set is too small for that."""
    nodes = dealt.select("node").distinct()
    own = first.select("node", "all_", "tokens").join(F.broadcast(nodes) if nodes.count() <= 500_000 else nodes, "node", "left_semi")
    prefix = own.dropDuplicates(["node"])
    each = saved(dealt.join(prefix, "node").select("leader", "node", "block", "all_", F.explode("tokens").alias("h")), "hot-tokens")
    counts = each.groupBy("leader", "h").agg(F.count_distinct("node").alias("c"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("c"), "h"))).where(F.col("r") <= EXTRA).select("leader", "h")
    kept = each.join(F.broadcast(top) if top.count() <= 100_000 else top, ["leader", "h"], "left_anti")
    asked = apart.join(each.select("leader", "node", "all_").distinct(), ["leader", "node"])
    shared = (kept.join(asked.where("not all_").select("leader", "node", "home"), ["leader", "node"]).select("leader", "h", "node", "home")
              .join(kept.select("leader", "h", F.col("block").alias("other")).distinct(), ["leader", "h"]).select("leader", "node", "home", "other"))
    every = asked.where("all_").select("leader", "node", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # a set too small for the lemma may also be the other side, so classes apart visit the blocks that have one
    small = each.where("all_").select("leader", F.col("block").alias("other")).distinct()
    beside = asked.where("not all_").select("leader", "node", "home").join(small, "leader")
    return saved(shared.unionByName(every).unionByName(beside).where("other <> home").select("leader", "node", F.col("other").alias("block")).distinct(), "visits")


def _edge_rows(made: list[tuple], apart: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made + apart, columns=["a", "b", "block", "blocks"]).astype({"a": "int64", "b": "int64", "block": "Int32", "blocks": "Int32"})


def members_of(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bucket: int = BUCKET, ordered: int = ORDERED) -> DataFrame:
    """doc_id, t_ (hash of the text), n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with small_batches(spark, 500):  # a task's Python holds few whole texts or sets at a time
        rows, counts = classes(docs, size, percent, parts)
        docs = docs.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text"))
        order = spark.sparkContext.broadcast(rarity(counts, ordered))
        first = prefixes(docs, order, size, percent)
        tokens = first.select("node", F.explode(F.slice("tokens", 1, F.col("p"))).alias("h"))
        leaders = tokens.groupBy("h").agg(F.min("node").alias("leader"), F.max("node").alias("last_")).where("leader <> last_").drop("last_")
        members = saved(tokens.join(leaders, "h").select("leader", "node").distinct(), "members")
        members = saved(near_groups(members, first, percent, bucket), "near-members")
        sizes = members.groupBy("leader").agg(F.count("*").alias("k"))
        nodes = saved(members.join(sizes, "leader").groupBy("node").agg(F.max(F.col("k") > bucket).alias("hot")), "candidates")
        sets = saved(candidate_sets(docs, nodes, order, size), "sets")
        links = bucket_links(members, sets, first, percent, bucket, parts)
        order.unpersist()
        roots = components(links)
    kinds = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = kinds.join(roots, "node", "left")
    whole = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("all_"))
    mapped = joined.join(whole, "root", "left").select("node", F.coalesce("all_", "least").alias("component_id"))
    return rows.join(mapped, "node", "left").select("doc_id", "t_", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bucket: int = BUCKET, ordered: int = ORDERED) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return members_of(docs, size, percent, bucket, ordered).drop("t_")


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their component; equal rows of one id once. Where rows repeat
    a doc_id, each is judged by its own text. Rows without an id cannot be named by a component and stay."""
    ids = members_of(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id_"), F.col("t_").alias("kept_t_")).distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    kept = named.join(ids, (named["doc_id"] == ids["kept_id_"]) & (F.xxhash64(named["text"]) == ids["kept_t_"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where(docs["doc_id"].isNull()))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents") -> str:
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {docs}),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                          else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from w),
n as (select doc_id, len(g) as n from s),
t as (select doc_id, unnest(g) as t from s),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as i from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
both_ways as (select a, b from link union all select b, a from link),
reach as (select a as doc_id, b as other from both_ways union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other)
select n.doc_id, cast(n.n as bigint) as n_shingles, least(n.doc_id, coalesce(min(reach.other), n.doc_id)) as component_id
from n left join reach on reach.doc_id = n.doc_id group by n.doc_id, n.n"""


ORACLE = oracle()
