"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole documents, in DataFrame functions only.

A benchmark item gives its windows of ``WINDOW`` consecutive words (an item of fewer, but not none, is one window). The tokens
of a window are its word shingles of ``SHINGLE`` words. A window occurs only where all of its tokens do, so the ``PREFIX`` rarest are
taken as its prefix: all shingles of the benchmark are counted in the whole corpus first. Then each text's shingles meet the
prefix tokens, the token's place in the window bounds where the window may start and end, and a start that not all tokens of the
prefix agree on is left. These candidates, numbers alone, are gathered by text (a text is named by 128 bits of hash, so copies share
theirs), meet their text once, and the words at each are compared with the window's own inside that one row. No row of
a position carries the text, so work and memory grow in proportion to the text's length.

The benchmark's shingles and windows are broadcast up to ``BROADCAST_BYTES``, measured first; beyond that the joins are by shuffle on
hashes (split by AQE where one is hot). A bitmap of the texts that have candidates, of at most 16 MiB, is broadcast: only those texts are
shuffled, copies as one, to meet their candidates. Counts are summed per task before their shuffle.

Defined results: a null text has no words; an item without words or with a null id has no window; equal windows of several
items count for each; rows that repeat a doc_id are judged each by its own text, also by ``clean``; a null doc_id keeps its row;
without items every document is clean; columns beside doc_id, text and item_id, text are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import lower_ascii, saved, table

WINDOW, SHINGLE = 13, 3
#: Rarest tokens of a window that a place must have before words are compared.
PREFIX = 2
#: Bytes of a table that is broadcast, at most, as text.
BROADCAST_BYTES = 16 << 20
#: Bits of the bitmap of texts with candidates, at most (16 MiB), and of one of its rows.
MARK_BITS, MARK_BLOCK = 1 << 27, 1 << 15
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(col):
    """Words of a text: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(col, F.lit(""))), NOT_WORD), "")


def shingle(arr, at, size: int):
    return F.xxhash64(*[F.get(arr, at + j) for j in range(size)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window (array of words), len_."""
    w = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    length = F.least(F.col("n"), F.lit(window))
    each = F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda at: F.slice("w", at, length))
    return w.select("item_id", length.alias("len_"), F.explode(each).alias("window")).distinct()


def tokens(win: DataFrame, size: int) -> DataFrame:
    """All shingles of windows: win's columns with h, offset_, k_ (words in the shingle: size, or a shorter window's length)."""
    def of(k: int) -> DataFrame:
        own = win.where(F.col("len_") >= size) if k == size else win.where(F.col("len_") == k)
        places = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len_") - k), lambda i: shingle(F.col("window"), i, k)))
        return own.select(*win.columns, F.lit(k).alias("k_"), places.alias("offset_", "h"))

    made = of(1)
    for k in range(2, size + 1):
        made = made.unionByName(of(k))
    return made


def text_keys(text) -> list:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("t1_"), F.xxhash64(F.lit(7), text).alias("t2_")]


KEY = ["t1_", "t2_"]


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """KEY, n_ (words of the text) with pos_, h, k_ of every shingle of each text.

    The number of words is a field of what is exploded: a column beside the explode would keep the array of words on every row.
    """
    texts = docs.select(*text_keys(F.col("text")), words(F.col("text")).alias("w"))
    made = None
    for k in sizes:
        hashes = F.transform("w", lambda _, i: F.struct(shingle(F.col("w"), i, k).alias("h"), F.size("w").alias("n_")))  # noqa: B023  expanded at once
        own = texts.select(*KEY, F.posexplode(hashes).alias("pos_", "s_")).select(*KEY, "s_.n_", "pos_", "s_.h", F.lit(k).alias("k_"))
        made = own if made is None else made.unionByName(own)
    return made


def small(df: DataFrame, most: int) -> DataFrame:
    """A saved table, to be broadcast where it has no more than ``most`` bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def marked(texts: DataFrame, keys: DataFrame, most: int = MARK_BITS) -> DataFrame:
    """The rows of texts whose key may be one of keys: a bitmap of key hashes, 16 bits a key and ``most`` at most, is broadcast, so that
    texts without a candidate stay where they were read. What the bitmap lets through by chance goes in the join that follows."""
    bits = min(most, max(MARK_BLOCK, 1 << (16 * keys.count() - 1).bit_length()))
    at = lambda: F.pmod(F.col("t1_"), F.lit(bits))
    maps = keys.select(at().alias("b_")).groupBy((F.col("b_") / MARK_BLOCK).cast("long").alias("block_")).agg(F.bitmap_construct_agg(F.col("b_") % MARK_BLOCK).alias("map_"))
    own = texts.withColumn("b_", at() % MARK_BLOCK).withColumn("block_", ((at() - F.col("b_")) / MARK_BLOCK).cast("long"))
    byte = F.conv(F.hex(F.substr("map_", (F.col("b_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(b_ % 8 as int))")
    return own.join(F.broadcast(maps), "block_").where(byte.bitwiseAND(bit) != 0).select(*texts.columns)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(occurrences: KEY, found (array of start_, len_, window_id) of every text with any; membership: window_id, item_id), both saved."""
    owned = saved(windows(benchmark, window), "item-windows")
    win = saved(owned.select("window", "len_").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    member = saved(owned.join(win, ["window", "len_"]).select("window_id", "item_id"), "window-items")
    every = tokens(win, size)
    sizes = [r[0] for r in every.select("k_").distinct().orderBy("k_").collect()] or [size]  # at most SHINGLE rows
    known = small(saved(every.select("k_", "h").distinct(), "shingles"), broadcast_bytes)
    counts = positions(docs, sizes).select("k_", "h").join(known, ["k_", "h"], "left_semi").groupBy("k_", "h").agg(F.count("*").alias("c_"))
    order = F.struct(F.coalesce("c_", F.lit(0)).alias("c"), F.col("h").alias("h"), F.col("offset_").alias("o"))
    rarest = every.join(counts, ["k_", "h"], "left").groupBy("window_id", "len_", "k_").agg(F.slice(F.array_sort(F.collect_list(order)), 1, PREFIX).alias("p"))
    prefix = saved(rarest.select("window_id", "len_", "k_", F.expr("shiftleft(1, size(p)) - 1").alias("all_"), F.posexplode("p").alias("i_", "p"))
                   .select("window_id", "len_", "k_", "all_", F.expr("shiftleft(1, i_)").alias("bit_"), F.col("p.h").alias("h"), F.col("p.o").alias("offset_")), "prefix")
    start = F.col("pos_") - F.col("offset_")
    near = (positions(docs, sizes).join(small(prefix, broadcast_bytes), ["k_", "h"]).where((start >= 0) & (start + F.col("len_") <= F.col("n_")))
            .groupBy(*KEY, "window_id", "all_", start.alias("start_")).agg(F.bit_or("bit_").alias("bits_")).where("bits_ = all_")
            .groupBy(*KEY, "window_id").agg(F.collect_list("start_").alias("starts")))
    asked = saved(near.join(small(win, broadcast_bytes), "window_id").groupBy(*KEY).agg(F.collect_list(F.struct("window_id", "window", "len_", "starts")).alias("asked")), "candidates")
    few = marked(docs.select(*text_keys(F.col("text")), "text"), asked).groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = few.join(asked, KEY).select(*KEY, words(F.col("text")).alias("w"), "asked")

    def same(x):
        got = F.filter(x["starts"], lambda s: F.slice(F.col("w"), s + 1, x["len_"]) == x["window"])
        return F.transform(got, lambda s: F.struct(s.alias("start_"), x["len_"].alias("len_"), x["window_id"].alias("window_id")))

    found = texts.select(*KEY, F.flatten(F.transform("asked", same)).alias("found")).where(F.size("found") > 0)
    return saved(found, "hits"), member


def covered(found) -> object:
    """Positions inside any occurrence: spans in order, each adds what lies beyond those before it."""
    spans = F.array_sort(F.transform(found, lambda x: F.struct(x["start_"].alias("s"), (x["start_"] + x["len_"]).alias("e"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, none, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """KEY, n_hit, items (ids as strings, sorted) of every text in which a window occurs; saved."""
    found, member = hits(docs, benchmark, window)
    each = found.select(*KEY, F.explode(F.array_distinct(F.transform("found", lambda x: x["window_id"]))).alias("window_id"))
    items = each.join(member, "window_id").groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return saved(found.select(*KEY, covered(F.col("found")).alias("n_hit")).join(items, KEY), "judged")


def is_bad(n_hit, n_words, share: int):
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: hit words are at least 1 in ``share``."""
    own = docs.select("doc_id", *text_keys(F.col("text")), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n, got = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return own.join(judged(docs, benchmark, window), KEY, "left").select(
        "doc_id", "n_words", n.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ","), 256).alias("items_sha256"), is_bad(n, F.col("n_words"), share).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not contaminated."""
    found = judged(docs, benchmark, window).select(F.col("t1_").alias("hit1_"), F.col("t2_").alias("hit2_"), "n_hit")
    first, second = text_keys(docs["text"])
    words_of = F.size(words(docs["text"]))
    return docs.join(found, (first == found["hit1_"]) & (second == found["hit2_"]) & is_bad(found["n_hit"], words_of, share), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(docs: str = "documents") -> str:
    word = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {word} as w from {docs}),
b as (select item_id, {word} as w from benchmark where item_id is not null),
win as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') as s
        from (select *, unnest(range(1, len(w) - l + 2)) as i from (select *, least(len(w), 13) as l from b where len(w) > 0))),
lens as (select distinct l from win),
pos as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') as s
        from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, lens where len(w) >= l)),
hit as (select distinct pos.doc_id, pos.i, pos.l, win.item_id from pos join win on pos.l = win.l and pos.s = win.s),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids
       from (select distinct doc_id, cast(item_id as varchar) as x from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join n on n.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""


ORACLE = oracle()
