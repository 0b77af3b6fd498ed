"""Spelling variants grouped under their most frequent form: a rare-first q-gram prefix filter over the vocabulary, in DataFrame functions.

Words come from whole texts, counted with partial sums. All bigrams of the vocabulary are ordered by frequency (then by code points);
the positional bigrams of a word follow that order, equal bigrams by position. One inserted, deleted or replaced code point destroys at most
two bigrams of either word, and the bigrams left keep their order, so the first bigram left of the one word is that of the other and is
among the three rarest of both, at places that differ by one at most. Only the ``PREFIX`` rarest are therefore joined.

A bigram that survived has the change wholly to its right or to its left. In the first case the words agree from their start through
the bigram, in the second from the bigram to their end: that part is the key of the join, which fixes the bigram, its place and the
limit on places together. A key with more than ``HOT`` words is split: its words meet by what is left after one code point
is taken out (or none), which holds at most a word for each place and letter, so no bucket grows with the vocabulary's square. Every candidate
is verified by a bounded edit distance inside the join.

Defined results: a null text has no words; a null doc_id counts as the text ``null`` in the hash; rows that repeat a doc_id each count; ties of n go to
the smallest word by code points; no words give no rows; columns beside doc_id and text are ignored. A run of any length is one word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import lower_ascii, saved, table

LETTERS, MIN_LENGTH, MIN_COUNT, TYPO = r"[A-Za-zÀ-ÿ]", 6, 5, 199
#: Rarest bigrams of a word that are joined: one more than a change can destroy.
PREFIX = 3
#: Words of a key that meet directly, at most.
HOT = 64
#: Times that a form must be as frequent as its variant.
RATIO = 5


def vocabulary(docs: DataFrame, least: int = MIN_COUNT, length: int = MIN_LENGTH, typo: int = TYPO) -> DataFrame:
    """word, n of every word of at least ``length`` letters and ``least`` occurrences; one in ``typo`` runs has a letter taken out first."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id_"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))).alias("run_"))
    low = runs.select("id_", lower_ascii(F.col("run_")).alias("w_"))
    hashed = low.select("w_", F.crc32(F.concat_ws(":", "id_", "w_").cast("binary")).alias("h_"))
    at = (F.col("h_") % F.length("w_")).cast("int")
    cut = F.concat(F.substr("w_", F.lit(1), at), F.substr("w_", at + 2))
    words = hashed.select(F.when(F.col("h_") % typo == 0, cut).otherwise(F.col("w_")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def prefix(words: DataFrame, size: int = PREFIX) -> DataFrame:
    """word, n, place (from 0) of the ``size`` rarest positional bigrams of each word.

    There are no more bigrams than pairs of the alphabet's letters, so their counts are broadcast whatever the vocabulary.
    """
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))
    grams = words.select("word", "n", F.posexplode(places).alias("place", "gram"))
    often = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("c_")))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("c_", "gram", "place"))), 1, size)
    rarest = grams.join(often, "gram").groupBy("word", "n").agg(ranked.alias("p_"))
    return rarest.select("word", "n", F.explode("p_").alias("p_")).select("word", "n", F.col("p_.place").alias("place"))


def keys(rarest: DataFrame) -> DataFrame:
    """key, word, n: the part of the word from its start through a rare bigram, and the part from that bigram to its end."""
    before = F.concat(F.lit("<"), F.substr("word", F.lit(1), F.col("place") + 2))
    after = F.concat(F.lit(">"), F.substr("word", F.col("place") + 1))
    return rarest.select("word", "n", F.explode(F.array(before, after)).alias("key"))


def left_after_one(word):
    """Hashes of the word and of the word without each of its letters."""
    without = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.xxhash64(F.concat(F.substr(word, F.lit(1), i), F.substr(word, i + 2))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), without))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, na, b, nb: words a < b that differ by one inserted, deleted or replaced code point, each pair once."""
    keyed = saved(keys(prefix(words)), "spelling-keys")
    crowded = saved(keyed.groupBy("key").agg(F.count("*").alias("c_")).where(F.col("c_") > hot).select("key"), "spelling-hot")
    few = keyed.join(crowded, "key", "left_anti").select(F.xxhash64("key").alias("k_"), "word", "n")
    many = keyed.join(crowded, "key", "left_semi").select("key", "word", "n", F.explode(left_after_one(F.col("word"))).alias("v_")).select(F.xxhash64("key", "v_").alias("k_"), "word", "n")

    def joined(rows: DataFrame) -> DataFrame:
        a, b = rows.select("k_", F.col("word").alias("a"), F.col("n").alias("na")), rows.select("k_", F.col("word").alias("b"), F.col("n").alias("nb"))
        near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
        return a.join(b, (a["k_"] == b["k_"]) & near).select("a", "na", "b", "nb")

    return joined(few).unionByName(joined(many)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last word that forms lead to.

    A form is several times as frequent as its word, so chains are short and closed ones cannot be; every round halves what is left of them.
    """
    at = saved(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next_"))
        moved = saved(at.join(ahead, "root", "left").select("word", F.coalesce("next_", "root").alias("root"), F.col("next_").isNotNull().alias("moved_")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved_").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = saved(words, "vocabulary")
    pairs = saved(near_pairs(words, hot), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b_"))
    enough = -F.col("b_.m") >= ratio * F.col("n")
    known = saved(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("b_.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("b_.m")).alias("form_n")), "spelling-forms")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: CRC-32 is linear: the value of a text is the exclusive or of what each byte gives at its distance from the end, and of what the start value gives.
ORACLE = r"""
with recursive bits as (select b, b as c, 0 as k from range(256) t(b)
                        union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
t0 as (select b, c from bits where k = 8),
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as times
         from (select coalesce(cast(doc_id as varchar), 'null') as doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) as r from documents) group by all),
hexed as (select *, hex(encode(doc_id || ':' || w)) as x from runs),
far(d, b, c) as (select 0::bigint, b, c from t0
                 union all select far.d + 1, far.b, xor(far.c >> 8, t0.c) from far join t0 on t0.b = (far.c & 255)
                 where far.d < (select max(length(x)) // 2 from hexed)),
start(len, c) as (select 0::bigint, 4294967295 union all select start.len + 1, xor(start.c >> 8, t0.c) from start join t0 on t0.b = (start.c & 255) where start.len < (select max(length(x)) // 2 from hexed)),
bytes as (select doc_id, w, times, length(x) // 2 as len, unnest(range(length(x) // 2)) as i, x from hexed),
summed as (select doc_id, w, any_value(times) as times, len, bit_xor(far.c) as c
           from bytes join far on far.d = len - 1 - i and far.b = cast('0x' || substr(x, 2 * i + 1, 2) as int) group by doc_id, w, len),
hashed as (select w, times, xor(xor(summed.c, start.c), 4294967295) as h from summed join start on start.len = summed.len),
made as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, times from hashed),
words as (select word, cast(sum(times) as bigint) as n from made where length(word) >= 6 group by word having sum(times) >= 5),
cuts as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from (select *, unnest(range(length(word))) as i from words)),
near as (select a.word, b.word as other, b.n as m from cuts a join cuts b on a.v = b.v and a.i = b.i and a.word <> b.word
         union select c.word, w.word, w.n from cuts c join words w on w.word = c.v
         union select w.word, c.word, c.n from cuts c join words w on w.word = c.v),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
top as (select near.word, min(near.other) as other, any_value(near.m) as m from near join best on best.word = near.word and best.m = near.m group by near.word),
forms as (select words.word, n, coalesce(n_near, 0) as n_near, case when top.m >= 5 * n then other end as form, case when top.m >= 5 * n then top.m end as form_n
          from words left join best using (word) left join top using (word)),
walk(word, last, k) as (select word, word, 0 from forms union all select walk.word, forms.form, k + 1 from walk join forms on forms.word = walk.last where forms.form is not null),
ends as (select word, arg_max(last, k) as root from walk group by word)
select forms.word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from forms join ends using (word)"""
