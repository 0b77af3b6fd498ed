"""Each corpus operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import decontaminate, hashing, jaccard, language, language_model, mtree, packing, quality, sharding, toxicity, warc

DOC = "doc_id long, text string, lang string, h long, node string, slot string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in texts], DOC)


def test_word_hashes_are_of_words():
    a, b = hashing.word_hashes("The  cat\tSAT é"), hashing.word_hashes("the cat sat é")
    assert (a == b).all() and len(set(a.tolist())) == 4
    assert len(hashing.word_hashes(None)) == len(hashing.word_hashes(" \n")) == 0
    long = " ".join(f"w{i}" for i in range(400_000))
    assert len(set(hashing.word_hashes(long).tolist())) == 400_000
    assert len(hashing.word_hashes("x" * 3_000_000)) == 1


def sets_of(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute_components(texts, size, percent):
    s = {i: sets_of(t, size) for i, t in texts}
    root = {i: i for i in s}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    out, common = [], [word() for _ in range(40)]
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(30, 200)))]
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 8))):
                own[int(rng.integers(len(own)))] = word()
            out.append(" ".join(own + (common if g % 2 else [])))
    return list(enumerate([*out, "", None, "one", "One", "two words", out[0], out[0].upper()]))


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_jaccard_equals_brute_force(spark, bucket):
    texts = near_copies()
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts), size, percent, bucket=bucket).collect()}
        assert got == brute_components(texts, size, percent)


def test_jaccard_of_nothing_and_repeats(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    got = [tuple(r) for r in jaccard.jaccard_components(docs(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t")])).collect()]
    assert Counter(got) == Counter([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 2, None)])


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(20))
    texts = [(1, "x " * 10 + item.upper() + " y"), (2, " ".join(f"w{i}" for i in range(12))), (3, None), (4, ""), (5, "z hello, World z"), (6, "w0 " + item + " " + item), (None, item), (6, "clean text")]
    bench = spark.createDataFrame([(7, item, 1), (8, "hello world", 2), (9, "", 3), (None, item, 4), (10, None, 5), (11, item, 6)], "item_id long, text string, t_ int")
    for most in (32 << 20, 0):  # broadcast, and by shuffle
        found, member = decontaminate.hits(docs(spark, texts), bench, broadcast_bytes=most)
        starts = {t: {x.start_ for x in r.found if x.len_ == 13} for r in found.collect() for t in [(r.t1_, r.t2_)]}
        keys = {r.text: (r.t1_, r.t2_) for r in docs(spark, texts).select("text", *decontaminate.text_keys("text")).collect()}
        assert {1: starts[keys[texts[0][1]]] >= {10, 17}, 6: 1 in starts[keys[texts[5][1]]], None: 0 in starts[keys[item]]} == {1: True, 6: True, None: True}
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {(1, 31): (20, 2, True), (2, 12): (0, 0, False), (3, 0): (0, 0, False), (4, 0): (0, 0, False), (5, 4): (2, 1, True), (6, 41): (40, 2, True), (None, 20): (20, 2, True), (6, 2): (0, 0, False)}
    assert decontaminate.decontaminate(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_packing(spark):
    texts = [(1, "Hello, world!"), (2, None), (3, ""), (4, "word " * 9_000), (5, "a b c"), (5, "a b c"), (None, "it's ’ fine")]
    got = packing.pack(docs(spark, texts), with_ids=True).collect()
    enc = packing.WordEncoder(packing.vocabulary())
    want = Counter()
    for i, t in texts:
        ids = np.frombuffer(enc.encode(t or ""), "<u4").tolist() + [1]
        want.update((i, k, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(1)
    counts = Counter(int(x) for x in rng.integers(1, 64, 3_000))
    made = packing.plan(counts, 64)
    assert sum((Counter({k: v * n for k, v in Counter(p).items()}) for p, n in made), Counter()) == counts
    assert all(sum(p) <= 64 for p, _ in made)
    assert sum(n for _, n in made) <= 1.01 * sum(k * v for k, v in counts.items()) / 64 + 1
    assert packing.plan({}, 64) == []


def test_packing_plan_tries_every_first_length_of_a_triple():
    counts = dict.fromkeys([600, 160, 165, 175, *range(401, 471)], 1)  # below the gap of 500, 175 is the 71st length
    assert packing.plan(counts, 1100)[0] == ((600, 175, 165, 160), 1)
    rng = np.random.default_rng(2)
    counts = Counter(int(x) for x in rng.integers(1, 260, 2_000))
    made = packing.plan(counts, 700)
    assert sum((Counter({k: v * n for k, v in Counter(p).items()}) for p, n in made), Counter()) == counts
    left = counts.copy()
    for pattern, n in made:  # where a triple fills the gap after the first length, the pattern is full
        one = left - Counter(pattern[:1])
        gap, have = 700 - pattern[0], sorted(one)
        exact = any(one - Counter((a, b, gap - a - b)) + Counter((a, b, gap - a - b)) == one for a in have for b in have if a >= b >= gap - a - b > 0)
        assert sum(pattern) == 700 or not exact
        left -= Counter({k: v * n for k, v in Counter(pattern).items()})


def test_encoder_equals_tokenizer():
    e = packing.WordEncoder(packing.vocabulary())
    odd = ["it's I'll 'still ' a_b x²½ İstanbul Σς <|endoftext|>a é é x y z\x1cq \x85 a\x00b", "", "中文 test123 4½", "ŉa 'S we'RE 'll've", "a\x0bb\x0cc\td"]
    assert [list(e.texts([t]))[0] for t in odd] == [e.encode(t) for t in odd]


def test_warc_round_trip(spark):
    body = "<p>é\r\n\r\n" + "x" * 3_000_000
    pages = spark.createDataFrame([(1, "http://a", "same", 0), (2, "http://b", "same", 0), (3, None, None, 0), (4, "http://c", "", 0), (5, "http://d", body, 0), (2, "http://b", "same", 0), (None, "u", "same", 0)], "page_id long, url string, html string, refers_to int")
    manifest = warc.write_archives(warc.plan_records(pages), warc.fresh_path(spark, "t"), roll_bytes=500)
    got = warc.read_archives(spark, manifest, with_payload=True).collect()
    text = {1: "same", 2: "same", 3: "", 4: "", 5: body, None: "same"}
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None)])
    for r in got:
        data = text[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == warc.digest(data) and (r.record_type == "revisit" or bytes(r.payload) == data)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_rejects_damage():
    data = warc.zlib.decompress(warc.record(1, "u", b"payload", None), 31)
    assert warc.read_record(data)["payload"] == b"payload"
    for bad in (data.replace(b"payload\r\n", b"pAyload\r\n"), data[:-1]):
        with pytest.raises(ValueError):
            warc.read_record(bad)


def test_mtree_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 6)).astype("f4")
    v[100:300] = v[100]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (950, [float("nan")] * 6, 0), (1000, [1.0, 2.0], 0), (1001, [3.0, 4.0], 0), (1002, [], 0)]
    q, trees = mtree.index(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_ int"), tree=200, page=16)
    got = {}
    for r in mtree.top_k(q.where("vec_id % 50 = 0"), trees, 5, block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    z = np.floor(256 * v.astype("f8")).astype("i8")
    for i in range(0, 700, 50):
        s = z @ z[i]
        want = [(k + 1, int(j), int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(700), -s)) if j != i][:5])]
        assert sorted(got[i]) == want
    assert got[1000] == [(1, 1001, 256 * 256 * 11)] and 950 not in got


def test_language_model_counts(spark):
    texts = [(i, t) for i, t in enumerate(["a b c a", "A b", None, "", "x y z " * 50, "a b c a", "new words here"] * 4)] + [(None, "a b")]
    got = sorted(language_model.score_documents(docs(spark, texts), head=2, buckets=16).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tok = [[*(t or "").lower().split(), None] for _, t in texts]
    c = Counter(w for (i, _), t in zip(texts, tok, strict=True) if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for r, (i, _), t in zip(got, texts, tok, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, held(i))
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score <= 0
    rounds = {(r.doc_id, round(r.score, 9)) for r in language_model.score_documents(docs(spark, texts), head=2, buckets=16, max_bytes=8).collect()}
    assert {i for i, _ in rounds} == {i for i, _ in texts}
    assert language_model.score_documents(docs(spark, [])).count() == 0


def brute_scores(texts, buckets):
    """Scores by loops over all tokens, with the weights that every training document gives; filters are made from exact counts."""
    lm = language_model
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % lm.MOD == lm.HELD
    toks = [lm.tokens(x) for _, x in texts]
    grams = [lm.pairs(x, np.array([0])) for x in toks]
    train = [k for k, (i, _) in enumerate(texts) if not held(i)]
    made = []
    for parts in ([toks[k] for k in train], [grams[k][1] for k in train]):
        keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = lm.Filters(buckets, {}).bucket(keys)
        made.append((lm.Filters(buckets, {int(b): lm.bloom(keys[at == b], lm.level(counts[at == b])).tobytes() for b in set(at)}), counts.sum(), len(keys)))
    (words, n, v), (pair, _, _) = made

    def seen(k, less):
        first, q, own = (lm.RESTORED[f.levels(x)] for f, x in ((words, grams[k][0]), (pair, grams[k][1]), (words, toks[k])))
        ratio = [min(max(c - less, 0) / (f - less), 1.0) if f > less else 0.0 for c, f in zip(q, first, strict=True)]
        return words.levels(grams[k][0]), np.array(ratio), (np.maximum(own - less, 0) + 0.5) / (n + 0.5 * (v + 1))

    fit, weights = [seen(k, 1.0) for k in train], np.full(lm.LEVELS, 0.2)
    for _ in range(20):
        top, under = np.full(lm.LEVELS, 0.2), np.ones(lm.LEVELS)
        for first, ratio, alone in fit:
            w = weights[first]
            np.add.at(top, first, w * ratio / np.maximum(w * ratio + (1 - w) * alone, 1e-300))
            np.add.at(under, first, 1)
        weights = top / under
    weights = np.clip(weights, 1e-4, 0.9999)
    out = []
    for k in range(len(texts)):
        first, ratio, alone = seen(k, 0.0)
        out.append(float(np.log10(weights[first] * ratio + (1 - weights[first]) * alone).sum()))
    return out


def test_language_model_weights_are_of_all_documents(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(x)}" for x in (rng.zipf(1.5, 12) % 60 if i % 3 else np.arange(12) + i % 7))) for i in range(700)]
    want = brute_scores(texts, 16)
    for max_bytes in (256 << 20, 600):  # one round, and several
        got = {r.doc_id: r.score for r in language_model.score_documents(docs(spark, texts), head=20, buckets=16, max_bytes=max_bytes).collect()}
        assert [got[i] for i, _ in texts] == pytest.approx(want)


def test_language_model_scores_tokens_of_empty_buckets(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    for texts in ([(i, "a b a" if i % 2 else "b c d e") for i in range(40)], [(i, "only held out") for i in held]):
        want = brute_scores(texts, 64)
        for max_bytes in (256 << 20, 8):
            got = {r.doc_id: r.score for r in language_model.score_documents(docs(spark, texts), head=2, buckets=64, max_bytes=max_bytes).collect()}
            assert [got[i] for i, _ in texts] == pytest.approx(want) and max(want) < 0


def test_bloom_levels():
    keys = np.arange(5_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    q = (np.arange(5_000) % 7 + 1).astype(np.int64)
    f = language_model.Filters(1, {0: language_model.bloom(keys, q).tobytes()})
    assert (f.levels(keys) >= q).all() and (f.levels(keys) > q).mean() < 0.06
    assert (f.levels(keys + np.uint64(1)) > 0).mean() < 0.06


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeiounrst"), 5))
    texts, y = [], []
    for k in range(300):
        w = [word() for _ in range(40)]
        if k % 3 == 0:
            w[int(rng.integers(40))] = "grumblox" + ["", "en", "ed"][k % 9 // 3]
        texts.append(" ".join(w))
        y.append(int(k % 3 == 0))
    lex = toxicity.learn(texts, np.array(y))
    assert lex.score("you are a grumbloxen today my friend of all") >= 0.3 > lex.score("nothing of the kind is said here at all")
    assert lex.score("GRUMBL0X again") >= 0.3 and lex.score("grumblоx again") >= 0.3  # digit, Cyrillic
    assert lex.score("1diot you") >= 0.3 and lex.score(None) == lex.score("") < 0.3
    assert toxicity.Lexicon({"stupid": (4.0, True)}).matches("a stupid question") == [] and toxicity.Lexicon({"stupid": (4.0, True)}).matches("stupidly") == []
    got = toxicity.score(docs(spark, [(1, None), (None, "idiot"), (2, "x " * 200_000)]), lex).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.learn([], np.array([])).score("idiot") > 0
    assert toxicity.clean(docs(spark, [(1, "fine"), (2, "you idiot moron scum")]), lex).columns == ["doc_id", "text", "lang", "h", "node", "slot"]


def test_language(spark):
    en, de, fr, es = "the cat and the dog walk over the hill with them", "der hund und die katze gehen über den berg mit", "le chat et le chien marchent sur la colline avec", "el perro y el gato caminan sobre la colina con los"
    rows = [(i, f"{t} {i}", lang) for i in range(120) for t, lang in [((en, "en"), (de, "de"), (fr, "fr"), (es, "es"))[i % 4]]]
    df = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !!", "en"), (502, en, None), (None, de, "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "en" and got[None].lang_pred == "de"
    none = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.known(df, language.fit(df)).where("doc_id in (500, 501)").count() == 0


def test_quality(spark):
    good = [f"A sentence number {i} of plain prose, that says something. And another one." * 20 for i in range(60)]
    bad = [f"BUY!! NOW!! {i} $$$ *** %%% " * 40 for i in range(60)]
    bags, y = [quality.encode(t) for t in good + bad], np.array([1] * 60 + [0] * 60)
    model = quality.calibrated(quality.train(bags, y, steps=80), bags, y)
    assert ((model.score(bags) >= 0.5) == y).mean() > 0.98
    x, starts, bag = np.vstack(bags[:2]), np.array([0, len(bags[0])]), np.repeat([0, 1], [len(bags[0]), len(bags[1])])
    att = model.forward((x - model.mean) / model.spread, starts, bag)["att"]
    assert np.add.reduceat(att, starts) == pytest.approx([1, 1], abs=1e-4)
    got = quality.score(docs(spark, [(1, None), (2, ""), (None, "x" * 500_000)]), model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert quality.train([], np.array([])).score([quality.encode(None)]).tolist() == [0.5]


def test_sharding(spark):
    t = sharding.lookup(sharding.names(10), 997)
    share = Counter(t)
    assert max(share.values()) - min(share.values()) <= 1 and sum(share.values()) == 997
    fewer = sharding.lookup(sharding.names(9), 997)
    assert sum(a == b for a, b in zip(t, fewer, strict=True)) > 0.75 * 997
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 997)
    with pytest.raises(ValueError):
        sharding.lookup(["a"], 998)
    got = sharding.place(docs(spark, [(1, "a"), (1, None), (None, "x")]).select("doc_id", "text"), sharding.names(4), 997).collect()
    assert len(got) == 3 and len({r.shard_id for r in got if r.doc_id == 1}) == 1
    h = int(hashlib.md5(b"1").hexdigest()[:8], 16) % 997
    assert {r.slot for r in got if r.doc_id == 1} == {h}
