"""The learned operators against naive versions: matcher, gradients and pooling, the learning split, nulls, repeats, long texts, clashing columns."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.test_operators import docs

from codeloom.llm import common, language, quality, sharding, toxicity

BIG = 9_007_199_254_740_993


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def naive_matches(lexicon, folded):
    """Every term at every place, then the longest at each start, then those that no exception phrase holds."""
    letter = lambda k: 0 <= k < len(folded) and folded[k].isalpha()
    at = lambda term, k: folded.startswith(term, k) and not letter(k - 1)
    spared = [(k, k + len(p)) for p in map(toxicity.fold, lexicon.exceptions) if p not in lexicon.terms for k in range(len(folded)) if at(p, k) and not letter(k + len(p))]
    out = []
    for k in range(len(folded)):
        found = [(len(t), w) for t, (w, whole) in lexicon.terms.items() if at(t, k) and not (whole and letter(k + len(t)))]
        if found:
            size, weight = max(found)
            if not any(a <= k and k + size <= b for a, b in spared):
                out.append((k, k + size, weight))
    return out


def test_matches_equal_a_naive_matcher():
    lexicon = toxicity.Lexicon({"stupid": (4.0, True), "idio": (2.0, False), "idiot": (4.0, True), "stupid question": (1.0, True), "clown": (1.5, False)}, ("stupid idea", "class clown", "idiot proof"))
    rng = np.random.default_rng(3)
    words = ["stupid", "idea", "idiot", "idiotic", "question", "class", "clown", "clowns", "proof", "xstupid", "5tup1d", ",", "é", "a"]
    for _ in range(300):
        folded = toxicity.fold("".join(str(rng.choice(words)) + str(rng.choice([" ", " ", "", "-"])) for _ in range(12)))
        assert sorted(lexicon.matches(folded)) == naive_matches(lexicon, folded)


def test_exceptions_take_time_by_length():
    lexicon = toxicity.Lexicon({"stupid": (4.0, True)})

    def took(n):
        begun = time.perf_counter()
        assert lexicon.matches("stupid question " * n + "stupid") == [(16 * n, 16 * n + 6, 4.0)]
        return time.perf_counter() - begun

    took(1_000)
    assert took(80_000) < 8 * took(20_000) + 0.2


def labelled_rows(spark, flip=None):
    """Texts and labels of which two are shown by words and signs; ``flip`` changes what is not to be learned from."""
    texts, labels = [], []
    for i in range(300):
        bad = i % 2
        hidden = flip and held(i, *flip)
        texts.append((i, ("you grumblox of a man, $$$ *** %%%" if bad else "a calm day by the river, with friends.") + f" {i}" + (" flipped" if hidden else "")))
        labels.append((i, (1 - bad) if hidden else bad, (1 - bad) if hidden else bad))
    texts += [(None, "null id"), (0, "zz a second text of this id")]
    return docs(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_never_learned_from(spark):
    d, y = labelled_rows(spark)
    a, b = toxicity.fit(d, y), toxicity.fit(*labelled_rows(spark, (toxicity.MOD, toxicity.HELD)))
    assert a.terms == b.terms and a.curve == b.curve and a.score("what a grumblox") > 0.5 > a.score("a calm day")
    m, n = quality.fit(d, y), quality.fit(*labelled_rows(spark, (quality.MOD, quality.HELD)))
    assert all(np.array_equal(m.p[k], n.p[k]) for k in m.p) and m.p
    few = common.labelled(d, y, "toxic", toxicity.MOD, toxicity.HELD, 50, most=500)
    assert 0 < len(few) < 50 and sum(map(len, few.text)) <= 500 and not any(held(i, toxicity.MOD, toxicity.HELD) for i in few.doc_id)


def test_scores_of_odd_rows(spark):
    d, y = labelled_rows(spark)
    lexicon, model = toxicity.fit(d, y), quality.fit(d, y)
    odd = spark.createDataFrame([(BIG, "x", 0.5, True), (None, None, 0.5, False), (1, "", 1.0, None), (1, "", 1.0, None), (2, "word " * 100_000, 0.1, None)], "doc_id long, text string, score double, held_out boolean")
    for rows, mod, rest in ((toxicity.score(odd, lexicon), toxicity.MOD, toxicity.HELD), (quality.score(odd, model), quality.MOD, quality.HELD)):
        got = rows.collect()
        assert Counter(r.doc_id for r in got) == Counter([BIG, None, 1, 1, 2]) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, mod, rest)) for r in got)
    assert toxicity.clean(odd, lexicon).columns == odd.columns
    assert toxicity.score(odd.limit(0), lexicon).count() == quality.score(odd.limit(0), model).count() == 0
    none = y.limit(0)
    assert toxicity.fit(d, none).curve == toxicity.Lexicon({}).curve and {r.score for r in quality.score(odd, quality.fit(d, none)).collect()} == {0.5}


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    x, starts, bag, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 5]), np.array([0, 0, 1, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    share = np.array([0.25, 0.5, 0.25])
    p = {"w": rng.normal(size=(quality.FEATURES, 3)) / 16, "b": rng.normal(size=3), "v": rng.normal(size=(3, 2)), "u": rng.normal(size=(3, 2)), "a": rng.normal(size=2), "c": rng.normal(size=3), "c0": rng.normal(size=1)}
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), p)

    def loss():
        out = np.zeros(3)
        for k in range(3):  # each bag alone, by loops
            rows = x[bag == k]
            h = np.tanh(rows @ p["w"] + p["b"])
            e = np.array([sum(np.tanh(r @ p["v"][:, j]) * (1 / (1 + np.exp(-(r @ p["u"][:, j])))) * p["a"][j] for j in range(2)) for r in h])
            att = np.exp(e) / np.exp(e).sum()
            out[k] = 1 / (1 + np.exp(-((att @ h) @ p["c"] + p["c0"][0])))
        return -(share * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum(), out

    assert model.forward(x, starts, bag)["out"] == pytest.approx(loss()[1])
    made = model.gradients(x, starts, bag, y, share)
    for k, w in p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in w.shape)
            before, step = w[at], 1e-5
            w[at] = before + step
            up = loss()[0]
            w[at] = before - step
            down = loss()[0]
            w[at] = before
            assert made[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_languages_are_learned_from_training_rows_alone(spark):
    words = {"en": "the cat and the dog walk over the hill", "de": "der hund und die katze gehen den berg", "fr": "le chat et le chien sur la colline"}
    rows = [(i, f"{list(words.values())[i % 3]} {i}", list(words)[i % 3]) for i in range(240)]
    other = [(i, t, "xx" if held(i, language.MOD, language.HELD) else lang) for i, t, lang in rows]
    make = lambda x: spark.createDataFrame([(*r, 0.0, "a") for r in x], "doc_id long, text string, lang string, score double, lang_pred string")
    a, b = language.fit(make(rows)), language.fit(make([*other, (None, "zz", "yy"), (3, None, "qq")]))
    assert a.members == b.members and np.allclose(a.family_w, b.family_w)
    odd = make([(BIG, words["de"], None), (None, "", "en"), (4, "1 2", "en"), (4, "1 2", "en"), (7, words["fr"] * 20_000, None)])
    got = language.identify(odd, a).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got) == Counter([(BIG, "de"), (None, "und"), (4, "und"), (4, "und"), (7, "fr")])
    assert language.identify(odd.limit(0), a).count() == 0 and language.known(odd, a).columns == odd.columns


def test_no_language_is_left_out(spark):
    rows = [(i, f"word{i % 40} " * 3, f"l{i % 40}") for i in range(400)]
    assert len(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40).members) == 40


def test_fill_equals_a_plain_one():
    import hashlib

    n, size = 13, 101
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:16], 16)
    orders = [[(number(f"offset:{s}") % size + j * (number(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in sharding.names(n)]
    free, made, turn = set(range(size)), [None] * size, 0
    while free:
        at = next(x for x in orders[turn % n] if x in free)
        made[at], turn = turn % n, turn + 1
        free.remove(at)
    assert sharding.lookup(sharding.names(n), size) == made


def test_placement_replaces_columns_of_its_names(spark):
    got = sharding.place(docs(spark, [(1, "a"), (None, "b")]), sharding.names(4), 101)
    assert sorted(got.columns) == ["doc_id", "h", "lang", "node", "shard_id", "slot", "text"] and got.count() == 2
    assert sharding.place(docs(spark, []), sharding.names(4), 101).count() == 0
