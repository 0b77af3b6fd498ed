"""Members of buckets by sizes and sketches (op4)."""

import numpy as np

from codeloom.llm import jaccard


def test_chance_members_leave_their_buckets_and_links_stay(spark):
    """Sets that share a prefix token by chance were sent whole to each other's buckets, which grew faster than the corpus (op4)."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
    near = [np.sort(np.append(s[3:], rng.integers(0, 1 << 63, 3, dtype=np.uint64))) for s in base[:10]]
    sets = base + near
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))}
    assert linked == {(k, 40 + k) for k in range(10)}
    first = spark.createDataFrame([(k, len(s), jaccard.sketch(s)) for k, s in enumerate(sets)] * 2, "node long, n long, sketch array<long>")
    # all in one bucket by chance, and in buckets of pairs
    members = spark.createDataFrame([(0, k) for k in range(len(sets))] + [(1, k) for k in (1, 2)] + [(2, k) for k in (2, 42)], "leader long, node long")
    kept = {(r.leader, r.node) for r in jaccard.near_members(members, first, 90, 300).collect()}
    assert kept == {(0, k) for pair in linked for k in pair} | {(2, 2), (2, 42)}
    whole = {(r.leader, r.node) for r in jaccard.near_members(members, first, 90, 20).collect()}
    assert whole == {(0, k) for k in range(len(sets))} | {(2, 2), (2, 42)}


def test_sketches_never_part_more_than_sets():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.append(a[n // 10:], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)))
        apart = sum((x ^ y).bit_count() for x, y in zip(np.array(jaccard.sketch(a)).view("<u8").tolist(), np.array(jaccard.sketch(b)).view("<u8").tolist(), strict=True))
        assert apart <= len(np.setxor1d(a, b))


def test_long_chance_members_leave_their_buckets(spark):
    """Sketches of 256 bits told no sets of more than 1,200 tokens apart, which carry half of all tokens: long sets were sent to each other's buckets (op4)."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (2000, 2010, 2020, 4000, 4010)]
    sets.append(np.sort(np.append(sets[0][40:], rng.integers(0, 1 << 63, 40, dtype=np.uint64))))
    assert 100 * len(np.intersect1d(sets[0], sets[5])) >= 90 * len(np.union1d(sets[0], sets[5]))
    first = spark.createDataFrame([(k, len(s), jaccard.sketch(s)) for k, s in enumerate(sets)], "node long, n long, sketch array<long>")
    members = spark.createDataFrame([(0, k) for k in range(len(sets))], "leader long, node long")
    assert {r.node for r in jaccard.near_members(members, first, 90, 300).collect()} == {0, 5}


def test_sets_of_many_buckets_go_out_once(spark):
    """A class led by several others was sent whole to each of their buckets, so what was sent grew faster than the corpus (op4)."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    base = [np.unique(draw(200)) for _ in range(3)]
    # 0 to 4 are near copies, 5 and 6 too, 7 meets them by chance
    sets = [np.sort(np.append(base[0][k:], draw(k))) for k in range(5)] + [base[1], np.sort(np.append(base[1][5:], draw(5))), base[2]]
    first = spark.createDataFrame([(k, len(s), jaccard.sketch(s), jaccard.wide(s)) for k, s in enumerate(sets)], "node long, n long, sketch array<long>, wide array<long>")
    members = spark.createDataFrame([(a, b) for a in range(5) for b in range(a, 5)] + [(0, k) for k in (5, 6, 7)] + [(5, 6), (5, 7), (5, 5)], "leader long, node long")
    assert jaccard.near_members(members, first, 90, 300).count() > 8
    groups = {}
    for r in jaccard.near_groups(members, first, 90, 300).collect():
        groups.setdefault(r.leader, []).append(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [5, 6]]
    # split buckets stay whole, groups of more classes than a bucket keep their buckets: what may link always meets
    chain = spark.createDataFrame([(a, b) for a in range(4) for b in (a, a + 1)], "leader long, node long")
    for rows, bucket, pairs in ((members, 4, [(a, b) for a in range(5) for b in range(a)] + [(5, 6)]), (chain, 2, [(a, a + 1) for a in range(4)]), (chain, 300, [(a, a + 1) for a in range(4)])):
        kept = {}
        for r in jaccard.near_groups(rows, first, 90, bucket).collect():
            kept.setdefault(r.leader, set()).add(r.node)
        assert all(any({a, b} <= g for g in kept.values()) for a, b in pairs)
        assert all(len(g) <= bucket or k == 0 for k, g in kept.items())


def test_long_sets_have_wider_sketches():
    """Sketches of 1,024 bits tell no sets of more than 4,000 tokens apart: a chance group of 343 long sets held a fifth of all tokens sent (op4)."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets = [np.unique(draw(n)) for n in (4500, 5000, 6000, 6100, 9000, 9100, 20_000, 20_100, 3900, 4200)]
    sets += [np.unique(np.append(s[len(s) // 50:], draw(len(s) // 50))) for s in sets]
    may = jaccard.linkable(np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets], [jaccard.wide(s) for s in sets], 90)
    linked = np.array([[100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (may == linked).all() and linked.sum() == 40
