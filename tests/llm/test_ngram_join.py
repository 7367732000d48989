import random
from collections import defaultdict

import numpy as np

from panelyst.llm import ngram_join as nj
from panelyst.llm.common import components

from .helpers import empty, odd, words


def brute(rows, k=5):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)] += [] if d is None else [d]
    return sorted((-1 if d is None else d, len(sets[i]), min(least[root(i)], default=-1)) for i, (d, _) in enumerate(rows))


def check(spark, df):
    got = nj.similar_components(df).collect()
    fix = lambda x: -1 if x is None else x
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((fix(r.doc_id), r.n_shingles, fix(r.component_id)) for r in got) == brute(rows)


def test_odd_rows(spark):
    check(spark, odd(spark))
    assert nj.similar_components(empty(spark)).count() == 0


def test_near_copies_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 8)
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 900)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(160):
        w = list(base) if i % 2 else [f"u{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 100))] + passage
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
        rows.append((i, " ".join(w)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_copies_without_ids(spark):
    base = [f"v{i}" for i in range(60)]
    near = lambda i: " ".join([*base, f"end{i}"])
    # both sides without an id, twice each; then a chain of three whose middle alone lacks one
    lone = [(None, near(i)) for i in (0, 0, 1, 1)]
    u = [f"u{i}" for i in range(60)]
    chain = [(7, " ".join(u)), (None, " ".join(u[6:] + [f"x{i}" for i in range(6)])), (9, " ".join(u[12:] + [f"x{i}" for i in range(12)]))]
    rows = [*lone, *chain, (11, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, df)
    by = {r.doc_id: r.component_id for r in nj.similar_components(df).collect() if r.doc_id is not None}
    assert by == {7: 7, 9: 7, 11: 11}
    # nodes without any id link with each other and with those of an id
    check(spark, spark.createDataFrame([*lone, (5, near(2))], "doc_id long, text string"))


def test_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(0)
    maps, n, sets = [], [], []
    for size in rng.integers(1, 300, 60):
        s = np.unique(rng.integers(0, 400, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sets.append(s)
        maps.append(nj.bitmap_of(s))
        n.append(len(s))
    i, j = np.triu_indices(60, 1)
    bound = nj.overlap_bounds(maps, np.array(n), i, j)
    for x, y, b in zip(i, j, bound, strict=True):
        assert b >= len(np.intersect1d(sets[x], sets[y])) and b == nj.overlap_bound(maps[x], maps[y], n[x], n[y])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and len(got) == 92
