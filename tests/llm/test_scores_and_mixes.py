import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelyst.llm import lm_scoring as lm
from panelyst.llm import sharding as sh
from panelyst.llm import source_mixing as sm
from panelyst.llm.queries import QUERIES

from ..conftest import DATA
from .helpers import empty, odd, words


def test_scores_by_brute_force(spark):
    docs = odd(spark)
    got = lm.score_texts(docs).toPandas()
    rows = docs.select("doc_id", "text").collect()
    name = lambda d: str(d) if d is not None else "null"
    part = lambda d: zlib.crc32(name(d).encode()) % 10
    toks = [(r.doc_id, words(r.text) + ["\0"]) for r in rows]
    uni = Counter(w for d, t in toks if part(d) for w in t)
    n, v = sum(uni.values()), len(uni)
    want = sorted((-1 if d is None else d, part(d) == 0, len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in toks)
    seen = sorted((-1 if d != d else int(d), bool(h), int(k), int(o), int(m), round(b, 6)) for d, h, k, o, m, b in zip(got.doc_id, got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score, strict=True))
    assert [w[:5] for w in want] == [s[:5] for s in seen] and np.allclose([w[5] for w in want], [s[5] for s in seen])
    assert got.score.sum() > got.base_score.sum() and np.isfinite(got.score).all()
    assert lm.score_texts(empty(spark)).count() == 0


def test_interpolation_by_brute_force(spark):
    """score itself: counts in dictionaries, weights by the same grid and rounds, one text at a time."""
    docs = odd(spark)
    rows = [(r.doc_id, words(r.text) + ["</s>"]) for r in docs.select("doc_id", "text").collect()]
    name = lambda d: str(d) if d is not None else "null"
    role = lambda d: zlib.crc32(name(d).encode()) % 10

    def count(keep):
        c = Counter()
        for d, t in rows:
            if keep(role(d)):
                t = ["<s>", "<s>", *t]
                c.update(t[2:])
                c.update(zip(t[1:], t[2:], strict=False))
                c.update(zip(t, t[1:], t[2:], strict=False))
        n = sum(v for k, v in c.items() if isinstance(k, str))
        c["<s>"] = c["</s>"]
        c["<s>", "<s>"] = c["</s>"]
        return c, n, sum(isinstance(k, str) for k in c) - 1

    def parts(t, c, n, v):
        """(bucket of one word, p2, p1, bucket of two words, p3) of every token."""
        t = ["<s>", "<s>", *t]
        bucket = lambda x: min(lm.BUCKETS - 1, 0 if not x else int(math.log2(x)) + 1)
        for a, b, w in zip(t, t[1:], t[2:], strict=False):
            yield bucket(c[b]), c[b, w] / max(c[b], 1), c[w] / n, bucket(c[a, b]), c[a, b, w] / max(c[a, b], 1)

    grid = lambda p: 2.0 ** (round(lm.STEP * math.log2(p)) / lm.STEP) if p > 0 else 0.0
    rest = count(lambda r: r > 1)
    held = [x for d, t in rows if role(d) == 1 for x in parts(t, *rest)]
    p0 = 1 / (rest[2] + 1)
    first = lm.em_weights(pd.DataFrame([(b, grid(p2), grid(p1), p0, 1) for b, p2, p1, _, _ in held], columns=["bucket", "p2", "p1", "p0", "n"]))
    below = lambda b, p2, p1, p0: float(first[b] @ [p2, p1, p0])
    upper = lm.em_weights(pd.DataFrame([(b3, grid(p3), grid(below(b, p2, p1, p0)), 1) for b, p2, p1, b3, p3 in held], columns=["bucket", "p3", "rest", "n"]), parts=("p3", "rest"))
    every = count(lambda r: r > 0)
    p0 = 1 / (every[2] + 1)
    want = sorted((-1 if d is None else d, sum(math.log10(float(upper[b3] @ [p3, below(b, p2, p1, p0)])) for b, p2, p1, b3, p3 in parts(t, *every))) for d, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.score_texts(docs).collect())
    assert len(held) > 50 and np.allclose([x for _, x in want], [x for _, x in got], rtol=1e-6)


def test_weights_raise_the_likelihood():
    cells = pd.DataFrame({"bucket": [3, 3, 0], "p2": [0.5, 0.0, 0.0], "p1": [0.01, 0.02, 0.03], "p0": [1e-4] * 3, "n": [30, 10, 5]})
    w = lm.em_weights(cells)
    value = lambda w: sum(n * math.log(w[b] @ [p2, p1, p0]) for b, p2, p1, p0, n in cells.itertuples(index=False))
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0
    assert value(w) > value(np.tile([[1 / 3, 1 / 3, 1 / 3]], (lm.BUCKETS, 1)))


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        for s in free:
            target[s] = rest * w[s] / sum(w[x] for x in free)
        over = {s for s in free if target[s] > most * sizes[s]}
        for s in full | over:
            target[s] = most * sizes[s]
        if not over:
            return target
        full |= over


def test_mix(spark):
    docs = odd(spark)
    got = sm.systematic_copies(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    target = water_fill(sizes)
    assert len(got) == docs.count()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 3
    mixed = sm.mix_sources(docs)
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == [*(c for c in docs.columns if c != "copy_no"), "copy_no"]
    assert all({r[c] for r in mixed.select(c).distinct().collect()} == {docs.first()[c]} for c in ("_size", "_nth", "row", "size"))
    assert sorted(map(str, got)) == sorted(map(str, sm.systematic_copies(docs).collect()))
    assert sm.systematic_copies(empty(spark)).count() == sm.mix_sources(empty(spark)).count() == 0


def test_targets_near_and_limits(spark):
    rows = [(i, "w " * (i % 50 + 1), "a" if i < 1500 else "b" if i < 1900 else "c", 0) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows], "doc_id long, text string, source string")
    got = sm.systematic_copies(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("m")).collect()
    assert all(abs(r.taken - r.target) < 0.02 * r.target + 60 and r.m <= 3 for r in got)


def test_shards(spark):
    docs = odd(spark)
    out = sh.write_shards(docs, 6, bucket_bytes=4000).cache()
    assert out.count() == docs.count()
    again = sh.write_shards(docs.repartition(5), 6, bucket_bytes=4000)
    assert {(r["_tie"], r["_crc"], r["_start"], r["by_id"], r["bucket_start"]) for r in out.collect()} == {tuple(docs.first()[c] for c in ("_tie", "_crc", "_start", "by_id", "bucket_start"))}
    cols = ["doc_id", "text", "shard", "bucket", "slot"]
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, again.select(cols).collect()))
    by = defaultdict(list)
    for r in out.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sh.write_shards(empty(spark), 3).count() == 0


def test_query_of_shards_by_brute_force(spark):
    """The registered query against the law worked out in Python: who goes where, with one more shard too."""
    import xxhash

    def draw(d, j):
        h = xxhash.xxh64_intdigest(("null" if d is None else str(d)).encode(), 42)
        for x in (0, j):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return (h - (1 << 64) if h >> 63 else h) % (j + 1)

    law = lambda d, n: max([0, *(j for j in range(1, n) if draw(d, j) == 0)])
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op10_shards"](spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (law(r.doc_id, 24), law(r.doc_id, 25))
    for n in range(24):
        slots = sorted(r.slot for r in got if r.shard == n)
        assert slots == list(range(len(slots)))


def test_growth_moves_rows_into_the_new_shard_alone(spark):
    df = spark.range(20_000).select(sh.shard_of(F.col("id"), 24).alias("a"), sh.shard_of(F.col("id"), 25).alias("b"))
    assert df.where("a <> b AND b <> 24").count() == 0
    counts = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.25 * min(counts)
