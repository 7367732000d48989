import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from panelyst.llm import importance_resampling as ir
from panelyst.llm.queries import QUERIES, table

from ..conftest import DATA
from .helpers import empty, odd

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def grams(text, orders):
    ws = tokens(text)
    return [" ".join(ws[i : i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]


def brute_force(rows, target, orders=1, buckets=10_000, seed=2024, least=20, percent=10):
    """[(doc_id, n_features, weight, score, rank)] in order of rank, then of the rest."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, orders))
    t = Counter(bucket(g) for x in target for g in grams(x, orders))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, text in rows:
        g = grams(text, orders)
        w = sum(gain(bucket(x)) for x in g)
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), w, w + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(able) // 100
    return [(*r[:4], i if i <= k else None) for i, r in enumerate(able, 1)] + [(*r[:4], None) for r in out if not r[4]]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_odd_rows_by_brute_force(spark):
    docs = odd(spark)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.upper(F.concat(F.lit("É_à, B2 "), "text"))))
    target = spark.createDataFrame([(1, "w1 w2 w3 w1 w2 w3"), (2, None), (3, "W5 w5-w6 é"), (4, "W5 w5-w6 é")], "item_id int, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [r.text for r in target.collect()]
    for orders, buckets in ((1, 10_000), (1, 7), (2, 10_000), (3, 101)):
        got = ir.resample(docs, target, orders=orders, buckets=buckets, least_words=5, percent=40)
        want = brute_force(rows, texts, orders, buckets, least=5, percent=40)
        same(got.select("doc_id", "n_features", "weight", "score", "rank").collect(), want)
    kept = ir.drawn(docs, target, orders=2, least_words=5, percent=40)
    assert kept.columns == docs.columns
    took = sum(r[4] is not None for r in brute_force(rows, texts, 2, least=5, percent=40))
    assert kept.count() == took > 10


def test_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert ir.resample(empty(spark), target).count() == 0
    got = ir.resample(odd(spark), target, orders=1, percent=100, least_words=1)
    assert got.where("rank IS NOT NULL").count() == got.where("n_words > 0").count() > 0
    assert ir.resample(odd(spark), target, orders=1, percent=0).where("rank IS NOT NULL").count() == 0


def test_windows_need_no_exchange_of_words(spark):
    """Texts move once to their key; words stay where posexplode made them."""
    plan = ir.positions(odd(spark), 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate posexplode") :]
    assert "Exchange" not in plan[: plan.index("Generate posexplode")] and "Exchange" in below
    assert "Exchange" not in ir.positions(spark.read.parquet(f"{DATA}/documents.parquet"), 1)._jdf.queryExecution().executedPlan().toString()


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    target = [r.text for r in table(spark, DATA, "benchmark").collect()]
    got = QUERIES["op11_importance_resampling"](spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), brute_force(rows, target))
