import hashlib

from pyspark.sql import functions as F

from panelyst.llm import fingerprints as fp

from .helpers import empty, odd, words


def test_edited_texts_by_brute_force(spark):
    for k, df in ((0, odd(spark)), (1, odd(spark, 1).where("doc_id < 30"))):
        got = fp.compared_with_edit(df).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()), reverse=True)
        want = []
        for i, (known, d, t) in enumerate(rows):
            nxt = rows[(i + 1) % len(rows)][2]
            cut = len(t) // 3
            want.append((d if known else -1, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want), k
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.compared_with_edit(empty(spark)).count() == 0
    one = fp.compared_with_edit(df.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_bins_agree_with_one(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("doc_id"), F.concat(F.lit("text of "), "id", F.lit(" and more words")).alias("text"))
    many = fp.with_successor(fp.successors(df, per_bin=20), ["text"]).collect()
    one = fp.with_successor(fp.successors(df, per_bin=10_000), ["text"]).collect()
    f = lambda rows: sorted((r.doc_id, r.text, r.next_text) for r in rows)
    assert f(many) == f(one) and len(one) == 500


def test_sketches_estimate_and_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 3500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select("a", "b", fp.sketch(F.col("a"), 256).alias("x"), fp.sketch(F.col("b"), 256).alias("y"))
    r = df.select(
        fp.resemblance(F.col("x"), F.col("y"), 256).alias("j"),
        fp.containment(F.col("y"), F.col("x"), 256).alias("c"),
        fp.distinct_count(F.col("x"), 256).alias("n"),
        fp.from_text(fp.as_text(F.col("x"))).alias("back"),
        "x",
        fp.merged(F.col("x"), F.col("y"), 256).alias("m"),
    ).first()
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a), words(b)))
    assert abs(r.j - len(s & t) / len(s | t)) < 0.12 and abs(r.c - len(s & t) / len(t)) < 0.15 and abs(r.n / len(s) - 1) < 0.2
    assert r.back == r.x and len(r.m) == 256
    both = df.select(fp.sketch(F.col("a"), 256).alias("s")).union(df.select(fp.sketch(F.col("b"), 256).alias("s")))
    grouped = both.select(F.lit(1).alias("g"), "s")
    for fan in (2, 64):
        assert fp.merge_groups(grouped.unionByName(grouped).unionByName(grouped), ["g"], "s", 256, fan).first().s == r.m
