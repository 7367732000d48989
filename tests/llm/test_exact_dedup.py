import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from panelyst.llm import exact_dedup as ed
from panelyst.llm.queries import QUERIES, table

from ..conftest import DATA
from .helpers import empty, odd


def brute_force(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    out = []
    for normal, members in groups.items():
        members.sort()
        ids = [None if none else d for _, none, d in members]
        sha = hashlib.sha256(normal.encode()).hexdigest()
        out += [(d, ids[0], len(ids), i == 0, sha) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def check(df, want=None, **how):
    got = sorted((tuple(r) for r in ed.copies(df, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == (want or brute_force([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))


def test_odd_rows_by_brute_force(spark):
    df = odd(spark)
    extra = df.where("doc_id < 20").withColumn("text", F.regexp_replace("text", " ", "\t \n")).withColumn("doc_id", F.col("doc_id") - 5)
    nbsp = df.where("doc_id < 3").withColumn("text", F.concat("text", F.lit("  é😀")))
    check(df.unionByName(extra).unionByName(nbsp).unionByName(nbsp))
    assert ed.copies(empty(spark)).count() == 0 and ed.deduplicated(empty(spark)).count() == 0


def test_digests_that_collide(spark):
    """A digest of one hexadecimal digit is shared by most texts, one of two by some: bytes tell them apart."""
    df = odd(spark, 3)
    for digits in (1, 2):
        weak = lambda t, n=digits: F.substring(F.md5(t), 1, n)
        assert ed.collided(df, digest=weak).count() > 0
        check(df, digest=weak)
    assert ed.collided(df).count() == 0


def test_rows_that_stay(spark):
    df = odd(spark).unionByName(odd(spark))
    kept = ed.deduplicated(df)
    assert kept.columns == df.columns
    want = sorted((r.keep_id for r in ed.copies(df).where("kept").collect()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want and len(want) < df.count() / 2


def test_query_by_brute_force(spark):
    want = brute_force([(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()])
    got = QUERIES["op12_exact_dedup"](spark, DATA).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want
