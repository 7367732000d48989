import numpy as np

import corpus_pipeline as cp
from panelyst.llm import source_mixing
from panelyst.llm.common import written
from panelyst.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from ..conftest import DATA
from .helpers import empty, odd, odd_rows, words
from .test_ngram_join import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, seen[-1], DATA), name.replace(" ", "-"))
        assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    junk, fine = (set(labels[(labels.quality == q) & (labels.toxic == 0)].doc_id) for q in (0, 1))
    assert len(fine & ids[1]) > 0.9 * len(fine) and len(junk & ids[1]) < 0.5 * len(junk)
    rows = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert ids[2] == {d for d, _, c in brute(rows) if d == c}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaking = {r.doc_id for r in seen[2].collect() if any(i in r.text for i in items)}
    assert leaking and not leaking & ids[3] and len(ids[3]) >= len(ids[2]) - len(leaking) - 2
    want = {(r.doc_id, r.copies) for r in source_mixing.systematic_copies(seen[3]).where("copies > 0").collect()}
    assert {(r.doc_id, r["count"]) for r in seen[4].groupBy("doc_id").count().collect()} == want
    last = cp.STAGES[-1][1](spark, seen[4], DATA).toPandas().sort_values("start")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    n = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in seen[4].collect()}
    assert len(last) == seen[4].count() and all(n[d] == k for d, k in zip(last.doc_id, last.n_tokens, strict=True))
    assert last.start.tolist() == [0, *np.cumsum(last.n_tokens)[:-1]]


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd(spark)
    out = cp.near_duplicates(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect())
    rows = {(r.doc_id, r.text or "") for r in docs.collect()}
    # rows of one component: equal texts and those that differ in a word at the end; the same id alone links nothing
    made = odd_rows()
    kept = {(-1 if d is None else d, t) for d, t in rows} - {(-1, made[5][1])} - {(200 + i, made[7][1] + f" end{i}") for i in range(5)}
    long = len(set(words(made[7][1]))) > 30
    assert set(got) >= kept - {(d, t) for d, t in kept if d >= 200} and len({d for d, _ in got if d >= 200}) <= (0 if long else 5)
    assert (3, "another text of the same id") in got and (3, made[3][1]) in got and len(set(got)) == len(got)
    assert cp.near_duplicates(spark, empty(spark), DATA).count() == 0


def test_quality_of_odd_rows(spark):
    out = cp.quality(spark, odd(spark), DATA)
    assert out.columns == odd(spark).columns and not {100, 101} & {r.doc_id for r in out.collect()}
    assert cp.quality(spark, empty(spark), DATA).count() == 0
