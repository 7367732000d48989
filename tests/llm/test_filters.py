import gc
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from panelyst.llm import decontamination as dc
from panelyst.llm import quality_classifier as qc
from panelyst.llm import textscan

from ..conftest import DATA
from .helpers import empty, odd


def _sentence(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    items = [(i, _sentence(rng, 40)) for i in range(20)] + [(50, None), (51, "short"), (52, "")]
    clean = [(i, _sentence(rng, 200)) for i in range(60)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        return "".join(t)

    leaks = [(100 + i, f"{_sentence(rng, 50)} {edited(items[i][1].upper(), i % 5)}! {_sentence(rng, 30)}") for i in range(20)]
    rows = clean + leaks + [(300, None), (301, ""), (100, "the same id again"), (None, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(20)} | {(None, 3)}
    assert {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench, block_bytes=600).collect()} == got
    kept = dc.decontaminated(docs, bench)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [*range(60), 300, 301]
    assert dc.contamination(docs.limit(0), bench).count() == dc.contamination(docs, bench.limit(0)).count() == 0
    assert dc.contamination(odd(spark), bench).count() == 0


def _nearest(pattern, text):
    """Fewest edits between a pattern and any stretch of a text."""
    d = np.zeros(len(text) + 1, int)
    steps = np.arange(len(text) + 1)
    for i, p in enumerate(pattern):
        new = np.concatenate([[i + 1], np.minimum(d[:-1] + (text != p), d[1:] + 1)])
        d = np.minimum.accumulate(new - steps) + steps
    return d.min()


def test_contamination_by_brute_force(spark, monkeypatch):
    """Every pair of a document and an item, by the nearest alignment of every window of the item."""
    monkeypatch.setattr(dc, "HITS", 40)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, letters(rng.choice([24, 40, 60]))) for i in range(8)] + [(8, "tiny one"), (9, "")]
    docs = []
    for i in range(60):
        t = letters(60)
        if i % 3:
            s = rng.choice(items[:8])[1]
            a = rng.randrange(max(1, len(s) - 16))
            cut = list(s[a : a + rng.randint(12, 30)])
            for _ in range(rng.randrange(3)):
                cut[rng.randrange(len(cut))] = rng.choice("xyz")
            t = t[:20] + "".join(cut) + t[20:]
        docs.append((i, t))
    docs += [(60, " Tiny, one! "), (61, "a tiny one"), (62, None)]
    want = set()
    for d, t in docs:
        text = np.frombuffer((t or "").encode(), np.uint8)
        for i, item in items[:8]:
            p = np.frombuffer(item.encode(), np.uint8)
            if t and any(_nearest(p[s : s + 16], text) <= 1 for s in range(len(p) - 15)):
                want.add((d, i))
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=16, stride=4, rate=0.0625)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want | {(60, 8)} and len(want) > 15


def test_contamination_by_brute_force_as_registered(spark):
    """64 letters and digits with up to 5 edits, as op3 has them, by the nearest alignment of every window."""
    rng = random.Random(12)
    items = [(i, _sentence(rng, rng.choice([14, 30, 60]))) for i in range(6)]
    norm = lambda t: "".join(c for c in t.lower() if c.isalnum())
    docs = []
    for i in range(36):
        t = _sentence(rng, 12)
        if i % 4:
            s = norm(rng.choice(items)[1])
            a = rng.randrange(max(1, len(s) - 60))
            cut = list(s[a : a + rng.randint(50, 90)])
            for _ in range(rng.randrange(9)):
                at = rng.randrange(len(cut))
                cut[at : at + 1] = rng.choice([[], ["x"], ["y", "z"]])
            t = t[:25] + " " + "".join(cut) + t[25:]
        docs.append((i, t))
    want = set()
    for d, t in docs:
        text = np.frombuffer(norm(t).encode(), np.uint8)
        for i, item in items:
            p = np.frombuffer(norm(item).encode(), np.uint8)
            n = min(64, len(p))
            if any(_nearest(p[s : s + n], text) <= int(0.08 * n) for s in range(len(p) - n + 1)):
                want.add((d, i))
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 10 < len(want) < 30


def _found(items, texts):
    from pyarrow import array

    index = dc.Index(items)
    return sorted(dc.matches(index, *textscan.text_buffer(array(texts))))


def test_cells_change_nothing(monkeypatch):
    """A document with many shared q-grams is looked at in cells of places; matches, their number and extents are the same."""
    rng = random.Random(21)
    unit = _sentence(rng, 9)
    items = [(1, unit * 6), (2, "ab" * 150), (3, "a" * 200 + _sentence(rng, 20)), (4, _sentence(rng, 60))]
    texts = ["b " + unit * 5 + "q" + unit * 3, "ab" * 300 + "c" + "a" * 300, items[3][1] + "a" * 150, _sentence(rng, 50), None, ""]
    whole = _found(items, texts)
    for hits in (2000, 20_000):
        monkeypatch.setattr(dc, "HITS", hits)
        assert _found(items, texts) == whole
    assert len(whole) > 500 and {m[:2] for m in whole} >= {(0, 1), (1, 2), (1, 3), (2, 4), (2, 3)}


def test_one_letter_over_and_over():
    """200,000 equal letters against 500: memory stays below a gigabyte."""
    code = """
import resource, sys, pyarrow as pa
from panelyst.llm import decontamination as dc, textscan
index = dc.Index([(1, "a" * 500)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _ in dc.matches(index, *textscan.text_buffer(pa.array(["a" * 200_000]))))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[0]) > 100_000 and int(out[1]) < 1000


def test_one_broadcast_at_a_time(spark, monkeypatch):
    """Of several blocks of the benchmark one is held at a time, and each is let go before the next is collected."""
    rng = random.Random(3)
    items = [(i, _sentence(rng, 40)) for i in range(9)]
    live, most = set(), []
    made = spark.sparkContext.broadcast

    def counted(value):
        shared = made(value)
        live.add(id(value))
        most.append(len(live))
        end = shared.destroy
        shared.destroy = lambda *a: (live.discard(id(value)), end(*a))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    got = dc.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=700)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(9)]
    assert len(most) >= 3 and max(most) == 1 and not live


@pytest.mark.parametrize("start", range(0, 17, 5))
def test_excerpts_at_any_phase(spark, start):
    rng = random.Random(4)
    item, other = _sentence(rng, 60), _sentence(rng, 30)
    norm = "".join(c for c in item if c.isalnum())
    docs = spark.createDataFrame([(1, other + " " + norm[start : start + 64] + " " + other), (2, other)], "doc_id long, text string")
    assert [r.doc_id for r in dc.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def test_banded_edits_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pattern = rng.integers(1, 5, 20).astype(np.uint8)
        text = rng.integers(1, 5, 20 + 9).astype(np.uint8)
        if rng.random() < 0.7:
            text[4:24] = pattern
            text[rng.integers(4, 24)] = 9
        best = 99
        for a in range(len(text)):
            row = np.arange(len(text) - a + 1)
            for i, p in enumerate(pattern):
                new = [i + 1]
                for j, t in enumerate(text[a:]):
                    new.append(min(row[j] + (p != t), row[j + 1] + 1, new[-1] + 1))
                row = new
            best = min(best, min(row))
        cost, _ = dc.banded_edits(pattern[None], text[None])
        assert cost[0] >= best and (best > 2 or cost[0] == best)


def test_model_by_brute_force(spark):
    """p of every n-gram, seen or not, against a plain interpolated modified Kneser-Ney model."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    order = 3
    model = qc.train(df.select("text"), order).toPandas()
    buf = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    counts = {order: {}}
    for b in buf:
        for g in qc.codes(b, np.array([0, len(b)]), order).tolist():
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g & qc.mask(k)] = counts[k].get(g & qc.mask(k), 0) + 1

    def p(g, k):
        if k == 0:
            return 1 / (1 << qc.BITS)
        g &= qc.mask(k)
        c = counts[k]
        d = qc.discounts(*[sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])
        cut = lambda v: d[min(v, 3) - 1]
        same = [v for x, v in c.items() if x >> qc.BITS == g >> qc.BITS]
        if not same:
            return p(g, k - 1)
        own = c.get(g, 0)
        return (own - cut(own) if own else 0) / sum(same) + sum(map(cut, same)) / sum(same) * p(g, k - 1)

    tables = {}
    for kind, col in (("p", "p"), ("b", "backoff")):
        for k, part in model.dropna(subset=[col]).groupby("k"):
            part = part.sort_values("g")
            tables[kind, k] = part.g.to_numpy().astype(np.uint64), part[col].to_numpy()
    asked = np.unique(np.concatenate([np.array(list(counts[3]), np.uint64), qc.codes(np.frombuffer(b"zzabcab ca", np.uint8), np.array([0, 10]), 3)]))
    got = qc.resolve(asked, tables, order)
    assert np.allclose(got, [np.log2(p(int(g), order)) for g in asked])
    symbols = np.array([(int(asked[5]) >> qc.BITS << qc.BITS) | s for s in range(1 << qc.BITS)], np.uint64)
    assert np.isclose(np.exp2(qc.resolve(symbols, tables, order)).sum(), 1)


def test_classify_by_brute_force(spark):
    """Every row's bits, threshold and verdict from the model's own table, one text at a time."""
    rng = random.Random(12)
    fine = [(i, _sentence(rng, rng.randint(5, 60)), rng.choice(["en", "fr"])) for i in range(80)]
    junk = [(100 + i, "".join(rng.choice("#$%&*0123456789") for _ in range(200)), "en") for i in range(10)]
    rows = fine + junk + [(200, None, "en"), (201, "", "de"), (202, "plain words of another language", "de"), (203, "漢字 Ω", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fitted = {r.doc_id for r in qc.fitted_ids(labels, 20).collect()}
    assert len(fitted) == 20
    model = qc.train(docs.where(docs.doc_id.isin(*fitted)).select("text")).toPandas()
    tables = {}
    for kind, col in (("p", "p"), ("b", "backoff")):
        for k, part in model.dropna(subset=[col]).groupby("k"):
            part = part.sort_values("g")
            tables[kind, k] = part.g.to_numpy().astype(np.uint64), part[col].to_numpy()

    def bits(t):
        raw = (t or "").encode()
        padded = b"\0" * 5 + raw
        grams = np.array([int.from_bytes(padded[i : i + 6]) for i in range(len(raw))], np.uint64)
        return -qc.resolve(grams, tables).mean() if raw else None

    quantile = 0.9
    want = {d: bits(t) for d, t, _ in rows}
    judges = [(x, want[d]) for d, t, x in fine[:60] if d not in fitted]
    at = lambda xs: sorted(xs)[max(0, int(np.ceil(quantile * len(xs))) - 1)]
    limit = {x: at([b for y, b in judges if y == x]) for x in ("en", "fr")}
    overall = at([b for _, b in judges])
    got = {r.doc_id: r for r in qc.classify(docs, labels, quantile, 20).collect()}
    for d, _, x in rows:
        r, b = got[d], want[d]
        assert (r.bits is None) == (b is None) and (b is None or abs(r.bits - b) < 1e-5)
        assert abs(r.threshold - limit.get(x, overall)) < 1e-5
        assert r.keep == (b is not None and r.bits <= r.threshold)
    assert all(not got[d].keep for d, _, _ in junk)


def test_held_out_accuracy(spark):
    at = DATA.replace("sf0.001", "sf0.01")  # the smaller table has five rejects to test on
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    out = qc.classify(docs, fit, quantile=0.98).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert out[(out.quality == 1) & (out.toxic == 0)].keep.mean() > 0.8
    assert out[out.quality == 0].keep.mean() < 0.35


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(i, 1, 0) for i in range(10, 30)] + [(3, 1, None), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    docs = odd(spark)
    out = qc.classify(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(not r.keep for r in out if r.doc_id in (100, 101)) and any(r.keep for r in out)
    assert qc.classify(empty(spark), labels).count() == 0
    none = qc.classify(docs, labels.limit(0)).collect()
    assert len(none) == len(out) and all(r.keep == (r.bits is not None) for r in none)


@pytest.mark.parametrize("order", [1, 2, 6])
def test_codes(order):
    values = np.frombuffer(b"abcab", np.uint8)
    got = qc.codes(values, np.array([0, 3, 5]), order)
    assert got[0] == got[3] == ord("a") and (order == 1 or got[1] == int.from_bytes(b"ab"))
    assert got[2] == int.from_bytes(b"abc"[-order:]) and got[4] == int.from_bytes(b"ab"[-order:])


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(40))).encode() for _ in range(60)] + [b"", b"x" * 90, b""]
    values, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    grams, words = qc.codes(values, offsets), textscan.word_hashes(values, offsets)
    monkeypatch.setattr(qc, "BLOCK", 7)
    monkeypatch.setattr(textscan, "BLOCK_BYTES", 7)
    assert (np.concatenate([g for _, _, g in qc.code_blocks(values, offsets)]) == grams).all()
    assert all((a == b).all() for a, b in zip(textscan.word_hashes(values, offsets), words, strict=True))


def _peak(run):
    """Result of run(), and the most bytes of arrays and hash tables that it had at once."""
    gc.collect()
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_chunk_follows_its_distinct_ngrams():
    """32 blocks of the same n-grams: neither their lists nor their places are held for all blocks at once."""
    rng = np.random.default_rng(5)
    pool = rng.integers(97, 123, (300, 7), np.uint8)
    texts = [pool[rng.integers(0, len(pool), 600)].tobytes().decode() for _ in range(2000)]
    table = pa.table({"text": texts})
    values, offsets = textscan.text_buffer(table.column(0))
    want = np.unique(qc.codes(values, offsets))
    grams, of_all = _peak(lambda: qc.distinct_codes(table, 0))
    assert (grams == want).all()
    # what is distinct and its hash table, what waits while it is merged, and a block
    most = 8 * (3 * len(want) + 4 * max(qc.WAITING, len(want)) + 8 * qc.BLOCK)
    assert of_all < most, of_all
    cost = (want % np.uint64(1009)).astype(np.int64)
    sums, of_sums = _peak(lambda: qc.text_sums(values, offsets, grams, cost))
    each = (qc.codes(values, offsets) % np.uint64(1009)).astype(np.int64)
    assert (sums == np.add.reduceat(each, offsets[:-1])).all()
    assert of_sums < most, of_sums


def test_sums_of_odd_texts(monkeypatch):
    monkeypatch.setattr(qc, "BLOCK", 7)
    monkeypatch.setattr(qc, "WAITING", 3)
    rng = random.Random(8)
    texts = ["", None, *["".join(rng.choice("abé ") for _ in range(rng.randrange(40))) for _ in range(50)], "", "x" * 90, None]
    table = pa.table({"text": pa.array(texts, pa.string())})
    values, offsets = textscan.text_buffer(table.column(0))
    grams, every = qc.distinct_codes(table, 0), qc.codes(values, offsets)
    assert (grams == np.unique(every)).all()
    cost = np.arange(len(grams), dtype=np.int64) + 1
    at = cost[np.searchsorted(grams, every)]
    assert qc.text_sums(values, offsets, grams, cost).tolist() == [at[a:b].sum() for a, b in zip(offsets, offsets[1:], strict=False)]
    nothing = pa.table({"text": pa.array(["", None], pa.string())})
    none = qc.distinct_codes(nothing, 0)
    assert not len(none) and qc.text_sums(*textscan.text_buffer(nothing.column(0)), none, none.astype(np.int64)).tolist() == [0, 0]


def test_copies_of_the_model_change_nothing(spark, monkeypatch):
    docs = odd(spark)
    model = qc.train(docs.limit(20).select("text"))
    once = sorted(map(repr, qc.perplexities(docs, model).collect()))
    monkeypatch.setattr(qc, "COPY_BYTES", 1 + docs.selectExpr("sum(octet_length(text))").first()[0] // 3)
    assert sorted(map(repr, qc.perplexities(docs, model).collect())) == once
