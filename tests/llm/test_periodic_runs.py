import hashlib
import random
import zlib

import numpy as np

from panelyst.llm import periodic_runs as pr
from panelyst.llm.queries import QUERIES, table, with_period

from ..conftest import DATA
from .helpers import empty, odd


def brute_force(ws, least=12):
    """Runs by definition: every maximal stretch of every period, unless a smaller period holds on it."""
    n, out = len(ws), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            a, e = i, j + q
            if e - a >= max(least, 2 * q) and not any(all(ws[k] == ws[k + d] for k in range(a, e - d)) for d in range(1, q)):
                out.append((a, e - a, q))
            i = j
    return sorted(out)


def collapsed(ws, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def digests(doc_id, text):
    ws = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()), len(ws)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_force(ws)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(collapsed(ws, runs)))


def samples():
    rng = random.Random(5)
    for k in range(300):
        n, kinds = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 30])
        ws = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.randrange(kinds + 2) for _ in range(rng.randint(1, 25))]
            if rng.random() < 0.3:
                unit = unit * 3 + unit[: len(unit) // 2]
            at = rng.randint(0, len(ws))
            ws[at:at] = (unit * 9)[: rng.randint(1, 7 * len(unit))]
        yield ws
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [0] * 200
    yield [0, 1, 0, 2] * 60


def test_runs_by_brute_force():
    for ws in samples():
        ids = np.array(ws, np.int64)
        want = brute_force(ws)
        for long_words in (4096, 30, 1):
            assert pr.runs_of(ids, long_words=long_words) == want


def test_long_texts():
    """A text of 300,000 words: one word repeated, a long period, and chance words, each in a bounded number of lags."""
    rng = np.random.default_rng(2)
    n = 300_000
    assert pr.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    noise = rng.integers(0, 50_000, n)
    assert pr.runs_of(noise) == []
    unit = rng.integers(0, 50_000, 70_001)
    assert pr.runs_of(np.concatenate([noise[:50_000], np.tile(unit, 3)])) == [(50_000, 210_003, 70_001)]


def test_collapse():
    ws = [b"a", *[b"x", b"y"] * 8, b"b"]
    ids = np.array([0, *[1, 2] * 8, 3])
    assert pr.runs_of(ids) == [(1, 16, 2)] and pr.collapse(ws, pr.runs_of(ids)) == b"a x y b"


def test_odd_rows(spark):
    df = odd(spark)
    got = pr.find_runs(df).collect()
    key = lambda r: str(r)
    want = []
    for r in df.select("doc_id", "text").collect():
        ws = [w.decode() for w in (r.text or "").encode().split()]
        runs = [(0, 3000, 1)] if len(ws) > 3000 and len(set(ws[1:])) == 1 else brute_force(ws)
        runs = [(1, 3000, 1)] if len(ws) == 3001 else runs
        want.append((r.doc_id, len(ws), runs, collapsed(ws, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert pr.find_runs(empty(spark)).count() == 0
    assert with_period(odd(spark)).count() == df.count() and with_period(empty(spark)).count() == 0


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    short = {d for d, t in rows if len((t or "").split()) < 1200}
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows)
    for d, t in rows:
        if d in short:
            assert got[d] == digests(d, t)
