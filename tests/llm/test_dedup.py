import random
import time

import pytest

from panelyst.llm import line_dedup as ld
from panelyst.llm import substring_dedup as sd

from ..conftest import DATA
from .helpers import empty, odd


def check_spans(df, length):
    got = sd.repeated_spans(df, length).collect()
    rows = df.select("doc_id", "text").collect()
    spans = sd.brute_force([(r.text or "").encode() for r in rows], length)
    key = lambda d, n, s, k: (-1 if d is None else d, n, s, k)
    want = []
    for r, s in zip(rows, spans, strict=True):
        raw = (r.text or "").encode()
        kept, at = b"", 0
        for a, b in s:
            kept, at = kept + raw[at:a], b
        want.append(key(r.doc_id, len(raw), [list(x) for x in s], kept + raw[at:]))
    seen = [key(r.doc_id, r.n_bytes, [[x["first"], x["end"]] for x in r.spans], bytes(r.kept)) for r in got]
    assert sorted(seen) == sorted(want)


def test_substrings_by_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            b, a = rng.choice(base), rng.randint(0, 200)
            t += b[a : a + rng.randint(20, 180)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, "q" * 500), (1003, "é" * 90), (1004, "ab" * 300), (None, base[0])]
    check_spans(spark.createDataFrame(rows, "doc_id long, text string"), 100)


def test_query_by_brute_force(spark, monkeypatch):
    """400 bytes over a whole table and many shards, and passages that are too short to go."""
    monkeypatch.setattr(sd, "SHARD_BYTES", 16 << 10)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(52))
    assert 250 < len(passage) < 400
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    planted = [(10_000 + i, " ".join(word() for _ in range(40)) + f" {i} {passage} {i} " + " ".join(word() for _ in range(40))) for i in range(6)]
    fresh = [(20_000 + i, " ".join(word() for _ in range(120))) for i in range(20)]
    df = spark.createDataFrame(texts + planted + fresh, "doc_id long, text string").repartition(5)
    check_spans(df, 400)
    got = {r.doc_id: r for r in sd.repeated_spans(df).collect()}
    assert all(got[d].longest_shared >= 64 and not got[d].spans for d, _ in planted)
    assert all(got[d].longest_shared == 0 for d, _ in fresh)


def test_substrings_of_odd_rows(spark):
    check_spans(odd(spark), 40)
    assert sd.repeated_spans(empty(spark)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (5, 15, 16, 40, 64, 65, 100, 128, 129, 200)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            p = rng.randrange(len(s))
            lines.append(rng.choice([s, s[:p] + s[p + 1 :], s[:p] + "z" + s[p:], s[:p] + "y" + s[p + 1 :], "", "  ", "".join(rng.choice("qrst") for _ in range(30))]))
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, base[3] + "\n" + base[3])]
    got = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []
    for d, t in rows:
        lines, kept, near = (t or "").split("\n"), [], 0
        for s in lines:
            if not s.strip(" "):
                kept.append(s)
                continue
            again = s in seen
            close = any(abs(len(o) - len(s)) < 2 and distance(s, o) <= 1 for o in seen if o != s)
            seen.append(s)
            near += close and not again
            if not (again or close):
                kept.append(s)
        assert got[d].text == (None if t is None else "\n".join(kept)), d
        assert (got[d].n_lines, got[d].n_removed, got[d].n_near) == (len(lines), len(lines) - len(kept), near)


def test_lines_of_odd_rows(spark):
    docs = odd(spark)
    out = ld.dedup_lines(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    by = {}
    for r in out.collect():
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.text)
    assert all(len(v) == 1 for v in by.values())
    assert ld.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [63, 64, 65, 127, 128, 129, 4095, 4096, 4097, 5000])
def test_one_edit_anywhere(spark, n):
    """A character put in, left out or changed at either end of a block, of a run of blocks and of the line; two edits are too many."""
    rng = random.Random(n)
    base = "".join(rng.choice("abcdefé") for _ in range(n))
    at = sorted({p for e in (0, 1, 62, 63, 64, 65, 127, 128, n // 2, 4095, 4096, n - 2, n - 1) for p in [e] if 0 <= p < n})
    edits = [base[:p] + x + base[p + y :] for p in at for x, y in (("X", 1), ("X", 0), ("", 1))] + [base + "X"]
    far = ["Y" + base[1:-1] + "Z", "Y" + base + "Z", base[1:-1]]
    rows = [(0, base)] + [(1 + i, t) for i, t in enumerate(edits)] + [(1000 + i, t) for i, t in enumerate(far)]
    got = {r.doc_id: r.n_removed for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[1 + i] == 1 for i in range(len(edits)))
    near = lambda a, b: any(a[:i] == b[:i] and a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] for i in range(max(len(a), len(b)) + 1))
    assert all(got[1000 + i] == int(any(near(t, u) for u in [base, *edits, *far[:i]])) for i, t in enumerate(far))


def test_long_lines_and_many_lines(spark):
    """A line of a megabyte with a near copy, and a document of 200,000 equal lines, each within a minute."""
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    other = line[:700_000] + "Z" + line[700_001:]
    many = "the same line\n" * 200_000
    for rows, want in (([(1, line), (2, other)], {1: 0, 2: 1}), ([(1, many)], {1: 199_999})):
        start = time.time()
        got = {r.doc_id: r.n_removed for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want and time.time() - start < 60
