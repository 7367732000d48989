import random

import pytest

from panelyst.llm import suffix_array as sa

from .helpers import empty


@pytest.mark.parametrize("text", ["mississippi", "aaaaaaa", "abcabcabcab", "ab", "abc", "banana"])
def test_all_suffixes_in_order(spark, text):
    df = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, s long")
    assert [r.pos for r in sa.ranks(df, len(text)).orderBy("rank").collect()] == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_strings_by_brute_force(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abc ") for _ in range(60))
    rows = [(i, base[rng.randrange(30) :][: rng.randint(5, 30)] + "".join(rng.choice("xyz") for _ in range(9))) for i in range(8)] + [(8, None), (9, ""), (None, base), (8, "é" * 12), (9, base)]
    length = 12
    ordered = sorted(((d is not None, d or 0, (t or "").encode()) for d, t in rows))
    raw = [t for *_, t in ordered]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    want = {(d, i) for d, t in enumerate(raw) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}
    got = sa.repeated_starts(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert {(r.doc, r.start) for r in got} == want and len(want) > 20
    assert sa.repeated_starts(empty(spark), length).count() == 0
