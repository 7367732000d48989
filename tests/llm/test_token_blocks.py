import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyst.llm import token_blocks as tb
from panelyst.llm.queries import tokenizer_path

from .helpers import empty, odd


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
def test_blocks_round_trip(values):
    x = np.array(values, np.uint32)
    data = tb.encode_blocks(x)
    assert (tb.decode_blocks(data) == x).all() and len(tb.decode_blocks(data)) == len(x)
    assert (tb.decode_blocks(data, 1, 3) == x[128:384]).all()


def test_exceptions_keep_widths_small():
    x = np.full(1280, 7, np.uint32)
    x[::100] = 50_000
    assert len(tb.encode_blocks(x)) < 1280


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("abSTRE  '\n\t\r\x0b\x85\xa0é1½²_-.,!<|>’漢😀\x1c\x00sdmtrvel"), max_size=40))
def test_pieces_are_those_of_the_library(text):
    e = _encoder()
    assert e.encode([text, "x", text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def _encoder():
    global _E
    if "_E" not in globals():
        _E = tb.Encoder(tokenizer_path(), keep=200)
    return _E


def test_write_and_read(spark):
    docs = odd(spark)
    got = tb.read_tokens(spark, tb.write_tokens(docs, tokenizer_path()), with_ids=True).toPandas()
    rows = docs.select("doc_id", "text").collect()
    t = _encoder().tokenizer
    want = sorted((-1 if r.doc_id is None else r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in rows)
    seen = sorted((-1 if d != d or d is None else int(d), list(map(int, i))) for d, i in zip(got.doc_id, got.ids, strict=True))
    assert seen == want
    got = got.sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    known = got.doc_id.dropna().tolist()
    assert known == sorted(known) and got.doc_id.isna().tolist()[:2] == [True, True]
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
    assert tb.read_tokens(spark, tb.write_tokens(empty(spark), tokenizer_path())).count() == 0
