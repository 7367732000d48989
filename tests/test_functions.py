import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelyst.functions import hashing, text, variants
from panelyst.functions.similarity import jaro_winkler, jaro_winkler_of

WORDS = "Aqua|Glycerin|Cetearyl Alcohol|Caprylic/Capric Triglyceride|Ceramide NP|Niacinamide|Squalane|Panthenol|Tocopherol".split("|")


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


def test_hashes(spark):
    assert hashing.seeds()[:3] == [1120982980, 3911581779, 1066994070]
    r = one(spark, [("aqua",)], "s string", hashing.fnv1a32(F.col("s")).alias("f"), hashing.fmix32(hashing.fnv1a32(F.col("s")).bitwiseXOR(F.lit(1120982980))).alias("m"))[0]
    assert (r.f, r.m) == (1110921109, 1956454920)


def test_band_keys(spark):
    sets = [(WORDS + ["Phenoxyethanol"],), (WORDS + ["Allantoin"],), (list(reversed(WORDS + ["Phenoxyethanol"])),), (WORDS[:4],), (None,)]
    got = [r[0] for r in one(spark, sets, "i array<string>", hashing.ingredient_keys(text.normalized_set(F.col("i"))))]
    assert got[0][:4] == ["ing:0:2y3xw0", "ing:1:19w28ss", "ing:2:14zba3u", "ing:3:5cirdd"]
    assert len(set(got[0]) & set(got[1])) == 10 and got[2] == got[0] and got[3] == got[4] == []


def test_normalisers(spark):
    c = F.col("s")
    rows = [("  Ünïts & Cream-50ml ",), ("the NEW Daily Glow",), (None,), ("...",)]
    got = one(spark, rows, "s string", text.normalize_name(c).alias("n"), text.strip_norm(c).alias("b"), text.first_name_token(c).alias("t"), text.js_trim(c).alias("j"), text.ingredient_slug(c).alias("g"))
    assert [r.n for r in got] == ["n ts cream 50ml", "the new daily glow", None, ""]
    assert [r.t for r in got] == ["cream", "glow", None, None]
    assert got[0].j == "Ünïts & Cream-50ml" and got[1].b == "thenewdailyglow" and got[1].g == "the-new-daily-glow"


@pytest.mark.parametrize(("raw", "want"), [("012345678905", "00012345678905"), ("0 12345-67890 5", "00012345678905"), ("1234567", None), ("123456789012345", None), (None, None), ("12345678", "00000012345678")])
def test_barcodes(spark, raw, want):
    assert one(spark, [(raw,)], "s string", text.normalize_gtin(F.col("s")))[0][0] == want


def test_quantities(spark):
    got = [tuple(r[0]) for r in one(spark, [("30 ml",), ("1.7 fl oz",), ("a lot",), ("1.2.3 g",), (None,)], "s string", text.parse_quantity(F.col("s")))]
    assert got == [(30.0, "ml"), (1.7, "fl"), (None, None), (None, None), (None, None)]


def test_lists_and_rounds(spark):
    r = one(spark, [("Aqua, Glycerin • x · Zinc  Oxide", -5.5, 2.5)], "s string, a double, b double", text.split_ingredients(F.col("s")).alias("l"), text.js_round(F.col("a")).alias("a"), text.js_round(F.col("b")).alias("b"))[0]
    assert r.l == ["aqua", "glycerin", "zinc oxide"] and (r.a, r.b) == (-5, 3)
    s = one(spark, [(["a", "b"], ["b", "c", "d"]), ([], [])], "x array<string>, y array<string>", text.jaccard(F.col("x"), F.col("y")).alias("j"), text.overlap_coefficient(F.col("x"), F.col("y")).alias("o"))
    assert [(x.j, x.o) for x in s] == [(0.25, 0.5), (0.0, 0.0)]
    cats = one(spark, [(["en:a", "en:face-creams"], None), ([], "x, y "), (None, None)], "t array<string>, c string", text.extract_category(F.col("t"), F.col("c")))
    assert [x[0] for x in cats] == ["face creams", "y", "uncategorized"]


CONFLICTS = [
    ("Sun SPF 30", "Sun SPF 50", True), ("Sun SPF 30", "Sun spf30", False), ("Acid 2%", "Acid 2.0 %", False), ("Acid 2%", "Acid 10%", True), ("Cream AM", "Cream PM", True),
    ("Soap Rose", "Soap Lavender Rose", False), ("Soap Rose", "Soap Mint", True), ("Foundation 120", "Foundation 0120", False), ("Foundation 120 30 ml", "Foundation 240", True),
    ("Wipes 2 pack", "Wipes pack of 3", True), ("Cream", "Cream SPF 30", False), ("é60 tint 120", "tint 120", False),
]


def test_variant_conflicts(spark):
    got = one(spark, CONFLICTS, "a string, b string, want boolean", "a", "want", variants.variants_conflict(variants.variant_tokens(F.col("a")), variants.variant_tokens(F.col("b"))).alias("got"))
    assert [r.got for r in got] == [r.want for r in got]


def test_mutations_conflict_with_their_source(spark):
    names = [("Sun SPF 50",), ("Acid 2%",), ("Cream AM",), ("Foundation 120",), ("Wipes 2 Pack",), ("Rose Soap",), ("Nude Lipstick",), ("Plain Cream",), (None,)]
    df = spark.createDataFrame(names, "a string").withColumn("b", variants.mutate_variant_token(F.col("a")))
    got = df.select("a", "b", variants.variants_conflict(variants.variant_tokens(F.col("a")), variants.variant_tokens(F.col("b"))).alias("c")).collect()
    assert [r.b for r in got][:5] == ["Sun SPF 30", "Acid 7%", "Cream PM", "Foundation 220", "Wipes 1 Pack"]
    assert all(r.c for r in got[:7]) and got[7].b is None and got[8].b is None


def test_jaro_winkler(spark):
    got = one(spark, [("martha", "marhta"), ("abc", "abc"), ("", "x"), ("abcdef", "uvwxyz"), (None, "x")], "a string, b string", jaro_winkler(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(0.961111, abs=1e-6) and [r[0] for r in got[1:4]] == [1.0, 0.0, 0.0] and got[4][0] is None


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_winkler_stays_in_range(a, b):
    v = jaro_winkler_of(a, b)
    assert 0 <= v <= 1 + 1e-12 and (v == 1 or a != b)
