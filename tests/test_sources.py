import json

from pyspark.sql import functions as F

from panelyst.operators import blocking
from panelyst.sources import feed, pages
from panelyst.sources.paged import PagedFeed, page_url
from panelyst.streaming import resolving

from .test_engine import BRAND, ITEM

PRODUCT = {"code": "0301871239013", "product_name": "Moisturizing Cream", "brands": "CeraVe, Other", "quantity": "454 g", "ingredients_text": "a, b", "ingredients": [{"text": "Purified Water"}, {"text": ""}, {"text": "Glycerin"}, {"text": "Cetyl Alcohol"}, {"text": "Ceramide NP"}, {"text": "Phenoxyethanol"}], "ecoscore_score": 47, "ecoscore_grade": "d", "unknown": [1], "packagings": [{"material": " en:glass "}, {"material": None}], "categories_tags": ["en:face-creams"]}
ANSWERS = [
    {"code": "1", "status": 1, "product": PRODUCT}, {"code": "2", "status": 0, "status_verbose": "product not found"}, {"product": PRODUCT},
    {"status": 1, "product": {**PRODUCT, "code": "55", "brands": 7}}, {"status": 1, "product": {k: v for k, v in PRODUCT.items() if k != "ingredients"} | {"code": "12345678", "brands": "New House", "product_name": "Other Thing", "ecoscore_score": None}},
]


def test_feed_parsing(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, ANSWERS)) + "\nnot json\n")
    landed = feed.read_landed(spark, f"file://{tmp_path}/x.json")
    good, bad = feed.parsed(landed)
    assert good.count() == 2 and bad.count() == 3
    r = {x.native_id: x for x in feed.normalized(good, "2024-01-01 00:00:00").collect()}
    c = r["0301871239013"]
    assert c.ingredients == ["Purified Water", "Glycerin", "Cetyl Alcohol", "Ceramide NP", "Phenoxyethanol"] and (c.brand, c.size_value, c.size_unit, c.category) == ("CeraVe", 454.0, "g", "face creams")
    assert r["12345678"].ingredients == ["a", "b"] and feed.ratings_of(feed.normalized(good, "2024-01-01 00:00:00")).count() == 1
    assert good.select(feed.extract_materials(F.col("product"))).first()[0] == ["en:glass"]
    assert feed.wanted_barcodes(landed, ["0-1"]).count() == 0 and feed.wanted_barcodes(landed, ["1"]).count() == 1
    assert feed.job_arguments(["301", "--limit", "5", "--page-size", "900"]).page_size == 100


def test_ingestion_is_idempotent(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, ANSWERS)))
    good, _ = feed.parsed(feed.read_landed(spark, f"file://{tmp_path}/x.json"))
    brands = spark.createDataFrame([("cerave", "CeraVe", None, [], 0)], BRAND)
    entry = spark.createDataFrame([("cat", "CeraVe", "Moisturizing Cream", "301871239013", ["purified water", "glycerin", "cetyl alcohol", "ceramide np", "phenoxyethanol"], 454.0, "g", 0)], ITEM)
    catalog = blocking.prepared(entry.withColumn("product_id", F.lit("p1")), brands)
    out = feed.ingest(good, catalog, brands, "2024-01-01 00:00:00")
    match = {r.listing_id: r for r in out["match"].collect()}
    assert match["obf-0301871239013"].product_id == "p1" and match["obf-0301871239013"].method == "obf-auto"
    new = match["obf-12345678"]
    assert (new.product_id, new.method, new.confidence) == ("prod-obf-12345678", "obf-new", 1.0)
    assert [(b.id, b.name) for b in out["brand"].collect()] == [("brand-obf-newhouse", "New House")] and out["product"].count() == 1
    old = out["match"].withColumn("reviewed", F.lit(True))
    again = feed.upserted(old, out["match"], "listing_id", ("reviewed",))
    assert again.count() == 2 and all(r.reviewed for r in again.collect())
    assert feed.replaced_ratings(out["rating"], out["rating"].limit(0), out["listing"]).count() == 0
    at = f"file://{tmp_path}/table"
    feed.write_swap(out["match"], at)
    feed.write_swap(feed.upserted(spark.read.parquet(at), out["match"], "listing_id"), at)
    assert spark.read.parquet(at).count() == 2


AMAZON = """<html><body><span id="productTitle"> Rich  Cream SPF 30 </span><a id="bylineInfo">Visit the CeraVe Store</a>
<div id="wayfinding-breadcrumbs_feature_div"><a>Beauty &amp; Personal Care</a><a>Skin Care</a></div>
<div><h4>Ingredients</h4><p>Aqua, Glycerin, Zinc Oxide</p></div><table><tr><th>UPC</th><td>999999999999</td></tr></table>
<div id="detailBullets_feature_div"><li>UPC : 301871239013</li></div><img id="landingImage" src="http://x/y.jpg"></body></html>"""
SEPHORA = """<html><body><nav aria-label="Breadcrumb"><ol><li><a>Home</a></li><li><a>Skincare</a></li><li><a>Skincare</a></li></ol></nav><h1 data-at="product_name">Acid Serum</h1>
<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": ["Product"], "brand": {"name": "The Ordinary"}, "gtin13": "0769915190311"}]}</script>
<div><div><h2>Ingredients</h2></div><div><p>Aqua, Glycerin, Sodium Hyaluronate, Pentylene Glycol, Phenoxyethanol</p></div></div></body></html>"""


def test_pages(spark):
    rows = [(1, "https://www.amazon.com/some/dp/B00TTD9BRC?th=1", AMAZON), (2, "https://www.sephora.com/product/acid-P1", SEPHORA), (3, "https://www.amazon.com/gp/help", AMAZON), (4, "https://evilamazon.com/dp/B00TTD9BRC", AMAZON), (5, "https://www.sephora.com/product/x", "<p>none"), (6, None, None)]
    got = {r.page_id: r for r in pages.sightings(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2}
    a, s = got[1], got[2]
    assert (a.raw_name, a.raw_brand, a.raw_gtin, a.asin) == ("Rich Cream SPF 30", "CeraVe", "301871239013", "B00TTD9BRC") and a.raw_ingredients == ["aqua", "glycerin", "zinc oxide"]
    assert a.category == ["Beauty & Personal Care", "Skin Care"] and a.image_url == "http://x/y.jpg"
    assert (s.raw_name, s.raw_brand, s.raw_gtin, s.category) == ("Acid Serum", "The Ordinary", "0769915190311", ["Skincare"]) and len(s.raw_ingredients) == 5


def test_cosmetics(spark):
    rows = [("Rich cream", ["Beauty"]), ("Thing", ["Beauty", "Skin Care"]), ("Cream cheese", ["Food"]), ("Thing", None), ("Thing", ["Beauty"])]
    got = spark.createDataFrame(rows, "n string, c array<string>").select(pages.classify_cosmetic(F.col("n"), F.col("c")).alias("k")).collect()
    assert [r.k.cosmetic for r in got] == [True, True, False, False, False] and got[2].k.reason == "noun-only[cream]" and got[3].k.reason == "no signals"


def opened(url):
    page = int(url.split("page=")[1].split("&")[0])
    return json.dumps({"count": 5, "page_size": 2, "products": [{"code": str(page * 10 + i)} for i in range(2 if page < 3 else 1)]})


def test_paged_source(spark):
    spark.dataSource.register(PagedFeed)
    df = spark.read.format("paged_feed").options(base="http://x", opener="tests.test_sources.opened", page_size="2").load()
    assert sorted(json.loads(r.raw)["code"] for r in df.collect()) == ["10", "11", "20", "21", "30"]
    assert page_url("http://x", 2, 500, "a b", "k=v") == "http://x?page=2&page_size=100&json=1&search_terms=a+b&k=v"


def test_enrichment(spark):
    item = {"ASIN": "B1", "ItemInfo": {"Title": {"DisplayValue": "T"}, "ByLineInfo": {"Manufacturer": {"DisplayValue": "M"}}, "ExternalIds": {"UPCs": {"DisplayValues": ["012345678905"]}}}}
    rows = [("B1", json.dumps({"ItemsResult": {"Items": [{"ASIN": "B0"}, item]}})), ("B2", json.dumps({"ItemsResult": {"Items": [item]}})), ("B3", "{}")]
    got = feed.enrichment(spark.createDataFrame(rows, "asin string, json string")).collect()
    assert [(r.asin, r.title, r.brand, r.gtin) for r in got] == [("B1", "T", "M", "012345678905")]


def test_streams(spark, tmp_path):
    brands = spark.createDataFrame([("cerave", "CeraVe", None, [], 0)], BRAND)
    entry = spark.createDataFrame([("cat", "CeraVe", "Rich Cream", None, ["a b", "c d", "e f", "g h", "i j"], None, None, 0)], ITEM).withColumn("product_id", F.lit("p1"))
    seen = spark.createDataFrame([("s1", "cerave", "Rich Cream", None, ["a b", "c d", "e f", "g h", "i j"], None, None, 0, ["Beauty"]), ("s2", "cerave", "Hammer", None, None, None, None, 1, ["Tools"])], f"{ITEM}, category array<string>")
    seen.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(seen.schema).parquet(f"file://{tmp_path}/in")
    q = resolving.resolve_stream(stream, lambda: (blocking.prepared(entry, brands), brands), f"file://{tmp_path}/out", f"file://{tmp_path}/ck", once=True)
    q.awaitTermination(120)
    got = {r.id: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got["s1"].product_id == "p1" and got["s2"].product_id is None and not got["s2"].cosmetic


def test_pages_are_parsed_once_and_in_many_tasks(spark):
    """A filter on what is parsed stays above the parser, and a small table's pages aren't one task's work."""
    from panelyst.plans.feed_queries import page_sightings, sighting_items

    for query in (page_sightings, sighting_items):
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and df.rdd.getNumPartitions() > 4


def test_landed_answers_are_dealt(spark):
    """A small table's answers are made and parsed in many tasks."""
    from panelyst.plans.feed_queries import _landed

    assert _landed(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
