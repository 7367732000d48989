"""Registered queries of ingestion, product pages, views, flags and small reads over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import agreement, catalog, graph, matching, raters, scoring, search, training
from ..sources import feed, store, stored
from ..sources import pages as shop_pages
from . import adapters as a
from .catalog_queries import AXIS_ORD, BAND, COMPOSITE, ETH, GTIN, HAZ, ITEMS, MAT, PROBS, STRIP, TIER, _pillars, _probs, _products, _rated, r6, registered
from .matching_queries import ABLE, FEATURED, HITS, UNSIZED_HITS, _prepared, _seen, full_sql, jaro_sql, probability_sql

NOW = "2024-01-01 00:00:00"

# ------------------------------------------------------------------------------------------------ the feed

#: part as answers of the feed, in SQL: what the JSON texts of _landed() hold.
ANSWER = f"""answer AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS code, p_name AS name,
         CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' || p_brand || ' , Second' ELSE p_brand END AS brands,
         ['250 ml', '1.7 fl oz', 'a lot', NULL, ' 30ML x 2'][CAST(p_partkey % 5 AS INT) + 1] AS quantity, CASE WHEN p_partkey % 3 = 0 THEN ['en:hair-care_products', 'en:' || lower(p_type) || '-things'] END AS tags,
         CASE WHEN p_partkey % 3 = 1 THEN 'Skin, ' || p_type || ' ' END AS categories, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 101)::DOUBLE END AS eco_score, CASE WHEN p_partkey % 2 = 0 THEN 'b' END AS grade
  FROM part WHERE p_partkey % 11 NOT IN (1, 2, 3) AND p_partkey % 7 <> 0 OR p_partkey = 0)"""


def _landed(spark, d) -> DataFrame:
    """part as landed answers: most found, of eleven one not found, one broken and one with a wrong type."""
    p, k = a.dealt(a.table(spark, d, "part"), "p_partkey"), F.col("p_partkey")
    null = F.lit(None).cast("string")
    code = F.when(k % 7 == 0, "").otherwise(F.lpad(k.cast("string"), 13, "0"))
    product = F.struct(
        code.alias("code"), F.col("p_name").alias("product_name"),
        F.when(k % 4 == 0, null).when(k % 4 == 1, F.concat(F.lit("  "), "p_brand", F.lit(" , Second"))).otherwise(F.col("p_brand")).alias("brands"),
        F.element_at(F.array(F.lit("250 ml"), F.lit("1.7 fl oz"), F.lit("a lot"), null, F.lit(" 30ML x 2")), (k % 5 + 1).cast("int")).alias("quantity"),
        F.when(k % 3 == 0, F.array(F.lit("en:hair-care_products"), F.concat(F.lit("en:"), F.lower("p_type"), F.lit("-things")))).alias("categories_tags"),
        F.when(k % 3 == 1, F.concat(F.lit("Skin, "), "p_type", F.lit(" "))).alias("categories"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit(" Aqua ").alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.col("p_name").alias("text")))).alias("ingredients"),
        F.when(k % 2 == 1, F.concat(F.lit("Water, "), "p_brand", F.lit(", , Parfum "))).alias("ingredients_text"),
        F.when(k % 2 == 0, (k % 101).cast("double")).alias("ecoscore_score"), F.when(k % 2 == 0, "b").alias("ecoscore_grade"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("en:glass").alias("material"), F.lit("jar").alias("shape")))).alias("packagings"),
        F.when(k % 4 == 2, F.array(F.lit("en:pp-polypropylene"))).alias("packaging_materials_tags"), F.array(F.lit("en:box")).alias("packaging_tags"),
    )
    found = F.to_json(F.struct(code.alias("code"), F.lit(1).alias("status"), product.alias("product")))
    raw = F.when(k % 11 == 1, F.to_json(F.struct(code.alias("code"), F.lit(0).alias("status"), F.lit("product not found").alias("status_verbose"))))
    raw = raw.when(k % 11 == 2, F.lit("{broken")).when(k % 11 == 3, F.to_json(F.struct(F.lit(1).alias("status"), F.struct(k.alias("product_name")).alias("product")))).otherwise(found)
    # answers without a code share one; one of them is enough
    return p.where((k % 7 != 0) | (k == 0)).select(raw.alias("raw"))


def _rows(spark, d) -> DataFrame:
    return feed.normalized(feed.parsed(_landed(spark, d))[0], NOW)


LISTING = f"""{ANSWER},
norm AS (SELECT k, 'obf-' || code AS id, code AS native_id, name, nullif(trim(split_part(coalesce(brands, ''), ',', 1)), '') AS brand, nullif(code, '') AS gtin,
  CASE WHEN k % 2 = 0 THEN 'Aqua|' || name ELSE 'Water|' || (SELECT p_brand FROM part WHERE p_partkey = k) || '|Parfum' END AS ingredients,
  CASE k % 5 WHEN 0 THEN 250.0 WHEN 1 THEN 1.7 WHEN 4 THEN 30.0 END::DOUBLE AS size_value, CASE k % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'fl' WHEN 4 THEN 'ml' END AS size_unit,
  'https://world.openbeautyfacts.org/product/' || code AS url, CASE k % 3 WHEN 0 THEN replace(substr(tags[2], 4), '-', ' ') WHEN 1 THEN trim(split_part(categories, ',', 2)) ELSE 'uncategorized' END AS category,
  eco_score, upper(grade) AS eco_grade FROM answer)"""


@registered("feed_listings", f"WITH {LISTING} SELECT * EXCLUDE (k), 'obf-eco' AS source_id FROM norm")
def feed_listings(spark, d):
    """Valid answers of the feed as items and listings."""
    out = _rows(spark, d)
    return out.select("id", "source_id", "native_id", "name", "brand", "gtin", F.array_join("ingredients", "|").alias("ingredients"), "size_value", "size_unit", "url", "category", "eco_score", "eco_grade")


@registered("feed_quarantine", "SELECT CASE p_partkey % 11 WHEN 2 THEN '{broken' ELSE '{\"status\":1,\"product\":{\"product_name\":' || p_partkey || '}}' END AS raw FROM part WHERE p_partkey % 11 IN (2, 3) AND p_partkey % 7 <> 0")
def feed_quarantine(spark, d):
    """Answers that are no JSON or have a wrong type."""
    return feed.parsed(_landed(spark, d))[1]


@registered("feed_ratings", f"WITH {LISTING} SELECT 'r-' || id || '-eco' AS id, id AS listing_id, eco_score AS score_raw, eco_grade AS score_label FROM norm WHERE eco_score IS NOT NULL")
def feed_ratings(spark, d):
    return feed.ratings_of(_rows(spark, d)).select("id", "listing_id", "score_raw", "score_label")


@registered("feed_brands", f"""WITH {a.BRAND}, {LISTING}, alias AS (SELECT alias, arg_min(id, ord) AS brand_id FROM (SELECT id, ord, {STRIP.format(x='n')} AS alias FROM (SELECT id, ord, unnest(list_distinct(list_prepend(name, aliases))) AS n FROM brand)) GROUP BY alias)
SELECT norm.id, coalesce(brand_id, CASE WHEN brand IS NULL THEN 'brand-unknown' ELSE 'brand-obf-' || {STRIP.format(x='brand')} END) AS brand_id, CASE WHEN brand_id IS NULL THEN coalesce(brand, 'Unknown') END AS minted_name
FROM norm LEFT JOIN alias ON alias.alias = {STRIP.format(x="coalesce(brand, '')")}""")
def feed_brands(spark, d):
    """Known, minted and unknown brands of the feed's rows."""
    return feed.ensured_brands(_rows(spark, d), a.brands(spark, d))


@registered("feed_materials", f"""WITH {ANSWER} SELECT 'obf-' || code AS listing_id, CASE k % 4 WHEN 0 THEN 'en:glass' WHEN 2 THEN 'en:pp-polypropylene' ELSE 'en:box' END AS materials FROM answer""")
def feed_materials(spark, d):
    """Materials of stored answers: of parts, else material tags, else mixed tags."""
    return _rows(spark, d).select(F.col("id").alias("listing_id"), F.array_join(feed.materials_of_payload(F.col("payload")), "|").alias("materials"))


@registered("feed_first_materials", f"""WITH {ANSWER}, m AS (SELECT 'p' || k % 50 AS product_id, 'obf-' || code AS listing_id, CASE k % 4 WHEN 0 THEN 'en:glass' WHEN 2 THEN 'en:pp-polypropylene' ELSE 'en:box' END AS materials, k FROM answer)
SELECT product_id, arg_min(materials, listing_id) AS materials FROM m GROUP BY product_id""")
def feed_first_materials(spark, d):
    """Materials of each product's first listing of the feed that has any."""
    rows = _rows(spark, d)
    key = F.coalesce(F.col("gtin").cast("long"), F.lit(0)) % 50
    match = rows.select(F.col("id").alias("listing_id"), F.concat(F.lit("p"), key.cast("string")).alias("product_id"))
    return feed.first_materials(match, rows.select("id", "source_id", "payload")).select("product_id", F.array_join("materials", "|").alias("materials"))


STORED = "CASE WHEN p_partkey % 2 = 0 THEN 'obf-' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') ELSE 'old-' || p_partkey END"


def _stored(spark, d) -> DataFrame:
    """Listings of an earlier run, half of them with ids of the feed; a third reviewed."""
    k = F.col("p_partkey")
    own = F.when(k % 2 == 0, F.concat(F.lit("obf-"), F.lpad(k.cast("string"), 13, "0"))).otherwise(F.concat(F.lit("old-"), k.cast("string")))
    return a.table(spark, d, "part").select(own.alias("id"), F.lit("was").alias("raw_name"), F.when(k % 3 == 0, F.lit("human")).alias("reviewer"))


@registered("feed_upsert", f"""WITH {LISTING}, old AS (SELECT {STORED} AS id, 'was' AS raw_name, CASE WHEN p_partkey % 3 = 0 THEN 'human' END AS reviewer FROM part)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM norm) UNION ALL SELECT norm.id, name, coalesce(old.reviewer, 'none') FROM norm LEFT JOIN old USING (id)""")
def feed_upsert(spark, d):
    """Stored listings with those of the feed put in; a human's review stays."""
    new = _rows(spark, d).select("id", F.col("name").alias("raw_name"), F.lit("none").alias("reviewer"))
    return feed.upserted(_stored(spark, d), new, "id", keep=("reviewer",))


@registered("feed_replaced_ratings", f"""WITH {LISTING}, old AS (SELECT {STORED} AS listing_id, 1.0::DOUBLE AS score_raw FROM part)
SELECT * FROM old WHERE listing_id NOT IN (SELECT id FROM norm) UNION ALL SELECT id, eco_score FROM norm WHERE eco_score IS NOT NULL""")
def feed_replaced_ratings(spark, d):
    """Ratings of listings that were written again are replaced, also by none."""
    rows = _rows(spark, d)
    old = _stored(spark, d).select(F.col("id").alias("listing_id"), F.lit(1.0).alias("score_raw"))
    return feed.replaced_ratings(old, feed.ratings_of(rows).select("listing_id", "score_raw"), rows)


@registered("feed_barcodes", f"WITH {ANSWER} SELECT code FROM answer WHERE code IN ('0000000000005', '0000000000016', '0000000000040')")
def feed_barcodes(spark, d):
    """Landed answers of given barcodes."""
    found = feed.wanted_barcodes(_landed(spark, d), ["0000000000005", " 0000-0000-00016", "0000000000040"])
    return found.where(F.get_json_object("raw", "$.product").isNotNull()).select(F.get_json_object("raw", "$.code").alias("code"))


@registered("enrichment", "SELECT 'A' || p_partkey AS asin, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Maker' END AS brand, CASE p_partkey % 3 WHEN 0 THEN 'e' || p_partkey WHEN 1 THEN 'u' || p_partkey END AS gtin, p_type AS category FROM part WHERE p_partkey % 5 <> 0")
def enrichment(spark, d):
    """Stored answers of the enrichment service: the item asked for, if it has a title."""
    k = F.col("p_partkey")
    value = lambda c: F.struct(c.alias("DisplayValue"))
    values = lambda c: F.struct(F.array(c).alias("DisplayValues"))
    line = F.struct(F.when(k % 2 == 0, value(F.col("p_brand"))).alias("Brand"), value(F.lit("Maker")).alias("Manufacturer"))
    ids = F.struct(F.when(k % 3 == 0, values(F.concat(F.lit("e"), k.cast("string")))).alias("EANs"), F.when(k % 3 == 1, values(F.concat(F.lit("u"), k.cast("string")))).alias("UPCs"))
    info = F.struct(F.when(k % 5 != 0, value(F.col("p_name"))).alias("Title"), line.alias("ByLineInfo"), F.struct(value(F.col("p_type")).alias("ProductGroup")).alias("Classifications"), ids.alias("ExternalIds"))
    asin = F.concat(F.lit("A"), k.cast("string"))
    other = F.struct(F.lit("other").alias("ASIN"), info.alias("ItemInfo"))
    items = F.struct(F.array(other, F.struct(asin.alias("ASIN"), info.alias("ItemInfo"))).alias("Items"))
    return feed.enrichment(a.table(spark, d, "part").select(asin.alias("asin"), F.to_json(F.struct(items.alias("ItemsResult"))).alias("json")))


# ------------------------------------------------------------------------------------------------ product pages

ASIN = "upper(substr(md5('asin' || p_partkey), 1, 10))"


def _product_pages(spark, d) -> DataFrame:
    """part as product pages of two shops, and pages of neither."""
    p = a.dealt(a.products(spark, d), "ord")
    k, name, brand = F.col("ord"), F.col("display_name"), F.regexp_replace("brand_id", "#", "")
    esc = lambda c: F.regexp_replace(c, "&", "&amp;")
    listed = F.array_join("ingredients", ", ")
    code = F.coalesce(F.col("gtin"), F.lit("none"))
    asin = F.upper(F.substring(F.md5(F.concat(F.lit("asin"), k.cast("string"))), 1, 10))
    one = F.concat(
        F.lit('<html><body><div id="wayfinding-breadcrumbs_feature_div"><ul><li><a href="/b">Beauty &amp; Personal Care</a></li><li><a href="/c">'), F.col("category"),
        F.lit('</a></li></ul></div><img id="landingImage" src="/i/'), k.cast("string"), F.lit('.jpg"><h1><span id="productTitle">\n  '), esc(name), F.lit('  </span></h1><a id="bylineInfo" href="/stores/x">Visit the '), brand,
        F.lit(' Store</a><span class="a-price"><span class="a-offscreen">$'), F.col("size_value").cast("int").cast("string"), F.lit('.00</span></span><div><h4>Ingredients:</h4><p>'), listed,
        F.lit('</p></div><div id="detailBullets_feature_div"><ul><li><b>Weight</b> 3 g</li><li><b>UPC</b> : '), code, F.lit("</li></ul></div></body></html>"),
    )
    two = F.concat(
        F.lit('<html><head><meta property="og:image" content="/s/'), k.cast("string"), F.lit('.png"><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Product", "Thing"], "gtin13": "'), code,
        F.lit('", "brand": {"name": "Other"}}]}</script><script type="application/ld+json">{broken</script></head><body><nav aria-label="breadcrumb"><ol><li><a>Home</a></li><li><a>Makeup</a></li><li><a>'), F.col("category"),
        F.lit("</a></li><li><a>Makeup</a></li></ol></nav>"), F.when(k % 4 == 1, F.concat(F.lit('<a data-at="brand_name">'), brand, F.lit("</a>"))).otherwise(""), F.lit('<h1><span data-at="product_name"> '), esc(name),
        F.lit('</span></h1><b data-at="price">$9</b><div><h2>Ingredients</h2><div><p>a, b</p><div>'), listed, F.lit("</div></div></div></body></html>"),
    )
    url = F.when(k % 2 == 0, F.concat(F.lit("https://www.amazon.com/Thing/dp/"), asin, F.lit("/ref=x"))).when(k % 10 == 9, F.lit("https://example.com/product/9")).otherwise(F.concat(F.lit("https://www.sephora.com/product/p"), k.cast("string")))
    return p.select(k.alias("page_id"), url.alias("url"), F.when(k % 2 == 0, one).otherwise(two).alias("html"))


SEEN = f"""{a.PRODUCT},
seen AS (SELECT ord AS page_id, CASE WHEN ord % 2 = 0 THEN 'amazon' ELSE 'sephora' END AS source, CASE WHEN ord % 2 = 0 THEN {ASIN.replace('p_partkey', 'ord')} END AS asin, display_name AS raw_name,
  CASE WHEN ord % 2 = 0 OR ord % 4 = 1 THEN replace(brand_id, '#', '') ELSE 'Other' END AS raw_brand, gtin AS raw_gtin,
  list_transform(ingredients, lambda i: lower(i)) AS raw_ingredients, CASE WHEN ord % 2 = 0 THEN ['Beauty & Personal Care', category] ELSE ['Makeup', category] END AS category,
  CASE WHEN ord % 2 = 0 THEN '$' || size_value::INT || '.00' ELSE '$9' END AS price_text, CASE WHEN ord % 2 = 0 THEN '/i/' || ord || '.jpg' ELSE '/s/' || ord || '.png' END AS image_url
FROM product WHERE ord % 10 <> 9)"""


@registered("page_sightings", f"""WITH {SEEN} SELECT * REPLACE (array_to_string(raw_ingredients, '|') AS raw_ingredients, array_to_string(category, ' > ') AS category),
CASE WHEN contains(lower(raw_name), 'spf') THEN 'category[' || lower(category[1]) || '] + noun[spf]' ELSE 'no signals' END AS reason, contains(lower(raw_name), 'spf') AS cosmetic FROM seen""")
def page_sightings(spark, d):
    """Sightings of product pages and whether they are of cosmetics."""
    s = shop_pages.sightings(_product_pages(spark, d)).withColumn("c", shop_pages.classify_cosmetic(F.col("raw_name"), F.col("category")))
    return s.select("page_id", "source", "asin", "raw_name", "raw_brand", "raw_gtin", F.array_join("raw_ingredients", "|").alias("raw_ingredients"), F.array_join("category", " > ").alias("category"), "price_text", "image_url", "c.cosmetic", "c.reason")


@registered("sighting_items", f"WITH {SEEN} SELECT CAST(page_id AS VARCHAR) AS id, raw_brand AS brand, raw_name AS name, raw_gtin AS gtin, len(raw_ingredients) AS n, page_id AS ord, asin FROM seen")
def sighting_items(spark, d):
    """Sightings as items to resolve."""
    return shop_pages.sighting_items(shop_pages.sightings(_product_pages(spark, d))).select("id", "brand", "name", "gtin", F.size("ingredients").cast("long").alias("n"), "ord", "asin")


@registered("web_sightings")
def web_sightings(spark, d):
    """The driver's web pages as if they were of shops: most have no product."""
    k, url = F.col("page_id"), F.col("url")
    shop = F.when(k % 2 == 0, F.concat(F.lit("https://www.amazon.com/x/dp/"), F.upper(F.substring(F.md5(url), 1, 10)))).otherwise(F.concat(F.lit("https://www.sephora.com/product/x-"), k.cast("string")))
    s = shop_pages.sightings(a.table(spark, d, "pages").withColumn("url", shop))
    return s.select("page_id", "source", "asin", "raw_name", "raw_brand", "raw_gtin", "category")


def _curated(spark, d) -> DataFrame:
    """Curated shop ids of a tenth of the products."""
    k = F.col("p_partkey")
    return a.table(spark, d, "part").where(k % 10 == 0).select(F.upper(F.substring(F.md5(F.concat(F.lit("asin"), k.cast("string"))), 1, 10)).alias("asin"), F.concat(F.lit("p"), k.cast("string")).alias("product_id"))


@registered("resolve_curated", f"""{HITS}, c AS (SELECT 'p' || p_partkey AS product_id FROM part WHERE p_partkey % 10 = 0)
SELECT 'sighting-' || p.id AS id, coalesce(c.product_id, v.entry) AS product_id, CASE WHEN c.product_id IS NOT NULL THEN 1.0 ELSE round(v.score, 6) END AS confidence, CASE WHEN c.product_id IS NOT NULL THEN FALSE ELSE v.ambiguous END AS ambiguous
FROM product p LEFT JOIN c ON c.product_id = p.id LEFT JOIN verdict v ON v.product = p.id""")
def resolve_curated(spark, d):
    """Sightings by curated shop ids first, the others by the matcher; those that resolve to nothing keep a row."""
    asin = F.lower(F.substring(F.md5(F.concat(F.lit("asin"), F.col("ord").cast("string"))), 1, 10))
    found = matching.resolve_sightings(_seen(spark, d).withColumn("asin", asin), _prepared(spark, d), _curated(spark, d))
    return found.select("id", "product_id", r6("confidence").alias("confidence"), "ambiguous")


@registered("outbound_urls", f"SELECT 'p' || p_partkey AS product_id, 'https://www.amazon.com/dp/' || {ASIN} AS url FROM part WHERE p_partkey % 10 = 0")
def outbound_urls(spark, d):
    """Where the products with a curated shop id are sold."""
    return catalog.outbound_urls(_curated(spark, d))


# ------------------------------------------------------------------------------------------------ views, flags, reads


@registered("product_views", f"""WITH {a.PRODUCT}, {a.BRAND}, {a.PILLARS}
SELECT p.id AS product_id, any_value(display_name) AS display_name, any_value(b.name) AS brand_name, string_agg(q.axis || ' ' || round(representative, 3)::VARCHAR || ' ' || n || ' ' || disagreement::VARCHAR, '; ' ORDER BY {AXIS_ORD.replace('axis)', 'q.axis)')}) AS pillars
FROM product p LEFT JOIN brand b ON b.id = p.brand_id LEFT JOIN pillar q ON q.product_id = p.id GROUP BY p.id""")
def product_views(spark, d):
    """Products with brand and nested pillars."""
    v = catalog.views(_products(spark, d), a.brands(spark, d), _pillars(spark, d))
    line = F.transform("pillars", lambda x: F.concat_ws(" ", x["axis"], F.round(x["representative"], 3).cast("string"), x["n"].cast("string"), x["disagreement"].cast("string")))
    return v.select("product_id", "display_name", "brand_name", F.array_join(line, "; ").alias("pillars"))


@registered("wanted_views", f"""WITH {a.PRODUCT}, {a.BRAND} SELECT p.id AS product_id, b.name AS brand_name, w.ord AS place FROM (VALUES ('p9', 1), ('p2', 2), ('p77', 3), ('nothing', 4)) w(id, ord) JOIN product p ON p.id = w.id LEFT JOIN brand b ON b.id = p.brand_id""")
def wanted_views(spark, d):
    """Views of given products in a given order."""
    wanted = spark.createDataFrame([("p9", 1), ("p2", 2), ("p77", 3), ("nothing", 4)], "product_id string, ord int")
    return catalog.views(_products(spark, d), a.brands(spark, d), _pillars(spark, d), wanted).select("product_id", "brand_name", F.col("wanted_ord").alias("place"))


@registered("get_product", f"WITH {a.PRODUCT} SELECT id, display_name, category, gtin, size_value FROM product WHERE id = 'p42'")
def get_product(spark, d):
    return catalog.get_product(_products(spark, d), "p42").select("id", "display_name", "category", "gtin", "size_value")


def _browsed(order: str, by: str) -> None:
    sql = f"""WITH {a.PRODUCT}, {a.PILLARS}, w AS (SELECT product_id, coalesce(max(CASE WHEN disagreement THEN spread_max - spread_min END), 0.0) AS widest, avg(representative) AS mean FROM pillar GROUP BY product_id)
SELECT p.id AS product_id, row_number() OVER (ORDER BY {by}, p.id) AS place FROM product p LEFT JOIN w ON w.product_id = p.id WHERE category = 'ECONOMY'"""

    @registered(f"browse_{order}_order", sql)
    def query(spark, d):
        from pyspark.sql import Window

        found = _pillars(spark, d)
        means, widest = scoring.mean_of_pillars(found), scoring.max_spread(found)
        # sums in another order differ in their last digits; places go by what is left without them
        means, widest = means.withColumn("mean", F.round("mean", 9)), widest.withColumn("widest", F.round("widest", 9))
        keys = catalog.browse_keys(order)
        out = catalog.browse(_products(spark, d), means, widest, order, "ECONOMY")
        return out.select("product_id", F.row_number().over(Window.orderBy(*keys, "product_id")).cast("long").alias("place"))

    query.__doc__ = f"Places of one category's products ordered by {order}."


for _order, _by in {"name": "lower(display_name), display_name", "contested": "round(coalesce(widest, 0), 9) DESC", "best": "round(mean, 9) DESC NULLS LAST", "worst": "round(mean, 9) ASC NULLS LAST"}.items():
    _browsed(_order, _by)


@registered("categories", "SELECT DISTINCT p_type AS category FROM part")
def categories(spark, d):
    return catalog.categories(_products(spark, d))


@registered("distinct_brands", "SELECT DISTINCT p_brand AS brand_id, p_brand AS brand_name FROM part")
def distinct_brands(spark, d):
    """Brands of all views, each once."""
    return catalog.distinct_brands(catalog.views(_products(spark, d), a.brands(spark, d), _pillars(spark, d)))


@registered("indexed_search", f"""WITH {a.PRODUCT}, {a.BRAND}, named AS (SELECT p.id, lower(p.display_name) AS x, lower(coalesce(b.name, '')) AS y, coalesce(p.gtin, '') AS z FROM product p LEFT JOIN brand b ON b.id = p.brand_id),
query AS (SELECT DISTINCT unnest(string_split(x, ' ')) AS query FROM named UNION SELECT DISTINCT substr(z, 7) FROM named)
SELECT query, count(*) AS n, min(id) AS first_id FROM query JOIN named ON contains(x, query) OR contains(y, query) OR contains(z, query) WHERE length(query) >= 3 GROUP BY query""")
def indexed_search(spark, d):
    """Every word of a name and every end of a barcode, searched through the trigram index."""
    named = _products(spark, d).join(a.brands(spark, d).select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name")), "brand_id", "left")
    index = search.SearchIndex(spark, f"{graph.shared_folder(spark)}/panelyst/search-{uuid.uuid4().hex}", 8).build(named)
    words = named.select(F.explode(F.split(F.lower("display_name"), " ")).alias("query"))
    queries = words.unionByName(named.select(F.substring(F.coalesce("gtin", F.lit("")), 7, 100).alias("query"))).distinct()
    return index.search_all(named, queries).groupBy("query").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _delta_sql(sign: str) -> str:
    """The axes of a pair that differ by five points or more, with thousandths of points."""
    one = lambda x: f"CASE WHEN {sign}(round(wa.{x}, 9) - round(wb.{x}, 9)) >= 5 THEN '{x}' || CAST(round((round(wa.{x}, 9) - round(wb.{x}, 9)) * 1000) AS BIGINT) END"
    return f"array_to_string(list_filter([{', '.join(map(one, scoring.AXES))}], lambda z: z IS NOT NULL), '|')"


SAFER = f"""WITH {a.PRODUCT}, {a.PILLARS}, safe AS (SELECT p.id, p.category, round(q.representative, 9) AS s FROM product p LEFT JOIN pillar q ON q.product_id = p.id AND q.axis = 'ingredient_safety'),
wide AS (SELECT product_id, {', '.join(f"max(CASE WHEN axis = '{x}' THEN representative END) AS {x}" for x in scoring.AXES)} FROM pillar GROUP BY product_id),
safer AS (SELECT b.id AS product_id, x.id AS alt_id, x.s, {_delta_sql('')} AS cleaner, {_delta_sql('-')} AS tradeoffs, row_number() OVER (PARTITION BY b.id ORDER BY x.s DESC, x.id) AS place
  FROM safe b JOIN safe x ON x.category = b.category AND x.s > coalesce(b.s, '-infinity'::DOUBLE) LEFT JOIN wide wa ON wa.product_id = x.id LEFT JOIN wide wb ON wb.product_id = b.id)"""


def _rounded(spark, d) -> DataFrame:
    """All pillars to nine places, so that engines agree on ties and on what is five points."""
    return scoring.all_pillars(_products(spark, d).select(F.col("id").alias("product_id")), _pillars(spark, d)).withColumn("representative", F.round("representative", 9))


def _deltas(c) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["axis"], F.round(x["delta"] * 1000).cast("long").cast("string"))), "|")


def _shelf_text(alt, base) -> Column:
    """An alternative as text, without structs in between, as there are many; thousandths of points, halves away from zero."""
    far, by = catalog.DELTA_POINTS, {x: alt[x] - base[x] for x in scoring.AXES}
    part = lambda test, x, n: F.when(test, F.concat(F.lit(f"|{x}"), n.cast("string"))).otherwise("")
    cleaner = F.concat(*[part(c >= far, x, F.floor(c * 1000 + 0.5)) for x, c in by.items()])
    worse = F.concat(*[part(c <= -far, x, F.ceil(c * 1000 - 0.5)) for x, c in by.items()])
    return F.concat(alt["alt_id"], F.lit(":"), F.substring(cleaner, 2, 1000), F.lit("/"), F.substring(worse, 2, 1000))


@registered("shelf_catalog", f"{SAFER} SELECT product_id, count(*) AS n, string_agg(alt_id || ':' || cleaner || '/' || tradeoffs, ';' ORDER BY place) AS alternatives FROM safer GROUP BY product_id")
def shelf_catalog(spark, d):
    """Every safer product of the category of each product, safest first, with the axes that differ."""
    out = catalog.shelf_catalog(_products(spark, d), _rounded(spark, d), entry=_shelf_text)
    return out.select("product_id", F.col("n").cast("long").alias("n"), F.concat_ws(";", "alternatives").alias("alternatives"))


@registered("top_alternatives", f"{SAFER} SELECT product_id, place, alt_id, round(s, 6) AS alt_safety, cleaner, tradeoffs FROM safer WHERE place <= 3")
def top_alternatives(spark, d):
    """The three safest alternatives of each product, looked up in runs of categories."""
    out = catalog.top_alternatives(_products(spark, d), _rounded(spark, d), 3)
    return out.select("product_id", "place", "alt_id", r6("alt_safety").alias("alt_safety"), _deltas(F.col("cleaner")).alias("cleaner"), _deltas(F.col("tradeoffs")).alias("tradeoffs"))


STANCES = ["concern", "neutral", "unknown", "support"]


def _flags(spark, d) -> DataFrame:
    """Flags of products: an ingredient, and positions of two or three bodies on it, as JSON that is read back."""
    p, k = a.products(spark, d), F.col("ord")
    stance = lambda i: a._one_of(STANCES, (k * i + i) % 4)
    position = lambda i: F.struct(F.lit(f"body{i}").alias("body"), stance(i).alias("stance"))
    positions = F.to_json(F.when(k % 2 == 0, F.array(position(1), position(2))).otherwise(F.array(position(1), position(2), position(3))))
    rows = p.select(F.col("id").alias("product_id"), text.ingredient_slug(F.col("ingredients")[0]).alias("slug"), F.col("ingredients")[0].alias("name"), positions.alias("positions"), F.when(k % 3 == 0, F.lit('["a note"]')).alias("notes"))
    return catalog.read_flags(rows)


FLAG = f"""{a.PRODUCT}, flag AS (SELECT id AS product_id, ord, trim(regexp_replace(lower(ingredients[1]), '[^a-z0-9]+', '-', 'g'), '-') AS slug, ingredients[1] AS name FROM product),
position AS (SELECT product_id, slug, ord, i, {a._sql_list(STANCES)}[CAST((ord * i + i) % 4 AS INT) + 1] AS stance FROM flag, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= 2 + ord % 2)"""


@registered("flag_stances", f"WITH {FLAG} SELECT product_id, slug, stance, string_agg('body' || i, ',' ORDER BY i) AS bodies FROM position GROUP BY ALL")
def flag_stances(spark, d):
    """Positions on flags by stance."""
    out = catalog.positions_by_stance(_flags(spark, d))
    return out.select("product_id", "slug", "stance", F.array_join(F.transform("positions", lambda x: x["p"]["body"]), ",").alias("bodies"))


@registered("flag_splits", f"WITH {FLAG} SELECT product_id, slug, count(DISTINCT stance) FILTER (stance <> 'unknown') > 1 AS split, CASE WHEN any_value(ord) % 3 = 0 THEN 1 ELSE 0 END AS notes FROM position GROUP BY product_id, slug")
def flag_splits(spark, d):
    """Flags on which bodies differ."""
    return _flags(spark, d).select("product_id", "slug", catalog.has_split(F.col("positions")).alias("split"), F.size("notes").alias("notes"))


@registered("product_flags", f"WITH {FLAG} SELECT product_id, slug, name FROM flag WHERE product_id = 'p12'")
def product_flags(spark, d):
    """Flags of one product, and one by its slug."""
    slug = _products(spark, d).where("id = 'p12'").select(text.ingredient_slug(F.col("ingredients")[0])).first()[0]
    return catalog.get_flag(_flags(spark, d), "p12", slug).select("product_id", "slug", "name")


@registered("stored_weights", f"""WITH {a.PILLARS}, w AS (SELECT unnest({a._sql_list(scoring.AXES)}) AS axis, unnest([3.0, 1.0, 0.0, 1.0]::DOUBLE[]) AS w)
SELECT product_id, round(sum(w * representative) / sum(w), 6) AS overall FROM pillar JOIN w USING (axis) WHERE w > 0 GROUP BY product_id""")
def stored_weights(spark, d):
    """Composites under weights that a user stored for two axes."""
    stored = spark.createDataFrame([("ingredient_safety", 3.0), ("labor", 0.0)], "axis string, w double")
    return scoring.composites(_pillars(spark, d), scoring.stored_weights(spark, stored)).select("product_id", r6("overall").alias("overall"))


@registered("provenance_notes", f"""WITH {a.RATED}, t AS (SELECT *, CASE {TIER} WHEN 'weak' THEN 2 WHEN 'auto' THEN 1 ELSE 0 END AS k FROM rated),
c AS (SELECT product_id, max(k) AS k, count(DISTINCT axis) AS n FROM t GROUP BY product_id)
SELECT product_id, concat_ws(' ', CASE WHEN k = 2 THEN 'Some ratings rest on weak matches.' END, CASE WHEN k = 1 THEN 'Some matches were made automatically.' END, CASE WHEN n < 4 THEN 'Only ' || n || ' of 4 axes are rated.' END) AS notes FROM c""")
def provenance_notes(spark, d):
    return agreement.provenance_notes(agreement.coverage(_rated(spark, d))).select("product_id", F.array_join("notes", " ").alias("notes"))


@registered("illustrative", "SELECT id, id IN ('ewg', 'yuka', 'inci-beauty', 'good-on-you', 'how2recycle') AS illustrative FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'yuka' WHEN 1 THEN 'ewg' ELSE 's' || s_suppkey END AS id FROM supplier)")
def illustrative(spark, d):
    """Sources that only demonstrate."""
    k = F.col("s_suppkey")
    rows = a.table(spark, d, "supplier").select(F.when(k % 4 == 0, "yuka").when(k % 4 == 1, "ewg").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("id"))
    return rows.select("id", scoring.is_illustrative(F.col("id")).alias("illustrative"))


@registered("api_bases", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'http://localhost:3000' WHEN 1 THEN 'http://h' || s_suppkey ELSE 'http://h/p' END AS base FROM supplier")
def api_bases(spark, d):
    """Settings of an address: blanks and slashes at the end go, and nothing means the default."""
    k = F.col("s_suppkey")
    typed = F.when(k % 3 == 0, "  // ").when(k % 3 == 1, F.concat(F.lit(" http://h"), k.cast("string"), F.lit("/ "))).otherwise("http://h/p//")
    return a.table(spark, d, "supplier").select("s_suppkey", text.normalize_api_base(typed, "http://localhost:3000").alias("base"))


@registered("product_ratings", f"""WITH {a.RATING} SELECT product_id, count(*) AS ratings, round(sum(score_raw), 4) AS total FROM rating GROUP BY product_id""")
def product_ratings(spark, d):
    """Ratings of products over matches and listings, counted both ways."""
    rows = a.ratings(spark, d).withColumn("listing_id", F.concat_ws("-", "product_id", "source_id"))
    match = rows.select("listing_id", "product_id", F.lit(1.0).alias("confidence"), F.lit("seed").alias("method"), F.lit(False).alias("reviewed")).distinct()
    listing = rows.select(F.col("listing_id").alias("id"), "source_id").distinct()
    rating = rows.select(F.concat_ws("-", F.lit("r"), "listing_id", "ord.o", "ord.l").alias("id"), "listing_id", "score_raw")
    sums = catalog.product_ratings(match, listing, rating).groupBy("product_id").agg(F.round(F.sum("score_raw"), 4).alias("total"))
    return catalog.rated_products(match, rating).join(sums, "product_id")


# ------------------------------------------------------------------------------------------------ derived raters

LABELLED = "CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 55 THEN 'Fair' WHEN score >= 40 THEN 'Poor' WHEN score IS NOT NULL THEN 'Bad' ELSE 'Unknown' END"
DERIVED = f"""{a.PRODUCT}, {a.BRAND}, hdict(key, hazard, category, penalty) AS (VALUES {HAZ}),
heach AS (SELECT id, i AS pos, {STRIP.format(x='ingredients[i]')} AS key FROM (SELECT id, ingredients, unnest(range(1, len(ingredients) + 1)) AS i FROM product)),
hf AS (SELECT id, key, min(pos) AS pos FROM heach GROUP BY id, key), hm AS (SELECT hf.*, category, penalty FROM hf JOIN hdict USING (key)),
hc AS (SELECT *, sum(CASE WHEN category = 'allergen' THEN penalty ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM hm),
hs AS (SELECT id, sum(CASE WHEN category = 'allergen' THEN greatest(0, least(penalty, 30 - (run - penalty))) ELSE penalty END) AS cost, count(*) AS flagged, count(*) FILTER (category = 'prohibited') AS np,
              count(*) FILTER (category = 'restricted') AS nr, count(*) FILTER (category = 'concern') AS nc, count(*) FILTER (category = 'allergen') AS na FROM hc GROUP BY id),
h AS (SELECT p.id, floor(greatest(0.0, least(100.0, 100.0 - coalesce(cost, 0))) + 0.5)::DOUBLE AS score,
             CASE WHEN flagged IS NULL THEN 'No regulated hazards recognized among ' || len(ingredients) || ' ingredients.'
                  ELSE 'Flagged ' || flagged || ' of ' || len(ingredients) || ' ingredients: ' || concat_ws(', ', CASE WHEN np > 0 THEN np || ' prohibited' END, CASE WHEN nr > 0 THEN nr || ' restricted' END,
                       CASE WHEN nc > 0 THEN nc || ' of concern' END, CASE WHEN na > 0 THEN na || ' regulated allergen' || CASE WHEN na <> 1 THEN 's' ELSE '' END END) || '.' END AS summary
      FROM product p LEFT JOIN hs ON hs.id = p.id),
kdict(word, priority, material, score, resin) AS (VALUES {MAT}), tier(material, tier) AS (VALUES {", ".join(f"('{n}', '{raters.TIER_LABEL[t]}')" for n, t, *_ in raters.MATERIALS)}),
keach AS (SELECT id, i AS pos, string_split(trim(regexp_replace(regexp_replace(lower(materials[i]), '^[a-z]{{2}}:', ''), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM (SELECT id, materials, unnest(range(1, len(materials) + 1)) AS i FROM product)),
khit AS (SELECT id, pos, min(priority) AS priority FROM (SELECT id, pos, unnest(ws) AS word FROM keach) JOIN kdict USING (word) GROUP BY id, pos),
kone AS (SELECT h.id, material, score, resin, min(pos) AS pos FROM khit h JOIN (SELECT DISTINCT priority, material, score, resin FROM kdict) USING (priority) GROUP BY ALL),
knamed AS (SELECT *, bool_or(resin) OVER (PARTITION BY id) AS any_resin FROM kone),
kends AS (SELECT id, avg(score) AS mean, count(*) AS n, min((score, pos, material)) AS worst, max((score, -pos, material)) AS best FROM knamed WHERE NOT any_resin OR material <> '{raters.GENERIC_PLASTIC}' GROUP BY id),
pk AS (SELECT id, floor(mean + 0.5)::DOUBLE AS score, CASE WHEN n = 1 THEN best[3] || ' — ' || b.tier || '.'
             ELSE n || ' packaging components: best is ' || best[3] || ' (' || b.tier || '), limited by ' || worst[3] || ' (' || w.tier || ').' END AS summary
      FROM kends JOIN tier b ON b.material = best[3] JOIN tier w ON w.material = worst[3]),
edict(key, status, score) AS (SELECT DISTINCT * FROM (VALUES {ETH})), own AS (SELECT id, parent_id, list_prepend(name, aliases) AS names FROM brand),
al AS (SELECT o.id, list_concat(o.names, coalesce(p.names, [])) AS names FROM own o LEFT JOIN own p ON p.id = o.parent_id),
ee AS (SELECT id, i, {STRIP.format(x='names[i]')} AS key FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM al)),
eb AS (SELECT id, arg_min(score, i) AS score, arg_min(status, i) AS summary FROM ee JOIN edict USING (key) GROUP BY id),
be AS (SELECT p.id, eb.score::DOUBLE AS score, summary FROM product p JOIN eb ON eb.id = p.brand_id),
derived AS (SELECT 'hz' AS prefix, 'ingredient-hazard' AS source_id, * FROM h UNION ALL SELECT 'pk', 'packaging-scan', * FROM pk UNION ALL SELECT 'be', 'cruelty-free', * FROM be)"""


def _derived(spark, d) -> list[tuple]:
    p = a.products(spark, d, spread=True)
    h = raters.hazard_scores(p.select(F.col("id").alias("product_id"), "ingredients"))
    k = raters.packaging_scores(p.select(F.col("id").alias("product_id"), "materials"))
    e = raters.ethics_scores(p, a.brands(spark, d)).withColumn("summary", F.col("status"))
    return [(h, "hz", "ingredient-hazard"), (k, "pk", "packaging-scan"), (e, "be", "cruelty-free")]


@registered("derived_listings", f"""WITH {DERIVED} SELECT prefix || '-' || d.id AS id, source_id, d.id AS native_id, display_name AS raw_name, score AS score_raw, {LABELLED} AS score_label, summary
FROM derived d JOIN product p ON p.id = d.id""")
def derived_listings(spark, d):
    """Listings of the three derived raters with their ratings and summaries."""
    p, out = _products(spark, d), None
    for scores, prefix, source in _derived(spark, d):
        listings, ratings = raters.rater_listings(p, scores, prefix, source, NOW)
        one = listings.join(ratings.select(F.col("listing_id").alias("id"), "score_raw", "score_label"), "id")
        one = one.select("id", "source_id", "native_id", "raw_name", "score_raw", "score_label", F.get_json_object("payload", "$.summary").alias("summary"))
        out = one if out is None else out.unionByName(one)
    return out


@registered("derivation_summaries", f"""WITH {DERIVED}, n AS (SELECT count(*) AS n FROM product)
SELECT source_id, count(*) AS scored, any_value(n.n) - count(*) AS skipped, round(avg(score), 6) AS mean_score FROM derived, n GROUP BY source_id""")
def derivation_summaries(spark, d):
    """What each derived rater scored and skipped."""
    p, out = _products(spark, d), None
    for scores, _, source in _derived(spark, d):
        one = raters.derivation_summary(p, scores).select(F.lit(source).alias("source_id"), "scored", "skipped", r6("mean_score").alias("mean_score"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------------------------------------ similarity and training

PAIRS = "(SELECT x.c_name || ' ' || x.c_mktsegment AS na, y.s_name AS nb FROM customer x JOIN supplier y ON x.c_custkey % 40 = y.s_suppkey % 40 UNION SELECT p_name, p_type FROM part)"


@registered("name_similarities", f"""WITH RECURSIVE {jaro_sql(PAIRS)}, t AS (SELECT *, list_distinct(string_split(na, ' ')) AS x, list_distinct(string_split(nb, ' ')) AS y FROM jw)
SELECT na, nb, round(name_jaro_winkler, 6) AS jaro_winkler, round(len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))), 6) AS jaccard, round(len(list_intersect(x, y)) * 1.0 / least(len(x), len(y)), 6) AS overlap FROM t""")
def name_similarities(spark, d):
    """Jaro-Winkler, Jaccard and overlap of distinct name pairs."""
    c, s = a.table(spark, d, "customer"), a.table(spark, d, "supplier")
    # distinct names meet, not the rows that have them
    mine = c.select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("na"), (F.col("c_custkey") % 40).alias("turn")).distinct()
    theirs = s.select(F.col("s_name").alias("nb"), (F.col("s_suppkey") % 40).alias("turn")).distinct()
    met = mine.join(theirs, "turn").select("na", "nb")
    pairs = met.unionByName(a.table(spark, d, "part").select(F.col("p_name").alias("na"), F.col("p_type").alias("nb"))).distinct()
    x, y = F.array_distinct(F.split("na", " ")), F.array_distinct(F.split("nb", " "))
    return pairs.select("na", "nb", r6(similarity.jaro_winkler(F.col("na"), F.col("nb"))).alias("jaro_winkler"), r6(text.jaccard(x, y)).alias("jaccard"), r6(text.overlap_coefficient(x, y)).alias("overlap"))


@registered("misclassified", f"WITH {PROBS} SELECT label, p, count(*) AS n FROM pr WHERE (p >= 0.4) <> (label = 1) GROUP BY label, p")
def misclassified(spark, d):
    """Rows on the wrong side of a threshold, by label and probability."""
    return training.misclassified(_probs(spark, d), 0.4).groupBy("label", "p").agg(F.count("*").alias("n"))


@registered("split_parts", "SELECT doc_id, ('0x' || substr(md5('split-1|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 AS fits FROM labels")
def split_parts(spark, d):
    """Training and test rows by the hash of their id."""
    fit, test = training.split(a.table(spark, d, "labels").select(F.col("doc_id").alias("id")).withColumn("id", F.col("id").cast("string")))
    return fit.withColumn("fits", F.lit(True)).unionByName(test.withColumn("fits", F.lit(False))).select(F.col("id").cast("long").alias("doc_id"), "fits")


@registered("rate_check", f"""{UNSIZED_HITS} SELECT (SELECT count(*) FROM item) AS probes, count(*) AS resolved, count(*) FILTER (CAST(substr(entry, 2) AS BIGINT) % 2 = 0) AS resolved_to_rated, count(*) FILTER (ambiguous) AS ambiguous FROM verdict""")
def rate_check(spark, d):
    """How many sightings without size resolve, and to rated products."""
    c = _prepared(spark, d)
    rated = _products(spark, d).where(F.col("ord") % 2 == 0).select(F.col("id").alias("product_id"))
    return training.rate_check(c, c, a.brands(spark, d), rated)


@registered("weighted_composites", f"WITH {a.PILLARS}, {COMPOSITE} SELECT product_id, {BAND.format(x='round(overall_min, 6)')} AS low_band, {BAND.format(x='round(overall_max, 6)')} AS high_band FROM composite")
def weighted_composites(spark, d):
    """Bands of the ends of composites."""
    c = scoring.composites(_pillars(spark, d), scoring.default_weights(spark))
    return c.select("product_id", scoring.verdict_band(r6("overall_min")).alias("low_band"), scoring.verdict_band(r6("overall_max")).alias("high_band"))


#: Answers of the feed as items beside the catalog's, in one table of pairs with scores: (a, b, kept) of a listing with an entry of
#: the catalog, or with another listing. Listings have few ingredients, so barcodes and brands are all they meet by. A unit but
#: the catalog's makes sizes differ from every entry's.
_FED = f"""{LISTING},
fed AS (SELECT n.id, n.name, coalesce(x.brand_id, nullif({STRIP.format(x='n.brand')}, '')) AS brand_key, {GTIN} AS gtin14, string_split(n.ingredients, '|') AS ingredients,
        list_distinct(list_filter(list_transform(string_split(n.ingredients, '|'), lambda i: {STRIP.format(x='i')}), lambda i: i <> '')) AS iset,
        CASE WHEN size_unit = 'ml' THEN size_value WHEN size_unit IS NOT NULL THEN -1000 - size_value END AS size_value
        FROM norm n LEFT JOIN alias x ON x.alias = {STRIP.format(x='n.brand')})"""
_CATALOG = "sized_item AS (SELECT i.*, p.size_value FROM item i JOIN product p ON p.id = i.id)"
_MET = "(l.gtin14 = r.gtin14 OR l.brand_key = r.brand_key)"
INGESTED = f"""WITH RECURSIVE {ITEMS}, {_FED}, {_CATALOG}, whole AS MATERIALIZED (SELECT * FROM {full_sql('sized_item')}), feeding AS MATERIALIZED (SELECT * FROM {full_sql('fed')}),
featured AS MATERIALIZED (
  SELECT l.id AS a, r.id AS b, 'entry' AS kind, {FEATURED} FROM feeding l JOIN whole r ON {_MET}
  UNION ALL SELECT l.id, r.id, 'listing', {FEATURED} FROM feeding l JOIN feeding r ON l.id < r.id AND {_MET}),
able AS MATERIALIZED (SELECT * FROM featured WHERE {ABLE}), {jaro_sql('able')},
hit AS MATERIALIZED (SELECT a, b, kind, {probability_sql(matching.SHIPPED)} AS score FROM able JOIN jw USING (na, nb) WHERE {probability_sql(matching.SHIPPED)} >= {matching.SHIPPED.threshold}::DOUBLE),
found AS MATERIALIZED (SELECT h.a AS id, h.b AS product_id, h.score FROM hit h JOIN item i ON i.id = h.b WHERE kind = 'entry' QUALIFY row_number() OVER (PARTITION BY h.a ORDER BY h.score DESC, i.ord) = 1),
rest AS MATERIALIZED (SELECT id FROM fed WHERE id NOT IN (SELECT id FROM found)),
two_way AS MATERIALIZED (SELECT h.a, h.b FROM hit h JOIN rest x ON x.id = h.a JOIN rest y ON y.id = h.b WHERE kind = 'listing' UNION SELECT h.b, h.a FROM hit h JOIN rest x ON x.id = h.a JOIN rest y ON y.id = h.b WHERE kind = 'listing'),
reach AS (SELECT id AS a, id AS b FROM rest UNION SELECT r.a, e.b FROM reach r JOIN two_way e ON e.a = r.b),
grouped AS (SELECT a AS id, min(b) AS head FROM reach GROUP BY a)
SELECT f.id AS listing_id, f.product_id, round(f.score, 6) AS confidence, 'obf-auto' AS method, NULL AS display_name, NULL AS brand_id, NULL AS category FROM found f
UNION ALL
SELECT g.id, 'prod-' || g.head, 1.0, 'obf-new', CASE WHEN g.id = g.head THEN n.name END, CASE WHEN g.id = g.head THEN coalesce(x.brand_id, CASE WHEN n.brand IS NULL THEN 'brand-unknown' ELSE 'brand-obf-' || {STRIP.format(x='n.brand')} END) END,
       CASE WHEN g.id = g.head THEN n.category END
FROM grouped g JOIN norm n ON n.id = g.id LEFT JOIN alias x ON x.alias = {STRIP.format(x='n.brand')}"""


@registered("feed_ingested", INGESTED)
def feed_ingested(spark, d):
    """The whole feed ingested: what each listing is attached to, and the product where one was minted for it; put into a store and read back."""
    good, _ = feed.parsed(_landed(spark, d))
    made = feed.ingest(good, _prepared(spark, d), a.brands(spark, d), NOW)
    into = store.Store(spark, f"{graph.shared_folder(spark)}/panelyst/store-{uuid.uuid4().hex}", feed.TABLES, buckets=8)
    into.merge({t: store.Merge(made[t]) for t in ("listing", "match", "product", "brand")})
    product = into.read("product").select(F.col("id").alias("own"), "display_name", "brand_id", "category")
    match = into.read("match").withColumn("own", F.concat(F.lit("prod-"), "listing_id"))
    return match.join(product, "own", "left").select("listing_id", "product_id", r6("confidence").alias("confidence"), "method", "display_name", "brand_id", "category")


_ALL = INGESTED.index("\nSELECT f.id AS listing_id")


@registered("feed_summary", f"""{INGESTED[:_ALL]}, kinds AS (SELECT p_partkey % 11 AS r FROM part WHERE p_partkey % 7 <> 0 OR p_partkey = 0)
SELECT (SELECT count(*) FROM norm) AS fetched, (SELECT count(*) FROM kinds WHERE r = 1) AS not_found, (SELECT count(*) FROM kinds WHERE r IN (2, 3)) AS invalid, (SELECT count(*) FROM found) AS matched,
       (SELECT count(DISTINCT head) FROM grouped) AS created, (SELECT count(*) FROM grouped WHERE id <> head) AS joined, (SELECT count(*) FROM norm WHERE eco_score IS NOT NULL) AS ratings""")
def feed_summary(spark, d):
    """The ingestion job over landed answers and a store with the catalog: what it fetched, matched and minted."""
    folder = f"{graph.shared_folder(spark)}/panelyst/job-{uuid.uuid4().hex}"
    _landed(spark, d).select("raw").write.text(f"{folder}/landed")
    into = store.Store(spark, f"{folder}/tables", feed.TABLES, buckets=8)
    feed.seeded(into, _products(spark, d), a.brands(spark, d))
    return feed.run_job(spark, ["--landed", f"{folder}/landed", "--tables", f"{folder}/tables"], NOW)


@registered("seeded_tables", f"""WITH {FLAG}, {a.BRAND}, {a.SOURCE}
SELECT 'brand' AS "table", count(*) AS n, sum(len(aliases)) AS members, min(coalesce(parent_id, '~')) AS first FROM brand UNION ALL SELECT 'product', count(*), sum(len(ingredients)), min(coalesce(gtin, '~')) FROM product
UNION ALL SELECT 'source', count(*), 0, min(axis) FROM source UNION ALL SELECT 'flag', count(DISTINCT product_id), count(*), min(slug) FROM position""")
def seeded_tables(spark, d):
    """Curated tables seeded twice as stored rows, read back with their lists: rows, members of lists, and a least value."""
    into = store.Store(spark, f"{graph.shared_folder(spark)}/panelyst/seed-{uuid.uuid4().hex}", stored.KEYS, buckets=8)
    flags = _flags(spark, d).withColumn("id", F.concat("product_id", F.lit("-"), "slug"))
    tables = {"brand": a.brands(spark, d), "product": _products(spark, d), "source": a.sources(spark, d), "flag": flags}
    stored.seed(into, {t: df.limit(3) for t, df in tables.items()})
    counts = stored.seed(into, tables)
    measured = {"brand": ("aliases", F.coalesce("parent_id", F.lit("~"))), "product": ("ingredients", F.coalesce("gtin", F.lit("~"))), "source": (None, F.col("axis")), "flag": ("positions", F.col("slug"))}
    out = None
    for t, (members, least) in measured.items():
        size = F.sum(F.size(members)) if members else F.lit(0).cast("long")
        one = stored.from_rows(t, into.read(t)).agg(size.alias("members"), F.min(least).alias("first")).select(F.lit(t).alias("table"), "members", "first")
        out = one if out is None else out.unionByName(one)
    return counts.join(out, "table").select("table", "n", "members", "first")
