"""The open product feed: landed JSON to listings, ratings and items; ingestion; upserts into tables of Parquet files."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_category, js_trim, parse_quantity, present, primary_brand, strip_norm
from ..operators.blocking import brand_aliases, prepared
from ..operators.graph import kept
from ..operators.matching import SHIPPED, Model, brand_words_suffice, cluster_listings, resolve
from .store import Merge, Store, upserted  # noqa: F401

SOURCE_ID = "obf-eco"
UNKNOWN_BRAND = "brand-unknown"
# Fixed value: fields of a product in the feed.
PRODUCT = (
    "code string, product_name string, brands string, ingredients_text string, ingredients array<struct<text: string>>, quantity string, categories string, "
    "categories_tags array<string>, ecoscore_score double, ecoscore_grade string, packagings array<struct<material: string, shape: string, recycling: string>>, "
    "packaging_materials_tags array<string>, packaging_tags array<string>"
)
ENVELOPE = f"code string, status double, status_verbose string, product struct<{', '.join(x.replace(' ', ': ', 1) for x in re.split(r', (?![^<]*>)', PRODUCT))}>"


def conforming(raw: Column) -> Column:
    """Whether a JSON product has the declared type wherever it has a declared field: one wrong field spoils the record."""
    v = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    for f in ("code", "product_name", "brands", "ingredients_text", "quantity", "categories"):
        ok = ok & (kind(f).isNull() | (kind(f) == "STRING"))
    ok = ok & (kind("ecoscore_grade").isNull() | kind("ecoscore_grade").isin("STRING", "VOID"))
    ok = ok & (kind("ecoscore_score").isNull() | kind("ecoscore_score").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|VOID)"))
    for f in ("categories_tags", "packaging_materials_tags", "packaging_tags"):
        ok = ok & (kind(f).isNull() | kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>"))
    for f in ("ingredients", "packagings"):
        ok = ok & (kind(f).isNull() | kind(f).rlike("^ARRAY<(OBJECT|VOID)"))
    return F.coalesce(ok, F.lit(False))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of the feed, one JSON text a line, as raw."""
    return spark.read.text(path).withColumnRenamed("value", "raw").where("trim(raw) <> ''")


def parsed(landed: DataFrame, envelope: bool = True) -> tuple[DataFrame, DataFrame]:
    """((raw, product), quarantined raw) of landed rows; of answers with an envelope, those found (status 1) with a product."""
    if envelope:
        e = landed.withColumn("e", F.from_json("raw", ENVELOPE)).withColumn("inner", F.get_json_object("raw", "$.product"))
        valid = F.col("e.status").isNotNull() & (F.col("inner").isNull() | conforming(F.col("inner")))
        judged = e.withColumn("valid", F.coalesce(valid, F.lit(False)))
        good = judged.where("valid AND e.status = 1 AND e.product IS NOT NULL").select("raw", F.col("e.product").alias("product"))
    else:
        judged = landed.withColumn("valid", conforming(F.col("raw")))
        good = judged.where("valid").select("raw", F.from_json("raw", PRODUCT).alias("product"))
    return good, judged.where("NOT valid").select("raw")


def _nonblank(values: Column) -> Column:
    return F.filter(F.transform(values, js_trim), lambda x: x.isNotNull() & (x != ""))


def extract_ingredients(p: Column) -> Column:
    listed = _nonblank(F.transform(p["ingredients"], lambda i: i["text"]))
    text = _nonblank(F.split(p["ingredients_text"], ","))
    return F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(text, F.array().cast("array<string>")))


def extract_materials(p: Column) -> Column:
    """Materials of the parts, else material tags, else mixed tags."""
    first = _nonblank(F.transform(p["packagings"], lambda x: x["material"]))
    second, third = _nonblank(p["packaging_materials_tags"]), _nonblank(p["packaging_tags"])
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(F.coalesce(third, F.array().cast("array<string>")))


def materials_of_payload(payload: Column) -> Column:
    """Materials in a stored answer; none if it isn't valid."""
    inner = F.coalesce(F.get_json_object(payload, "$.product"), payload)
    return F.when(conforming(inner), extract_materials(F.from_json(inner, PRODUCT))).otherwise(F.array().cast("array<string>"))


def first_materials(match: DataFrame, listing: DataFrame) -> DataFrame:
    """(product_id, materials): of a product's listings of the feed, the first with any material."""
    own = listing.where(F.col("source_id") == SOURCE_ID).select(F.col("id").alias("listing_id"), materials_of_payload(F.col("payload")).alias("materials"))
    return match.join(own.where(F.size("materials") > 0), "listing_id").groupBy("product_id").agg(F.min_by("materials", "listing_id").alias("materials"))


def normalized(good: DataFrame, now: str) -> DataFrame:
    """Products of the feed as items and listings at once: one projection, ord by code."""
    p = F.col("product")
    code = F.coalesce(p["code"], F.lit(""))
    size = parse_quantity(js_trim(p["quantity"]))
    return good.select(
        F.concat(F.lit("obf-"), code).alias("id"), F.lit(SOURCE_ID).alias("source_id"), code.alias("native_id"),
        F.coalesce(p["product_name"], F.lit("")).alias("name"), F.nullif(primary_brand(p["brands"]), F.lit("")).alias("brand"),
        F.nullif(code, F.lit("")).alias("gtin"), extract_ingredients(p).alias("ingredients"), size["size_value"].alias("size_value"), size["size_unit"].alias("size_unit"),
        F.concat(F.lit("https://world.openbeautyfacts.org/product/"), code).alias("url"), extract_category(p["categories_tags"], p["categories"]).alias("category"),
        p["ecoscore_score"].alias("eco_score"), F.upper(p["ecoscore_grade"]).alias("eco_grade"), F.col("raw").alias("payload"),
        F.to_timestamp(F.lit(now)).alias("fetched_at"), F.xxhash64(code).alias("ord"),
    ).dropDuplicates(["id"])


def ratings_of(rows: DataFrame) -> DataFrame:
    """At most one rating a listing, where the feed has a score."""
    return rows.where("eco_score IS NOT NULL").select(
        F.concat(F.lit("r-"), "id", F.lit("-eco")).alias("id"), F.col("id").alias("listing_id"), F.col("eco_score").alias("score_raw"), F.col("eco_grade").alias("score_label"), F.col("fetched_at").alias("ingested_at")
    )


def ensured_brands(rows: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, product's brand_id, minted_name): known brands by name or alias, others minted by their text, blanks one unknown brand."""
    raw = F.coalesce(js_trim(F.col("brand")), F.lit(""))
    joined = rows.select("id", raw.alias("raw")).withColumn("alias", strip_norm(F.col("raw"))).join(brand_aliases(brands), "alias", "left")
    minted = F.when(F.col("raw") == "", F.lit(UNKNOWN_BRAND)).otherwise(F.concat(F.lit("brand-obf-"), "alias"))
    return joined.select("id", F.coalesce("brand_id", minted).alias("brand_id"), F.when(F.col("brand_id").isNull(), F.coalesce(F.nullif("raw", F.lit("")), F.lit("Unknown"))).alias("minted_name"))


def minted(grouped: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, product_id): the products of clustered rows (id, cluster_id) that resolved to none.

    ``known`` (listing_id, product_id) are listings that an earlier run gave a product: they keep it, and others of their cluster
    join the least of these products. A cluster without one gets a product named after its least id. So a run that is repeated,
    in part or with more rows, names no product anew.
    """
    prefix = F.concat(F.lit("prod-"), "cluster_id")
    if known is None:
        return grouped.select("id", prefix.alias("product_id"))
    had = grouped.join(known.select(F.col("listing_id").alias("id"), F.col("product_id").alias("own")), "id", "left")
    least = had.groupBy("cluster_id").agg(F.min("own").alias("least"))
    return had.join(least, "cluster_id").select("id", F.coalesce("own", "least", prefix).alias("product_id"))


def ingest(good: DataFrame, catalog: DataFrame, brands: DataFrame, now: str, known: DataFrame | None = None, model: Model = SHIPPED) -> dict[str, DataFrame]:
    """One batch of the feed against a catalog snapshot: tables listing, rating, match, product and brand to upsert.

    Rows that resolve attach to their product. The others are clustered among themselves, and each cluster mints one product
    (``minted``), so that listings of one new product meet, whichever came first. A product's columns are those of the listing
    it is named after. ``known`` has what earlier runs minted.
    """
    rows = kept(normalized(good, now), "feed")
    items = kept(prepared(rows, brands), "feed-items")
    found = kept(resolve(items, catalog, model).select("id", "product_id", "confidence"), "resolved")
    rest = items.join(found, "id", "left_anti")
    grouped, _ = cluster_listings(rest, model, brand_words=brand_words_suffice(model))
    new = kept(minted(grouped, known), "minted")
    auto = found.select(F.col("id").alias("listing_id"), "product_id", "confidence", F.lit("obf-auto").alias("method"))
    own = new.select(F.col("id").alias("listing_id"), "product_id", F.lit(1.0).alias("confidence"), F.lit("obf-new").alias("method"))
    heads = new.where(F.col("product_id") == F.concat(F.lit("prod-"), "id"))
    first = rows.join(heads, "id").join(ensured_brands(rows, brands), "id")
    listing = rows.select("id", "source_id", "native_id", F.col("name").alias("raw_name"), F.coalesce("brand", F.lit("")).alias("raw_brand"), F.col("gtin").alias("raw_gtin"), F.col("ingredients").alias("raw_ingredients"), "url", "payload", "fetched_at")
    name = F.coalesce(F.nullif("name", F.lit("")), "native_id")
    product = first.select(F.col("product_id").alias("id"), "brand_id", name.alias("display_name"), "category", "gtin", "size_value", "size_unit", "ingredients", F.lit(1000).alias("sort_index"))
    brand = first.where("minted_name IS NOT NULL").groupBy(F.col("brand_id").alias("id")).agg(F.min("minted_name").alias("name")).select("id", "name", F.lit(None).cast("string").alias("parent_id"), F.when(F.col("id") != UNKNOWN_BRAND, F.array("name")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return {"listing": listing, "rating": ratings_of(rows), "match": auto.unionByName(own).withColumn("reviewed", F.lit(False)), "product": product, "brand": brand}


#: Tables of the catalog and the column by which rows are replaced: a listing's ratings are replaced wholesale, also by none.
TABLES = {"listing": "id", "rating": "listing_id", "match": "listing_id", "product": "id", "brand": "id"}
PRODUCT_ROW = "id string, brand_id string, display_name string, category string, gtin string, size_value double, size_unit string, ingredients array<string>, sort_index int"
BRAND_ROW = "id string, name string, parent_id string, aliases array<string>"
MATCH_ROW = "listing_id string, product_id string, confidence double, method string, reviewed boolean"


def seeded(store: Store, product: DataFrame, brand: DataFrame) -> None:
    """Put curated products and brands into a store."""
    cols = lambda ddl: [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", ddl)]
    store.merge({"product": Merge(product.select(*cols(PRODUCT_ROW))), "brand": Merge(brand.select(*cols(BRAND_ROW)))})


def match_context(store: Store) -> tuple[DataFrame, DataFrame]:
    """(prepared catalog, brands) as a store holds them. Curated rows come first among equals, then by a hash of the id; the
    unknown brand is no brand."""
    place = lambda late: F.when(late, F.lit(1 << 40)).otherwise(F.lit(0)) + F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    brands = store.read("brand", BRAND_ROW).withColumn("ord", place(F.col("id").startswith("brand-")))
    named = brands.where(F.col("id") != UNKNOWN_BRAND).select(F.col("id").alias("brand_id"), F.col("name").alias("brand"))
    products = store.read("product", PRODUCT_ROW).join(named, "brand_id", "left")
    items = products.select("id", "brand", F.col("display_name").alias("name"), "gtin", "ingredients", "size_value", "size_unit", place(F.col("sort_index") >= 1000).alias("ord"), F.col("id").alias("product_id"))
    return kept(prepared(items, brands), "catalog"), brands


def ingest_into(store: Store, good: DataFrame, now: str, batch: tuple[str, int] | None = None) -> bool:
    """Ingest parsed answers into a store, whole or not at all; a batch that is in already changes nothing.

    New products and brands are seen by the next batch. A human's review of a match stays, and so does what it points at.
    """
    if batch is not None and batch[1] <= store.applied(batch[0]):
        return False
    catalog, brands = match_context(store)
    known = store.read("match", MATCH_ROW)
    return put(store, ingest(good, catalog, brands, now, known.where("method = 'obf-new'")), known, batch)


def put(store: Store, made: dict[str, DataFrame], known: DataFrame, batch: tuple[str, int] | None = None) -> bool:
    """Merge what ingest() gave into a store; a match that a human has reviewed is not pointed elsewhere."""
    match = made["match"].join(known.where("reviewed").select("listing_id"), "listing_id", "left_anti")
    merges = {t: Merge(made[t]) for t in ("listing", "product", "brand")} | {"match": Merge(match)}
    merges["rating"] = Merge(made["rating"], replaced=made["listing"].select(F.col("id").alias("listing_id")))
    return store.merge(merges, batch)


def summary(landed: DataFrame, envelope: bool, made: dict[str, DataFrame]) -> DataFrame:
    """One row of counts of a batch: fetched, not_found, invalid, matched, created (products), joined (listings that share a product
    minted for another), ratings."""
    e = landed.withColumn("status", F.from_json("raw", "status double")["status"] if envelope else F.lit(1.0))
    good, bad = parsed(landed, envelope)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    minted_now = F.col("method") == "obf-new"
    named = F.col("product_id") == F.concat(F.lit("prod-"), "listing_id")
    parts = [
        count(good, "fetched"), e.agg(F.count_if(F.col("status") != 1).alias("not_found")), count(bad, "invalid"),
        made["match"].agg(F.count_if(~minted_now).alias("matched"), F.count_if(minted_now & named).alias("created"), F.count_if(minted_now & ~named).alias("joined")), count(made["rating"], "ratings"),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def run_job(spark: SparkSession, argv: list[str], now: str, keys: dict[str, str] | None = None) -> DataFrame:
    """The ingestion job over landed answers (--landed) and a store (--tables): given barcodes, or all answers; --search keeps those
    whose name or brands hold a text, --limit takes so many in order of their codes, --dry writes nothing. Gives the summary."""
    args = job_arguments(argv)
    landed = read_landed(spark, args.landed)
    if args.barcodes:
        landed = wanted_barcodes(landed, args.barcodes)
    at = lambda path: F.lower(F.coalesce(F.get_json_object("raw", f"$.product.{path}"), F.lit("")))
    if args.search:
        landed = landed.where(F.contains(at("product_name"), F.lit(args.search.lower())) | F.contains(at("brands"), F.lit(args.search.lower())))
    if args.limit is not None:
        landed = landed.orderBy(F.get_json_object("raw", "$.code").asc_nulls_last(), "raw").limit(args.limit)
    landed = kept(landed, "landed")
    store = Store(spark, args.tables, keys or TABLES)
    catalog, brands = match_context(store)
    known = store.read("match", MATCH_ROW)
    good, _ = parsed(landed)
    made = ingest(good, catalog, brands, now, known.where("method = 'obf-new'"))
    out = kept(summary(landed, True, made), "summary")
    if not args.dry:
        put(store, made, known)
    return out


def replaced_ratings(old: DataFrame, new: DataFrame, listings: DataFrame) -> DataFrame:
    """Ratings of written listings are replaced wholesale, also by none."""
    stay = old.join(listings.select(F.col("id").alias("listing_id")), "listing_id", "left_anti")
    return stay.select(*old.columns).unionByName(new.select(*old.columns))


def write_swap(df: DataFrame, path: str) -> None:
    """Write beside the table and swap folders, so that a plan may read the table it replaces.

    A run that stopped between the two renames leaves the table under .old; the next one puts it back first.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    staged, old = f"{path}.staged", f"{path}.old"
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p(old)) and not fs.exists(p(path)):
        fs.rename(p(old), p(path))
    df.write.mode("overwrite").parquet(staged)
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staged), p(path))
    fs.delete(p(old), True)


def enrichment(answers: DataFrame) -> DataFrame:
    """(asin, title, brand, gtin, category) of stored enrichment answers (asin, json): the item of that asin, if it has a title."""
    item = "struct<ASIN: string, ItemInfo: struct<Title: struct<DisplayValue: string>, ByLineInfo: struct<Brand: struct<DisplayValue: string>, Manufacturer: struct<DisplayValue: string>>, Classifications: struct<ProductGroup: struct<DisplayValue: string>>, ExternalIds: struct<EANs: struct<DisplayValues: array<string>>, UPCs: struct<DisplayValues: array<string>>>>>"
    r = answers.withColumn("items", F.from_json("json", f"ItemsResult struct<Items: array<{item}>>")["ItemsResult"]["Items"])
    r = r.withColumn("i", F.try_element_at(F.filter("items", lambda x: x["ASIN"] == F.col("asin")), F.lit(1))["ItemInfo"])
    first = lambda c: F.nullif(F.try_element_at(c, F.lit(1)), F.lit(""))
    text = lambda c: F.nullif(c, F.lit(""))
    return r.select(
        "asin",
        text(F.col("i.Title.DisplayValue")).alias("title"),
        F.coalesce(text(F.col("i.ByLineInfo.Brand.DisplayValue")), text(F.col("i.ByLineInfo.Manufacturer.DisplayValue"))).alias("brand"),
        F.coalesce(first(F.col("i.ExternalIds.EANs.DisplayValues")), first(F.col("i.ExternalIds.UPCs.DisplayValues"))).alias("gtin"),
        text(F.col("i.Classifications.ProductGroup.DisplayValue")).alias("category"),
    ).where("title IS NOT NULL")


def job_arguments(argv: list[str]) -> argparse.Namespace:
    """Parameters of the ingestion job."""
    p = argparse.ArgumentParser()
    p.add_argument("barcodes", nargs="*")
    p.add_argument("--search")
    p.add_argument("--filter", action="append", default=[])
    p.add_argument("--limit", type=int)
    p.add_argument("--page-size", type=int, default=100)
    p.add_argument("--page-start", type=int, default=1)
    p.add_argument("--dry", action="store_true")
    p.add_argument("--landed", help="folder of landed answers")
    p.add_argument("--tables", help="folder of the tables")
    a = p.parse_args(argv)
    a.page_size = min(a.page_size, 100)
    return a


def wanted_barcodes(landed: DataFrame, codes: list[str]) -> DataFrame:
    """Landed answers of given barcodes, by their digits; codes without digits are an error."""
    digits = ["".join(ch for ch in c if ch.isdigit()) for c in codes]
    if not all(digits):
        raise ValueError("barcode must contain digits")
    return landed.where(present(F.get_json_object("raw", "$.code")).isin(digits))
