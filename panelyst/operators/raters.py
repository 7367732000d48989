"""Derived raters: ingredient hazards, packaging and brand ethics from small dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, js_trim, normalize_ingredient, strip_norm
from .scoring import verdict_band

# Penalties, their cap, and the ingredients by category with the normalised names they go by.
PENALTY = {"prohibited": 55, "restricted": 12, "concern": 10, "allergen": 6}
ALLERGEN_CAP = 30
HAZARDS = [
    ("Formaldehyde", "prohibited", ["formaldehyde", "formalin", "methanal"]),
    ("Butylphenyl Methylpropional (Lilial)", "prohibited", ["butylphenylmethylpropional", "lilial", "2(4tertbutylbenzyl)propionaldehyde"]),
    ("Mercury / Thimerosal", "prohibited", ["mercury", "thimerosal", "thiomersal", "phenylmercuricacetate"]),
    ("Lead Acetate", "prohibited", ["leadacetate"]),
    ("Hydroquinone", "prohibited", ["hydroquinone"]),
    ("Phenoxyethanol", "restricted", ["phenoxyethanol"]),
    ("Salicylic Acid", "restricted", ["salicylicacid"]),
    ("Triclosan", "restricted", ["triclosan"]),
    ("Benzophenone-3 (Oxybenzone)", "restricted", ["benzophenone3", "oxybenzone"]),
    ("Propylparaben", "restricted", ["propylparaben"]),
    ("Butylparaben", "restricted", ["butylparaben"]),
    ("Retinol", "restricted", ["retinol", "retinylpalmitate", "retinylacetate"]),
    ("Fragrance / Parfum (undisclosed)", "concern", ["fragrance", "parfum", "aroma", "fragranceparfum"]),
    ("Methylparaben", "concern", ["methylparaben", "ethylparaben"]),
    ("BHT / BHA", "concern", ["bht", "butylatedhydroxytoluene", "bha", "butylatedhydroxyanisole"]),
    ("Sodium Lauryl Sulfate", "concern", ["sodiumlaurylsulfate"]),
    ("Limonene", "allergen", ["limonene", "dlimonene"]),
    ("Linalool", "allergen", ["linalool"]),
    ("Citronellol", "allergen", ["citronellol"]),
    ("Geraniol", "allergen", ["geraniol"]),
    ("Citral", "allergen", ["citral"]),
    ("Eugenol", "allergen", ["eugenol"]),
    ("Coumarin", "allergen", ["coumarin"]),
    ("Benzyl Alcohol", "allergen", ["benzylalcohol"]),
    ("Benzyl Salicylate", "allergen", ["benzylsalicylate"]),
    ("Benzyl Benzoate", "allergen", ["benzylbenzoate"]),
    ("Hydroxycitronellal", "allergen", ["hydroxycitronellal"]),
    ("Isoeugenol", "allergen", ["isoeugenol"]),
    ("Cinnamal", "allergen", ["cinnamal"]),
    ("Cinnamyl Alcohol", "allergen", ["cinnamylalcohol"]),
    ("Amyl Cinnamal", "allergen", ["amylcinnamal"]),
    ("Hexyl Cinnamal", "allergen", ["hexylcinnamal"]),
    ("Farnesol", "allergen", ["farnesol"]),
    ("Alpha-Isomethyl Ionone", "allergen", ["alphaisomethylionone"]),
    ("Evernia Prunastri (Oakmoss) Extract", "allergen", ["everniaprunastriextract", "oakmoss"]),
]

# Packaging materials in order of priority (name, tier, score, resin, words) and how tiers read.
TIER_LABEL = {"widely_recyclable": "widely recyclable", "limited": "limited recyclability", "rarely_recyclable": "rarely recycled", "not_recyclable": "hard to recycle"}
TIER_SCORE = {"widely_recyclable": 88, "limited": 52, "rarely_recyclable": 28, "not_recyclable": 14}
GENERIC_PLASTIC = "Plastic (unspecified)"
MATERIALS = [
    ("Pump / dispenser", "not_recyclable", 18, False, "pump dispenser sprayer spray trigger dropper applicator"),
    ("Laminate / composite", "not_recyclable", 16, False, "laminate laminated composite multilayer multimaterial tube sachet blister"),
    ("PET (#1)", "widely_recyclable", 80, True, "pet pete polyethyleneterephthalate terephthalate 1"),
    ("HDPE (#2)", "widely_recyclable", 78, True, "hdpe 2"),
    ("PVC (#3)", "not_recyclable", 12, True, "pvc vinyl polyvinylchloride 3"),
    ("LDPE (#4)", "rarely_recyclable", 30, True, "ldpe 4"),
    ("PP (#5)", "limited", 55, True, "pp polypropylene 5"),
    ("PS (#6)", "rarely_recyclable", 22, True, "ps polystyrene styrofoam 6"),
    ("Other plastic (#7)", "rarely_recyclable", 26, True, "o other 7 pla bioplastic acrylic pmma san abs"),
    (GENERIC_PLASTIC, "limited", 46, False, "plastic"),
    ("Glass", "widely_recyclable", 92, False, "glass"),
    ("Aluminium", "widely_recyclable", 88, False, "aluminium aluminum alu"),
    ("Steel / tin", "widely_recyclable", 85, False, "steel tin iron tinplate"),
    ("Metal (unspecified)", "widely_recyclable", 82, False, "metal"),
    ("Paper / cardboard", "widely_recyclable", 82, False, "paper cardboard card carton paperboard corrugated kraft fibre fiber"),
]

# Certification of brands (brand, status, names) and the scores of statuses.
STATUS_SCORE = {"certified_vegan": 92, "certified": 85, "parent_conflict": 55, "not_certified": 30}
ETHICS = [
    ("e.l.f.", "certified_vegan", ["e.l.f.", "elf", "elf cosmetics", "e l f"]),
    ("Pacifica", "certified_vegan", ["pacifica", "pacifica beauty"]),
    ("Olaplex", "certified_vegan", ["olaplex", "olaplex inc"]),
    ("Glossier", "certified", ["glossier", "glossier inc"]),
    ("Lumen Botanicals", "certified_vegan", ["lumen botanicals", "lumen"]),
    ("Vela Skin", "certified", ["vela skin", "vela", "vela skin co"]),
    ("Fern & Field", "certified_vegan", ["fern & field", "fern and field", "fern field", "fern"]),
    ("Drunk Elephant", "certified", ["drunk elephant", "drunkelephant"]),
    ("Burt's Bees", "certified", ["burt's bees", "burts bees", "burt bees"]),
    ("The Ordinary", "parent_conflict", ["the ordinary", "ordinary", "theordinary", "deciem"]),
    ("CeraVe", "not_certified", ["cerave", "cera ve"]),
    ("La Roche-Posay", "not_certified", ["la roche-posay", "la roche posay", "larocheposay"]),
    ("Maybelline", "not_certified", ["maybelline", "maybelline new york", "maybelline ny"]),
    ("Neutrogena", "not_certified", ["neutrogena"]),
    ("Aveeno", "not_certified", ["aveeno"]),
]
ETHICS_AS_OF = "2024-06"

LABEL = {"excellent": "Excellent", "good": "Good", "fair": "Fair", "poor": "Poor", "bad": "Bad"}


def band_label(score: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABEL.items() for x in kv]), verdict_band(score)), F.lit("Unknown"))


def hazard_keys() -> dict[str, tuple[str, str, int]]:
    """Hazard, category and penalty by normalised name; of entries with one name the later stands."""
    keys = {}
    for name, category, synonyms in HAZARDS:
        for s in synonyms:
            keys["".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())] = (name, category, PENALTY[category])
    return keys


def hazard_dictionary(spark: SparkSession) -> DataFrame:
    """(key, hazard, category, penalty)."""
    return spark.createDataFrame([(k, *v) for k, v in hazard_keys().items()], "key string, hazard string, category string, penalty int")


def hazard_matches(lists: DataFrame) -> DataFrame:
    """(product_id, pos, ingredient, hazard, category, penalty) of recognised ingredients, once a normalised name, in order.

    lists: product_id, ingredients. Allergens share 30 points in their order, so later ones may cost less or nothing.
    """
    each = lists.select("product_id", F.posexplode("ingredients").alias("pos", "raw")).withColumn("ingredient", js_trim(F.col("raw"))).where("ingredient <> ''")
    # what the dictionary of some fifty rows doesn't know goes before anything is grouped
    known = each.withColumn("key", normalize_ingredient(F.col("ingredient"))).join(F.broadcast(hazard_dictionary(lists.sparkSession)), "key")
    first = known.groupBy("product_id", "key", "hazard", "category", "penalty").agg(F.min(F.struct("pos", "ingredient")).alias("f"))
    hit = first.select("product_id", "f.pos", "f.ingredient", "hazard", "category", "penalty")
    before = Window.partitionBy("product_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.when(F.col("category") == "allergen", F.col("penalty"))).over(before), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("penalty"), F.lit(ALLERGEN_CAP) - spent)).cast("int")
    return hit.withColumn("penalty", F.when(F.col("category") == "allergen", left).otherwise(F.col("penalty")))


def hazard_scores(lists: DataFrame) -> DataFrame:
    """(product_id, score, label, flagged, ingredient_count, summary); products without ingredients have no row.

    A list is judged where it stands: its recognised names are an array of categories, no row each. Allergens that share a cap
    in their order cost their sum, or the cap.
    """
    stated = F.filter(F.transform("ingredients", js_trim), lambda x: x != "")
    category = F.create_map(*[F.lit(x) for k, (_, c, _) in hazard_keys().items() for x in (k, c)])
    found = F.filter(F.transform(F.array_distinct(F.transform("stated", normalize_ingredient)), lambda k: F.try_element_at(category, k)), lambda c: c.isNotNull())
    base = lists.select("product_id", stated.alias("stated")).select("product_id", F.size("stated").alias("ingredient_count"), found.alias("found")).where("ingredient_count > 0")
    n = {c: F.size(F.filter("found", lambda x: x == c)).cast("long").alias(c) for c in PENALTY}  # noqa: B023
    out = base.select("product_id", "ingredient_count", F.size("found").cast("long").alias("flagged"), *n.values())
    cost = sum((F.least(F.lit(ALLERGEN_CAP), F.col(c) * p) if c == "allergen" else F.col(c) * p for c, p in PENALTY.items()), F.lit(0))
    out = out.withColumn("cost", cost)
    score = js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.col("cost"))))
    said = {"prohibited": " prohibited", "restricted": " restricted", "concern": " of concern", "allergen": " regulated allergen"}
    part = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t), F.when(F.lit(c == "allergen") & (F.col(c) != 1), "s").otherwise(""))) for c, t in said.items()]
    total = F.col("ingredient_count").cast("string")
    none = F.concat(F.lit("No regulated hazards recognized among "), total, F.when(F.col("ingredient_count") == 1, " ingredient.").otherwise(" ingredients."))
    some = F.concat(F.lit("Flagged "), F.col("flagged").cast("string"), F.lit(" of "), total, F.lit(" ingredients: "), F.concat_ws(", ", *part), F.lit("."))
    return out.select("product_id", score.cast("double").alias("score"), band_label(score.cast("double")).alias("label"), "flagged", "ingredient_count", F.when(F.col("flagged") == 0, none).otherwise(some).alias("summary"))


def material_dictionary(spark: SparkSession) -> DataFrame:
    """(word, priority, material, tier, material_score, resin)."""
    rows = [(w, i, name, tier, score, resin) for i, (name, tier, score, resin, words) in enumerate(MATERIALS) for w in words.split()]
    return spark.createDataFrame(rows, "word string, priority int, material string, tier string, material_score int, resin boolean")


def packaging_matches(lists: DataFrame) -> DataFrame:
    """(product_id, pos, raw, material, tier, material_score, resin): each stated material's entry of highest priority, once
    an entry; plastic that isn't specified goes where a resin is named. lists: product_id, materials."""
    each = lists.select("product_id", F.posexplode("materials").alias("pos", "raw")).withColumn("raw", js_trim(F.col("raw"))).where("raw <> ''")
    plain = F.regexp_replace(F.regexp_replace(F.lower("raw"), "^[a-z]{2}:", ""), "[^a-z0-9]+", " ")
    words = each.withColumn("word", F.explode(F.array_distinct(F.split(F.trim(plain), " ")))).where("word <> ''")
    entry = F.struct("priority", "material", "tier", "material_score", "resin")
    # the dictionary has some sixty rows
    hit = words.join(F.broadcast(material_dictionary(lists.sparkSession)), "word").groupBy("product_id", "pos", "raw").agg(F.min(entry).alias("e"))
    once = hit.groupBy("product_id", F.col("e.material").alias("material")).agg(F.min(F.struct("pos", "raw", "e")).alias("f"))
    out = once.select("product_id", "f.pos", "f.raw", "material", "f.e.tier", "f.e.material_score", "f.e.resin")
    named = F.max("resin").over(Window.partitionBy("product_id"))
    return out.withColumn("_named", named).where(~F.col("_named") | (F.col("material") != GENERIC_PLASTIC)).drop("_named")


def packaging_scores(lists: DataFrame) -> DataFrame:
    """(product_id, score, label, components, summary): the rounded mean of the matched materials; no row without any."""
    tier = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in TIER_LABEL.items() for x in kv]), c)
    m = F.struct("material", "tier")
    g = packaging_matches(lists).groupBy("product_id").agg(
        F.avg("material_score").alias("mean"),
        F.count("*").alias("components"),
        F.min_by(m, F.struct("material_score", "pos")).alias("worst"),
        F.max_by(m, F.struct(F.col("material_score"), -F.col("pos"))).alias("best"),
    )
    score = js_round(F.col("mean")).cast("double")
    one = F.concat(F.col("best.material"), F.lit(" — "), tier(F.col("best.tier")), F.lit("."))
    more = F.concat(F.col("components").cast("string"), F.lit(" packaging components: best is "), F.col("best.material"), F.lit(" ("), tier(F.col("best.tier")), F.lit("), limited by "), F.col("worst.material"), F.lit(" ("), tier(F.col("worst.tier")), F.lit(")."))
    return g.select("product_id", score.alias("score"), band_label(score).alias("label"), "components", F.when(F.col("components") == 1, one).otherwise(more).alias("summary"))


def ethics_dictionary(spark: SparkSession) -> DataFrame:
    rows = {"".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum()): (brand, status, float(STATUS_SCORE[status])) for brand, status, names in ETHICS for n in names}
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "key string, certified_brand string, status string, score double")


def brand_names(brands: DataFrame) -> DataFrame:
    """(brand_id, names, parent_names): own name and aliases, then those of the parent brand."""
    all_names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = brands.select(F.col("id").alias("brand_id"), "parent_id", all_names.alias("names"))
    parent = own.select(F.col("brand_id").alias("parent_id"), F.col("names").alias("parent_names"))
    return own.join(parent, "parent_id", "left").select("brand_id", "names", F.coalesce("parent_names", F.array().cast("array<string>")).alias("parent_names"))


def ethics_scores(products: DataFrame, brands: DataFrame) -> DataFrame:
    """(product_id, score, label, status, certified_brand, via_parent): the first name that is known, the parent's after its own."""
    n = brand_names(brands)
    each = n.select("brand_id", F.size("names").alias("own"), F.posexplode(F.concat("names", "parent_names")).alias("pos", "name")).withColumn("key", strip_norm(F.col("name")))
    # some forty rows
    hit = each.join(F.broadcast(ethics_dictionary(products.sparkSession)), "key").groupBy("brand_id").agg(F.min(F.struct("pos", "own", "certified_brand", "status", "score")).alias("e"))
    p = products.select(F.col("id").alias("product_id"), "brand_id").join(hit, "brand_id")
    return p.select("product_id", "e.score", band_label(F.col("e.score")).alias("label"), "e.status", "e.certified_brand", (F.col("e.pos") >= F.col("e.own")).alias("via_parent"))


def rater_listings(products: DataFrame, scores: DataFrame, prefix: str, source_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(listings, ratings) of a derived rater, ids prefix-product; the assessment is kept as JSON."""
    rest = [c for c in scores.columns if c != "product_id"]
    joined = products.withColumnRenamed("id", "product_id").join(scores, "product_id")
    at = F.to_timestamp(F.lit(now))
    listing_id = F.concat(F.lit(f"{prefix}-"), F.col("product_id"))
    listings = joined.select(
        listing_id.alias("id"), F.lit(source_id).alias("source_id"), F.col("product_id").alias("native_id"), F.col("display_name").alias("raw_name"),
        F.to_json(F.struct(*rest)).alias("payload"), at.alias("fetched_at"), "product_id",
    )
    ratings = joined.select(F.concat(F.lit("r-"), listing_id).alias("id"), listing_id.alias("listing_id"), F.col("score").alias("score_raw"), F.col("label").alias("score_label"), at.alias("ingested_at"))
    return listings, ratings


def derivation_summary(products: DataFrame, scores: DataFrame) -> DataFrame:
    """(scored, skipped, mean_score) of a derivation run."""
    joined = products.select(F.col("id").alias("product_id")).join(scores.select("product_id", "score"), "product_id", "left")
    return joined.agg(F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("skipped"), F.avg("score").alias("mean_score"))
