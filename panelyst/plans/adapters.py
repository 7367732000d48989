"""Driver tables seen as catalog tables, by arithmetic that SQL can repeat. Each view has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scoring import AXES

INGREDIENTS = [
    "Aqua", "Glycerin", "Limonene", "Linalool", "Parfum", "Phenoxyethanol", "Retinol", "Citral", "Niacinamide", "Squalane", "Formaldehyde", "Tocopherol",
    "Geraniol", "Eugenol", "Coumarin", "Benzyl Alcohol", "Methylparaben", "BHT", "Panthenol", "Shea Butter", "Salicylic Acid", "Citronellol", "Farnesol", "Zinc Oxide",
]
MATERIALS = ["en:glass", "PP 5 cap", "pump", "plastic", "PET bottle", "box", "cardboard", "aluminium", "PVC", "tube"]
SUFFIXES = [" SPF 30", " lavender", " shade 120", " 2 pack", ""]
ALIASES = ["CeraVe", "e.l.f.", "No Such Brand", "The Ordinary", "Pacifica Beauty", "Unknown Co", "Aveeno", "Glossier"]
FUNDING = ["nonprofit", "independent", "ad_supported", "subscription"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key: a table of few bytes is read by one task or two, whatever is made of each of its rows later."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def _one_of(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def products(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """part as product: id, brand_id, display_name, category, gtin, size_value, size_unit, ingredients, sort_index, ord. ``spread``
    deals the rows to many tasks before anything is made of them."""
    part = table(spark, sf_dir, "part")
    part = dealt(part, "p_partkey") if spread else part
    k = F.col("p_partkey")
    i = F.sequence(F.lit(0), F.lit(7))
    return part.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_brand").alias("brand_id"), F.concat("p_name", _one_of(SUFFIXES, k % 5)).alias("display_name"),
        F.col("p_type").alias("category"), F.when(k % 3 == 0, F.lpad((k % 1500).cast("string"), 12, "0")).alias("gtin"), F.col("p_size").cast("double").alias("size_value"), F.lit("ml").alias("size_unit"),
        F.transform(i, lambda x: _one_of(INGREDIENTS, (k * 7 + x * x * (k % 13 + 1)) % len(INGREDIENTS))).alias("ingredients"),
        F.array(_one_of(MATERIALS, k % 10), _one_of(MATERIALS, (k * 3 + 1) % 10)).alias("materials"),
        F.when(k % 4 == 0, F.lit(1000)).otherwise(k).cast("int").alias("sort_index"), k.alias("ord"),
    )


PRODUCT = f"""product AS (
  SELECT 'p' || p_partkey AS id, p_brand AS brand_id, p_name || {_sql_list(SUFFIXES)}[CAST(p_partkey % 5 AS INT) + 1] AS display_name, p_type AS category,
         CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey % 1500 AS VARCHAR), 12, '0') END AS gtin, CAST(p_size AS DOUBLE) AS size_value, 'ml' AS size_unit,
         list_transform(range(8), lambda x: {_sql_list(INGREDIENTS)}[CAST((p_partkey * 7 + x * x * (p_partkey % 13 + 1)) % {len(INGREDIENTS)} AS INT) + 1]) AS ingredients,
         [{_sql_list(MATERIALS)}[CAST(p_partkey % 10 AS INT) + 1], {_sql_list(MATERIALS)}[CAST((p_partkey * 3 + 1) % 10 AS INT) + 1]] AS materials,
         CASE WHEN p_partkey % 4 = 0 THEN 1000 ELSE CAST(p_partkey AS INT) END AS sort_index, p_partkey AS ord
  FROM part)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct p_brand as brand: id, name, parent_id, aliases, ord; each brand's parent is the one before it in fours."""
    each = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    order = Window.orderBy("id")
    numbered = each.withColumn("ord", F.row_number().over(order) - 1).withColumn("before", F.lag("id").over(order))
    aliases = F.when(F.col("ord") % 3 == 0, F.array(_one_of(ALIASES, (F.col("ord") / 3).cast("int") % len(ALIASES)))).otherwise(F.array().cast("array<string>"))
    return numbered.select("id", F.col("id").alias("name"), F.when(F.col("ord") % 4 == 1, F.col("before")).alias("parent_id"), aliases.alias("aliases"), "ord")


BRAND = f"""brand0 AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord, lag(id) OVER (ORDER BY id) AS before FROM (SELECT DISTINCT p_brand AS id FROM part)),
brand AS (SELECT id, id AS name, CASE WHEN ord % 4 = 1 THEN before END AS parent_id,
                 CASE WHEN ord % 3 = 0 THEN [{_sql_list(ALIASES)}[CAST((ord // 3) % {len(ALIASES)} AS INT) + 1]] ELSE CAST([] AS VARCHAR[]) END AS aliases, ord FROM brand0)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as source: axis by key, scale 0 to 50, direction and funding by nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), _one_of(AXES, k % 4).alias("axis"), F.lit(0.0).alias("scale_min"), F.lit(50.0).alias("scale_max"),
        F.when(n % 2 == 0, "higher_is_better").otherwise("lower_is_better").alias("scale_direction"), _one_of(FUNDING, n % 4).alias("funding_model"),
    )


SOURCE = f"""source AS (
  SELECT 's' || s_suppkey AS id, s_name AS name, {_sql_list(AXES)}[CAST(s_suppkey % 4 AS INT) + 1] AS axis, 0.0::DOUBLE AS scale_min, 50.0::DOUBLE AS scale_max,
         CASE WHEN s_nationkey % 2 = 0 THEN 'higher_is_better' ELSE 'lower_is_better' END AS scale_direction, {_sql_list(FUNDING)}[CAST(s_nationkey % 4 AS INT) + 1] AS funding_model
  FROM supplier)"""


def ratings(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """lineitem as ratings by product: a third of the scale's width, confidence by discount, reviewed by return flag. ``placed`` adds
    ``at``, the row's place in the table."""
    rows = table(spark, sf_dir, "lineitem")
    at = F.struct("_metadata.file_path", "_metadata.row_index") if placed and len(rows.inputFiles()) > 1 else F.col("_metadata.row_index")
    return rows.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"),
        (F.lit(17.0) + F.col("l_quantity") / 3.0).alias("score_raw"), (1 - F.col("l_discount")).alias("match_confidence"), F.lit("seed").alias("match_method"),
        (F.col("l_returnflag") == "R").alias("match_reviewed"), F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).alias("ord"),
        *([at.alias("at")] if placed else []),
    )


RATING = """rating AS (
  SELECT 'p' || l_partkey AS product_id, 's' || l_suppkey AS source_id, 17.0::DOUBLE + l_quantity / 3.0::DOUBLE AS score_raw, 1 - l_discount AS match_confidence,
         l_returnflag = 'R' AS match_reviewed, struct_pack(o := l_orderkey, l := l_linenumber) AS ord
  FROM lineitem)"""

RATED = f"""{SOURCE},
{RATING},
rated AS (
  SELECT r.*, s.name AS source_name, s.axis, s.funding_model,
         CASE WHEN s.scale_direction = 'higher_is_better' THEN (greatest(scale_min, least(scale_max, score_raw)) - scale_min) / (scale_max - scale_min) * 100
              ELSE (1 - (greatest(scale_min, least(scale_max, score_raw)) - scale_min) / (scale_max - scale_min)) * 100 END AS score
  FROM rating r JOIN source s ON r.source_id = s.id)"""

PILLARS = f"""{RATED},
pillar AS (
  SELECT product_id, axis, avg(score) AS representative, CASE WHEN count(*) > 1 THEN min(score) END AS spread_min, CASE WHEN count(*) > 1 THEN max(score) END AS spread_max,
         count(*) AS n, count(*) > 1 AND max(score) - min(score) >= 20 AS disagreement
  FROM rated GROUP BY product_id, axis)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as items to match: id, brand, name, gtin, ingredients, size_value, size_unit, ord, product_id."""
    p = products(spark, sf_dir, spread=True)
    return p.select("id", F.col("brand_id").alias("brand"), F.col("display_name").alias("name"), "gtin", "ingredients", "size_value", "size_unit", "ord", F.col("id").alias("product_id"))


def shelf_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as views of items: user_id, item (key k of the properties), ts."""
    return table(spark, sf_dir, "events").select("user_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("item"), "ts")
