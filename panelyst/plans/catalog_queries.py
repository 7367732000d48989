"""Registered queries of the rating engine over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import agreement, blocking, catalog, generic_names, matching, raters, scoring, training
from ..sources import pages as shop_pages
from . import adapters as a

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


def _rated(spark: SparkSession, d: str, placed: bool = False) -> DataFrame:
    return scoring.normalized_ratings(a.ratings(spark, d, placed), a.sources(spark, d))


def _pillars(spark: SparkSession, d: str, ends: bool = False, in_order: bool = False) -> DataFrame:
    return scoring.pillars(_rated(spark, d, ends or in_order), False, ends, in_order)


def _products(spark: SparkSession, d: str) -> DataFrame:
    return a.products(spark, d)


def _every(spark: SparkSession, d: str) -> DataFrame:
    return scoring.all_pillars(_products(spark, d).select(F.col("id").alias("product_id")), _pillars(spark, d))


# ------------------------------------------------------------------------------------------------ scoring

BAND = "CASE WHEN {x} >= 85 THEN 'excellent' WHEN {x} >= 70 THEN 'good' WHEN {x} >= 55 THEN 'fair' WHEN {x} >= 40 THEN 'poor' WHEN {x} IS NOT NULL THEN 'bad' END"
TIER = "CASE WHEN match_reviewed THEN 'verified' WHEN match_confidence IS NULL THEN 'verified' WHEN match_confidence >= 0.9 THEN 'auto' ELSE 'weak' END"
AXIS_ORD = "list_position(['ingredient_safety', 'environmental', 'labor', 'packaging'], axis)"


@registered("normalized_ratings", f"WITH {a.RATED} SELECT product_id, source_id, axis, funding_model, round(score, 6) AS score, {TIER} AS tier, {BAND.format(x='score')} AS band FROM rated")
def normalized_ratings(spark, d):
    out = _rated(spark, d)
    return out.select("product_id", "source_id", "axis", "funding_model", r6("score").alias("score"), agreement.rating_tier().alias("tier"), scoring.verdict_band(F.col("score")).alias("band"))


@registered("pillar_summary", f"""WITH {a.PRODUCT}, {a.PILLARS}
SELECT p.id AS product_id, x.axis, round(representative, 6) AS representative, round(spread_min, 6) AS spread_min, round(spread_max, 6) AS spread_max,
       coalesce(n, 0) AS n, coalesce(disagreement, FALSE) AS disagreement
FROM product p CROSS JOIN (SELECT unnest(['ingredient_safety', 'environmental', 'labor', 'packaging']) AS axis) x
LEFT JOIN pillar q ON q.product_id = p.id AND q.axis = x.axis""")
def pillar_summary(spark, d):
    return _every(spark, d).select("product_id", "axis", *[r6(c).alias(c) for c in ("representative", "spread_min", "spread_max")], F.col("n").cast("long").alias("n"), "disagreement")


COMPOSITE = """composite AS (
  SELECT product_id, sum(w * representative) / sum(w) AS overall, sum(w * coalesce(spread_min, representative)) / sum(w) AS overall_min,
         sum(w * coalesce(spread_max, representative)) / sum(w) AS overall_max
  FROM pillar JOIN (SELECT unnest(['ingredient_safety', 'environmental', 'labor', 'packaging']) AS axis, unnest([1.0, 1.0, 1.0, 1.0]::DOUBLE[]) AS w) ws USING (axis)
  GROUP BY product_id)"""


@registered("pillar_composite", f"""WITH {a.PILLARS}, {COMPOSITE}
SELECT product_id, round(overall, 6) AS overall, round(overall_min, 6) AS overall_min, round(overall_max, 6) AS overall_max, {BAND.format(x='round(overall, 6)')} AS band FROM composite""")
def pillar_composite(spark, d):
    c = scoring.composites(_pillars(spark, d), scoring.default_weights(spark))
    return c.select("product_id", *[r6(x).alias(x) for x in ("overall", "overall_min", "overall_max")], scoring.verdict_band(r6("overall")).alias("band"))


@registered("top_drivers", f"""WITH {a.PILLARS}, {COMPOSITE},
m AS (SELECT product_id, axis, representative - overall AS diff, {AXIS_ORD} AS o FROM pillar JOIN composite USING (product_id) WHERE abs(representative - overall) >= 0.5)
SELECT product_id, axis, CASE WHEN diff > 0 THEN 'lifts' ELSE 'drags' END AS direction, round(abs(diff), 6) AS magnitude
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(abs(diff), 9) DESC, o) AS r FROM m) WHERE r = 1""")
def top_drivers(spark, d):
    return scoring.top_drivers(_pillars(spark, d), scoring.default_weights(spark)).withColumn("magnitude", r6("magnitude"))


@registered("marginal_effects", f"""WITH {a.PRODUCT}, {a.PILLARS}, {COMPOSITE}
SELECT p.id AS product_id, x.axis, CASE WHEN representative IS NULL THEN 'unavailable' WHEN overall IS NULL THEN 'lifts' WHEN abs(representative - overall) < 1e-9 THEN 'neutral'
       WHEN representative > overall THEN 'lifts' ELSE 'drags' END AS effect
FROM product p CROSS JOIN (SELECT unnest(['ingredient_safety', 'environmental', 'labor', 'packaging']) AS axis) x
LEFT JOIN pillar q ON q.product_id = p.id AND q.axis = x.axis LEFT JOIN composite c ON c.product_id = p.id""")
def marginal_effects(spark, d):
    wide = _products(spark, d).select(F.col("id").alias("product_id")).distinct().join(scoring.axis_means(_rated(spark, d)), "product_id", "left")
    return scoring.effects_of_axes(wide, scoring.default_weights(spark))


#: Pillars with their ends, one pass over the ratings.
ENDED = f"""{a.RATED},
ended AS MATERIALIZED (
  SELECT product_id, axis, count(*) AS n, avg(score) AS representative, min(score) AS spread_min, max(score) AS spread_max, count(*) > 1 AND max(score) - min(score) >= 20 AS disagreement,
         arg_min(source_name, ord) AS first_source, min((score, ord, source_name, funding_model)) AS lo, max((score, ord, source_name, funding_model)) AS hi
  FROM rated GROUP BY product_id, axis)"""
PHRASE = "CASE {x} WHEN 'ingredient_safety' THEN 'ingredient safety' WHEN 'environmental' THEN 'environmental impact' WHEN 'labor' THEN 'labor practices' ELSE 'packaging' END"


@registered("disagreements", f"""WITH {ENDED}
SELECT product_id, axis, round(spread_max - spread_min, 6) AS spread, lo[3] AS low_source, hi[3] AS high_source,
       hi[3] || ' (' || hi[4] || ') scores ' || CAST(floor(hi[1] + 0.5) AS BIGINT) || ' on ' || {PHRASE.format(x='axis')} || '; ' || lo[3] || ' (' || lo[4] || ') scores '
       || CAST(floor(lo[1] + 0.5) AS BIGINT) || '. Spread ' || CAST(floor(spread_max - spread_min + 0.5) AS BIGINT) || ' points.' AS line
FROM ended WHERE disagreement""")
def disagreements(spark, d):
    out = agreement.disagreements(_pillars(spark, d, True))
    return out.select("product_id", "axis", r6("spread").alias("spread"), F.col("low.source_name").alias("low_source"), F.col("high.source_name").alias("high_source"), agreement.describe_disagreement().alias("line"))


@registered("coverage", f"""WITH {a.RATED}, t AS (SELECT *, CASE {TIER} WHEN 'weak' THEN 2 WHEN 'auto' THEN 1 ELSE 0 END AS k FROM rated)
SELECT product_id, count(*) AS source_count, count(DISTINCT axis) AS axes_covered, ['verified', 'auto', 'weak'][max(k) + 1] AS weakest_tier, max(k) > 0 AS has_unreviewed, max(k) > 1 AS has_weak, count(DISTINCT axis) < 4 AS sparse
FROM t GROUP BY product_id""")
def coverage(spark, d):
    return agreement.coverage(_rated(spark, d))


@registered("driver_prose", f"""WITH {ENDED}, pillar AS (SELECT *, CASE WHEN n > 1 THEN spread_max END AS m FROM ended),
c AS (SELECT product_id, avg(representative) AS overall, avg(coalesce(m, representative)) AS top FROM pillar GROUP BY product_id),
m AS (SELECT p.*, representative - overall AS diff, {AXIS_ORD} AS o FROM pillar p JOIN c USING (product_id) WHERE abs(representative - overall) >= 0.5),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(abs(diff), 9) DESC, o) = 1),
b AS (SELECT *, {BAND.format(x='overall')} AS was, {BAND.format(x='top')} AS now FROM (SELECT product_id, round(overall, 6) AS overall, round(top, 6) AS top FROM c))
SELECT b.product_id,
       {PHRASE.format(x='t.axis')} || CASE WHEN t.diff > 0 THEN ' lifts' ELSE ' drags' END || ' the score most: ' || CASE WHEN t.disagreement THEN t.lo[3] || ' and ' || t.hi[3] ELSE t.first_source END AS text,
       'This one looks ' || was || '.' AS greeting,
       CASE WHEN abs(top - overall) < 0.5 THEN 'Weighing labor practices barely moves it.'
            ELSE 'Weighing labor practices' || CASE WHEN top > overall THEN ' lifts' ELSE ' drops' END || ' it to ' || CAST(floor(top + 0.5) AS BIGINT) || CASE WHEN was <> now THEN ', from ' || was || ' to ' || now ELSE '' END || '.' END AS change
FROM b LEFT JOIN t USING (product_id)""")
def driver_prose(spark, d):
    """Prose about top drivers, composites and weight changes."""
    found = _pillars(spark, d, True)
    w = scoring.default_weights(spark)
    text_ = agreement.describe_driver(scoring.top_drivers(found, w), found)
    # sums in another order differ in their last digits, which halves would show
    c = scoring.composites(found, w).withColumns({x: r6(x) for x in ("overall", "overall_max")})
    line = agreement.narrate_weight_change(F.lit("labor"), F.col("overall"), F.col("overall_max"))
    return c.join(text_, "product_id", "left").select("product_id", "text", agreement.greet(F.col("overall")).alias("greeting"), line.alias("change"))


# ------------------------------------------------------------------------------------------------ catalog

WIDEST = "widest AS (SELECT product_id, coalesce(max(CASE WHEN disagreement THEN spread_max - spread_min END), 0.0) AS widest, avg(representative) AS mean FROM pillar GROUP BY product_id)"


@registered("browse_contested", f"""WITH {a.PRODUCT}, {a.PILLARS}, {WIDEST}
SELECT p.id AS product_id, p.display_name, p.category, round(mean, 6) AS mean, round(coalesce(widest, 0), 6) AS widest FROM product p LEFT JOIN widest w ON w.product_id = p.id""")
def browse_contested(spark, d):
    found = _pillars(spark, d)
    out = catalog.browse(_products(spark, d), scoring.mean_of_pillars(found), scoring.max_spread(found), "contested")
    return out.select("product_id", "display_name", "category", r6("mean").alias("mean"), r6("widest").alias("widest"))


@registered("most_contested", f"WITH {a.PILLARS}, {WIDEST} SELECT product_id, round(widest, 6) AS widest FROM widest WHERE widest > 0")
def most_contested(spark, d):
    return catalog.most_contested(scoring.max_spread(_pillars(spark, d))).withColumn("widest", r6("widest"))


@registered("list_products", f"""WITH {a.PRODUCT} SELECT id, display_name, category, sort_index FROM product
WHERE sort_index < 1000 OR id IN (SELECT 'p' || l_partkey FROM lineitem) ORDER BY sort_index, id LIMIT 200""")
def list_products(spark, d):
    rated = a.ratings(spark, d).select("product_id").distinct()
    return catalog.list_products(_products(spark, d), rated).select("id", "display_name", "category", "sort_index")


@registered("search_products", f"""WITH {a.PRODUCT}, {a.BRAND} SELECT p.id, p.display_name, b.name AS brand_name FROM product p LEFT JOIN brand b ON b.id = p.brand_id
WHERE contains(lower(p.display_name), 'lavender') OR contains(lower(b.name), 'lavender') OR contains(lower(p.gtin), 'lavender')""")
def search_products(spark, d):
    return catalog.search_products(_products(spark, d), a.brands(spark, d), "  LavendER ").select("id", "display_name", "brand_name")


SAFE = "safe AS (SELECT p.id, p.category, q.representative AS s FROM product p LEFT JOIN pillar q ON q.product_id = p.id AND q.axis = 'ingredient_safety')"


@registered("alternatives", f"""WITH {a.PRODUCT}, {a.PILLARS}, {SAFE}, wide AS (SELECT product_id, {', '.join(f"max(CASE WHEN axis = '{x}' THEN representative END) AS {x}" for x in scoring.AXES)} FROM pillar GROUP BY product_id)
SELECT b.id AS product_id, x.id AS alt_id, round(x.s, 6) AS alt_safety,
       array_to_string(list_filter([{', '.join(f"CASE WHEN wa.{x} - wb.{x} >= 5 THEN '{x}' END" for x in scoring.AXES)}], lambda z: z IS NOT NULL), ',') AS cleaner,
       array_to_string(list_filter([{', '.join(f"CASE WHEN wa.{x} - wb.{x} <= -5 THEN '{x}' END" for x in scoring.AXES)}], lambda z: z IS NOT NULL), ',') AS tradeoffs
FROM safe b JOIN safe x ON x.category = b.category AND x.id <> b.id AND x.s IS NOT NULL AND x.s > coalesce(b.s, '-infinity'::DOUBLE)
LEFT JOIN wide wa ON wa.product_id = x.id LEFT JOIN wide wb ON wb.product_id = b.id""")
def alternatives(spark, d):
    # every mean is a sum in the table's order, as SQL without a thread beside it has it: safety is compared to its last digit
    every = scoring.all_pillars(_products(spark, d).select(F.col("id").alias("product_id")), _pillars(spark, d, in_order=True))
    out = catalog.alternatives(_products(spark, d), every, shown=r6)
    return out.select("product_id", "alt_id", "alt_safety", F.array_join("cleaner", ",").alias("cleaner"), F.array_join("tradeoffs", ",").alias("tradeoffs"))


@registered("top_alternative", f"""WITH {a.PRODUCT}, {a.PILLARS}, {SAFE}
SELECT b.id AS product_id, arg_min(x.id, x.id) AS alt_id, round(any_value(x.s), 6) AS alt_safety FROM safe b JOIN (SELECT category, max(s) AS top FROM safe GROUP BY category) t ON t.category = b.category
JOIN safe x ON x.category = b.category AND x.s = t.top WHERE coalesce(b.s, '-infinity'::DOUBLE) < t.top GROUP BY b.id""")
def top_alternative(spark, d):
    return catalog.top_alternative(_products(spark, d), _every(spark, d)).withColumn("alt_safety", r6("alt_safety"))


@registered("shelf", """WITH s AS (SELECT user_id, coalesce(props::JSON ->> 'k', 'none') AS item, max(ts) AS last_seen FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen DESC, item) AS place FROM s) SELECT user_id, item, last_seen, place FROM r WHERE place <= 24""")
def shelf(spark, d):
    return catalog.shelf(a.shelf_views(spark, d)).withColumn("place", F.col("place").cast("long"))


@registered("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("part", "supplier", "lineitem", "events", "documents", "pages", "labels")))
def table_counts(spark, d):
    return catalog.table_counts({t: a.table(spark, d, t) for t in ("part", "supplier", "lineitem", "events", "documents", "pages", "labels")})


@registered("spotlight", f"""WITH {a.PILLARS}, {COMPOSITE} SELECT product_id, CAST(floor(overall + 0.5) AS BIGINT) AS overall, {BAND.format(x='overall')} AS band FROM composite WHERE product_id IN ('p1', 'p2', 'p3', 'p5', 'p8', 'p13')""")
def spotlight(spark, d):
    wanted = spark.createDataFrame([(f"p{i}", i) for i in (1, 2, 3, 5, 8, 13)], "product_id string, ord int")
    return catalog.spotlight(wanted, _pillars(spark, d), scoring.default_weights(spark))


# ------------------------------------------------------------------------------------------------ matching

NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
STRIP = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
TOKEN = f"list_filter(string_split({NORM.format(x='{x}')}, ' '), lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))[1]"
GTIN = "CASE WHEN length(regexp_replace(gtin, '[^0-9]+', '', 'g')) BETWEEN 8 AND 14 THEN lpad(regexp_replace(gtin, '[^0-9]+', '', 'g'), 14, '0') END"
ITEMS = f"""{a.PRODUCT}, {a.BRAND},
alias AS (SELECT alias, arg_min(id, ord) AS brand_id FROM (SELECT id, ord, {STRIP.format(x='n')} AS alias FROM (SELECT id, ord, unnest(list_distinct(list_prepend(name, aliases))) AS n FROM brand)) WHERE alias <> '' GROUP BY alias),
item AS (SELECT p.id, p.ord, p.display_name AS name, coalesce(x.brand_id, nullif({STRIP.format(x='p.brand_id')}, '')) AS brand_key, {GTIN} AS gtin14, {TOKEN.format(x='p.display_name')} AS token, p.ingredients,
                list_distinct(list_filter(list_transform(p.ingredients, lambda i: {STRIP.format(x='i')}), lambda i: i <> '')) AS iset
         FROM product p LEFT JOIN alias x ON x.alias = {STRIP.format(x='p.brand_id')})"""


def _named(spark, d):
    """Items with brand key, barcode and name token alone."""
    out = blocking.with_brand_key(a.items(spark, d), a.brands(spark, d))
    return out.withColumn("gtin14", text.normalize_gtin(F.col("gtin"))).withColumn("token", text.first_name_token(F.col("name")))


@registered("name_normalisation", f"""WITH {ITEMS} SELECT id, {NORM.format(x='name')} AS normalized, token, gtin14, brand_key FROM item""")
def name_normalisation(spark, d):
    return _named(spark, d).select("id", text.normalize_name(F.col("name")).alias("normalized"), "token", "gtin14", "brand_key")


@registered("generic_names", f"""WITH {a.PRODUCT}, n AS (SELECT display_name AS name FROM product), t AS (SELECT name, list_filter(string_split({NORM.format(x='name')}, ' '), lambda x: x <> '') AS tk FROM n),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tk)) AS token FROM t) GROUP BY token), total AS (SELECT count(*) AS total FROM n),
e AS (SELECT DISTINCT name, tk FROM t), j AS (SELECT name, bool_and(df * 1.0 / total >= 0.004) AS g FROM (SELECT name, unnest(tk) AS token FROM e WHERE len(tk) BETWEEN 1 AND 2) JOIN df USING (token), total GROUP BY name)
SELECT e.name, coalesce(g, FALSE) AS generic FROM e LEFT JOIN j USING (name)""")
def generic(spark, d):
    return generic_names.generic_names(_products(spark, d).select(F.col("display_name").alias("name")))


def _mul(x: str, m: int) -> str:
    return f"CAST((({x})::HUGEINT * {m}) % 4294967296 AS BIGINT)"


SEEDS = "([" + ", ".join(map(str, hashing.seeds())) + "]::BIGINT[])"
STEP = {
    "f1": "xor(b, s)",
    "f2": "xor(f1, f1 >> 16)",
    "f3": _mul("f2", 0x85EBCA6B),
    "f4": "xor(f3, f3 >> 13)",
    "f5": _mul("f4", 0xC2B2AE35),
}
MINHASH = f"""{ITEMS},
tok AS (SELECT t, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: {_mul('xor(h, c)', 16777619)}) AS b
        FROM (SELECT DISTINCT unnest(iset) AS t FROM item)),
f0 AS (SELECT t, b, k, {SEEDS}[k + 1] AS s FROM tok CROSS JOIN (SELECT unnest(range(64)) AS k)),
f1 AS (SELECT t, k, {STEP['f1']} AS f1 FROM f0), f2 AS (SELECT t, k, {STEP['f2']} AS f2 FROM f1), f3 AS (SELECT t, k, {STEP['f3']} AS f3 FROM f2),
f4 AS (SELECT t, k, {STEP['f4']} AS f4 FROM f3), f5 AS (SELECT t, k, {STEP['f5']} AS f5 FROM f4), mixed AS (SELECT t, k, xor(f5, f5 >> 16) AS v FROM f5),
sig AS (SELECT i.id, m.k, min(m.v) AS v FROM (SELECT id, unnest(iset) AS t FROM item WHERE len(iset) >= 5) i JOIN mixed m ON m.t = i.t GROUP BY i.id, m.k),
band AS (SELECT id, k // 4 AS band, list_reduce(list_prepend(2166136261::BIGINT, list(v ORDER BY k)), lambda h, c: {_mul('xor(h, c)', 16777619)}) AS h FROM sig GROUP BY id, k // 4)"""


@registered("minhash_bands", f"WITH {MINHASH} SELECT id, CAST(band AS BIGINT) AS band, h AS hash FROM band")
def minhash_bands(spark, d):
    sets = a.items(spark, d).select("id", text.normalized_set(F.col("ingredients")).alias("ingredient_set"))
    sig = blocking.with_bands(sets).select("id", F.posexplode("bands").alias("band", "key"))
    value = F.conv(F.upper(F.element_at(F.split("key", ":"), 3)), 36, 10).cast("long")
    return sig.select("id", F.col("band").cast("long").alias("band"), value.alias("hash"))


KEYED = f"""{MINHASH},
keyed AS (SELECT id, 'gtin:' || gtin14 AS key FROM item WHERE gtin14 IS NOT NULL UNION ALL SELECT id, 'brand+token:' || brand_key || ':' || token FROM item WHERE brand_key IS NOT NULL AND token IS NOT NULL
          UNION ALL SELECT id, 'ing:' || band || ':' || h FROM band)"""


@registered("clusters_by_code", f"""WITH RECURSIVE {a.PRODUCT}, g AS (SELECT id, {GTIN} AS k FROM product), h AS (SELECT id, k, min(id) OVER (PARTITION BY k) AS head FROM g WHERE k IS NOT NULL),
s AS (SELECT id, display_name || '|' || CAST(size_value AS BIGINT) || '|' || brand_id AS k FROM product), sh AS (SELECT id, min(id) OVER (PARTITION BY k) AS head FROM s),
e AS (SELECT id AS a, head AS b FROM h UNION SELECT head, id FROM h UNION SELECT id, head FROM sh UNION SELECT head, id FROM sh),
reach AS (SELECT id AS a, id AS b FROM product UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a""")
def clusters_by_code(spark, d):
    """Components of products that share a barcode, or name, size and brand: hubs instead of pairs."""
    p = _products(spark, d).withColumn("k1", text.normalize_gtin(F.col("gtin")))
    p = p.withColumn("k2", F.concat_ws("|", "display_name", F.col("size_value").cast("long").cast("string"), "brand_id"))
    links = None
    for k in ("k1", "k2"):
        heads = p.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("b"))
        one = p.join(heads.hint("merge"), k).select(F.col("id").alias("a"), "b")
        links = one if links is None else links.unionByName(one)
    return matching.clusters(p.select("id"), links)


# ------------------------------------------------------------------------------------------------ raters


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


HAZ = _values([("".join(c for c in s if c.isalnum()), n, k, raters.PENALTY[k]) for n, k, ss in raters.HAZARDS for s in ss])


@registered("hazard_scores", f"""WITH {a.PRODUCT}, dict(key, hazard, category, penalty) AS (VALUES {HAZ}),
each AS (SELECT id, i AS pos, {STRIP.format(x='ingredients[i]')} AS key FROM (SELECT id, ingredients, unnest(range(1, len(ingredients) + 1)) AS i FROM product)),
f AS (SELECT id, key, min(pos) AS pos FROM each GROUP BY id, key), m AS (SELECT f.*, category, penalty FROM f JOIN dict USING (key)),
c AS (SELECT *, sum(CASE WHEN category = 'allergen' THEN penalty ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM m),
s AS (SELECT id, sum(CASE WHEN category = 'allergen' THEN greatest(0, least(penalty, 30 - (run - penalty))) ELSE penalty END) AS cost, count(*) AS flagged FROM c GROUP BY id)
SELECT p.id AS product_id, floor(greatest(0.0, least(100.0, 100.0 - coalesce(cost, 0))) + 0.5)::DOUBLE AS score, coalesce(flagged, 0) AS flagged, len(ingredients) AS ingredient_count FROM product p LEFT JOIN s ON s.id = p.id""")
def hazard_scores(spark, d):
    lists = a.products(spark, d, spread=True).select(F.col("id").alias("product_id"), "ingredients")
    return raters.hazard_scores(lists).select("product_id", "score", "flagged", F.col("ingredient_count").cast("long").alias("ingredient_count"))


MAT = _values([(w, i, n, s, r) for i, (n, _, s, r, ws) in enumerate(raters.MATERIALS) for w in ws.split()])


@registered("packaging_scores", f"""WITH {a.PRODUCT}, dict(word, priority, material, score, resin) AS (VALUES {MAT}),
each AS (SELECT id, i AS pos, string_split(trim(regexp_replace(regexp_replace(lower(materials[i]), '^[a-z]{{2}}:', ''), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM (SELECT id, materials, unnest(range(1, len(materials) + 1)) AS i FROM product)),
hit AS (SELECT id, pos, min(priority) AS priority FROM (SELECT id, pos, unnest(ws) AS word FROM each) JOIN dict USING (word) GROUP BY id, pos),
one AS (SELECT DISTINCT h.id, material, score, resin FROM hit h JOIN (SELECT DISTINCT priority, material, score, resin FROM dict) USING (priority)),
named AS (SELECT *, bool_or(resin) OVER (PARTITION BY id) AS any_resin FROM one)
SELECT id AS product_id, floor(avg(score) + 0.5)::DOUBLE AS score, count(*) AS components FROM named WHERE NOT any_resin OR material <> '{raters.GENERIC_PLASTIC}' GROUP BY id""")
def packaging_scores(spark, d):
    lists = _products(spark, d).select(F.col("id").alias("product_id"), "materials")
    return raters.packaging_scores(lists).select("product_id", "score", "components")


ETH = _values([("".join(c for c in n.lower() if c.isalnum()), s, raters.STATUS_SCORE[s]) for _, s, ns in raters.ETHICS for n in ns])


@registered("ethics_scores", f"""WITH {a.PRODUCT}, {a.BRAND}, dict(key, status, score) AS (SELECT DISTINCT * FROM (VALUES {ETH})),
own AS (SELECT id, parent_id, list_prepend(name, aliases) AS names FROM brand), al AS (SELECT o.id, len(o.names) AS n, list_concat(o.names, coalesce(p.names, [])) AS names FROM own o LEFT JOIN own p ON p.id = o.parent_id),
e AS (SELECT id, n, i, {STRIP.format(x='names[i]')} AS key FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM al)),
h AS (SELECT id, arg_min(status, i) AS status, arg_min(score, i) AS score, min(i) > any_value(n) AS via_parent FROM e JOIN dict USING (key) GROUP BY id)
SELECT p.id AS product_id, h.score::DOUBLE AS score, status, via_parent FROM product p JOIN h ON h.id = p.brand_id""")
def ethics_scores(spark, d):
    return raters.ethics_scores(_products(spark, d), a.brands(spark, d)).select("product_id", "score", "status", "via_parent")


# ------------------------------------------------------------------------------------------------ training

PROBS = "pr AS (SELECT l.quality AS label, round(least(1.0, d.n_chars / 5000.0), 3)::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


def _probs(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "n_chars")
    return a.table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 3).alias("p"))


def _metrics(c: str) -> str:
    return f"""total, CASE WHEN total = 0 THEN 0 ELSE round((tp + tn) * 1.0 / total, 9) END AS accuracy, round({c.format('prec')}, 9) AS "precision", round({c.format('rec')}, 9) AS recall,
       round(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END, 9) AS f1, tp, fp, tn, fn"""


SWEEP = f"""WITH {PROBS}, c AS (SELECT p FROM pr UNION SELECT 0.5 UNION SELECT 1.01),
k AS (SELECT c.p AS threshold, count(*) FILTER (pr.p >= c.p AND label = 1) AS tp, count(*) FILTER (pr.p >= c.p AND label <> 1) AS fp, count(*) FILTER (pr.p < c.p AND label <> 1) AS tn, count(*) FILTER (pr.p < c.p AND label = 1) AS fn FROM c, pr GROUP BY c.p),
m AS (SELECT *, tp + fp + tn + fn AS total, CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0 / (tp + fp) END AS prec, CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0 / (tp + fn) END AS rec FROM k)
SELECT threshold, {_metrics('{}')} FROM m"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in ("accuracy", "precision", "recall", "f1") else F.col(c).cast("long").alias(c) if c != "threshold" else F.col(c) for c in df.columns])


@registered("threshold_sweep", SWEEP)
def threshold_sweep(spark, d):
    return _rounded(training.threshold_sweep(_probs(spark, d)))


@registered("best_threshold", f"SELECT * FROM ({SWEEP}) ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_threshold(spark, d):
    return _rounded(training.best_threshold(_probs(spark, d)))


SIZED = f"""{ITEMS}, own AS (SELECT id AS product_id, coalesce(brand_key, '__nobrand:' || id) AS brand_own, gtin14, len(ingredients) AS ni, len(list_filter(string_split({NORM.format(x='name')}, ' '), lambda x: x <> '')) AS nt FROM item),
sized AS (SELECT *, count(*) OVER (PARTITION BY brand_own) AS brand_size FROM own)"""
CUT = "CASE WHEN brand_size >= 90 THEN 'head' WHEN brand_size >= 80 THEN 'mid' WHEN brand_size >= 70 THEN 'small' ELSE 'tail' END"
CUTS = (70, 80, 90)


@registered("brand_sizes", f"WITH {SIZED} SELECT product_id, brand_own, brand_size FROM sized")
def brand_sizes(spark, d):
    return training.brand_sizes(_named(spark, d)).select("product_id", "brand_own", "brand_size")


@registered("profile_by_bucket", f"""WITH {SIZED}, b AS (SELECT unnest(['tail', 'small', 'mid', 'head']) AS bucket),
g AS (SELECT {CUT} AS bucket, count(*) AS products, count(DISTINCT brand_own) AS brands, avg(CASE WHEN gtin14 IS NULL THEN 0.0 ELSE 1.0 END) AS gc, avg(ni) AS mi, avg(nt) AS mt FROM sized GROUP BY 1)
SELECT b.bucket, coalesce(products, 0) AS products, coalesce(brands, 0) AS brands, round(coalesce(gc, 0), 6) AS gtin_coverage, round(coalesce(mi, 0), 6) AS mean_ingredients, round(coalesce(mt, 0), 6) AS mean_name_tokens FROM b LEFT JOIN g USING (bucket)""")
def profile_by_bucket(spark, d):
    out = training.profile_by_bucket(_named(spark, d), CUTS)
    return out.select("bucket", "products", "brands", *[r6(c).alias(c) for c in ("gtin_coverage", "mean_ingredients", "mean_name_tokens")])


@registered("stratified_probes", f"""WITH {SIZED}, r AS (SELECT product_id, row_number() OVER (PARTITION BY {CUT} ORDER BY ('0x' || substr(md5('1|' || product_id), 1, 8))::BIGINT, product_id) AS r FROM sized) SELECT product_id FROM r WHERE r <= 50""")
def stratified_probes(spark, d):
    return training.stratified_probes(_named(spark, d), 50, cutoffs=CUTS).select("product_id")


# ------------------------------------------------------------------------------------------------ pages

PAGE_URL = "CASE WHEN page_id % 3 = 0 THEN 'https://www.amazon.com/some-thing/dp/' || upper(substr(md5(url), 1, 10)) || '?x=1' WHEN page_id % 3 = 1 THEN 'https://www.sephora.com/product/thing-' || page_id ELSE url END"


def _pages(spark, d):
    k, url = F.col("page_id"), F.col("url")
    amazon = F.concat(F.lit("https://www.amazon.com/some-thing/dp/"), F.upper(F.substring(F.md5(url), 1, 10)), F.lit("?x=1"))
    return a.table(spark, d, "pages").withColumn("url", F.when(k % 3 == 0, amazon).when(k % 3 == 1, F.concat(F.lit("https://www.sephora.com/product/thing-"), k.cast("string"))).otherwise(url))


@registered("page_sites", f"""WITH u AS (SELECT page_id, {PAGE_URL} AS url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/]*[.])?amazon[.]com/.*(dp|gp/product)/[A-Za-z0-9]{{10}}') THEN 'amazon' WHEN regexp_matches(url, '^https?://([^/]*[.])?sephora[.]com/product/') THEN 'sephora' END AS site,
       nullif(upper(regexp_extract(url, '/(?:dp|gp/product)/([A-Za-z0-9]{{10}})(?:[/?#]|$)', 1)), '') AS asin FROM u""")
def page_sites(spark, d):
    return _pages(spark, d).select("page_id", shop_pages.site_of(F.col("url")).alias("site"), text.asin_from_url(F.col("url")).alias("asin"))
