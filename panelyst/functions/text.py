"""Text normalisers as columns. NULL means absent and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank in scraped pages and feeds, NBSP and the byte order mark included.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]"

# Words that never start a product name.
STOPWORDS = ["the", "and", "for", "with", "oz", "ounce", "ml", "pack", "size", "free", "new", "daily", "body", "face", "all"]


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def clean(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def present(c: Column) -> Column:
    """Trimmed text, or NULL where nothing is left."""
    return F.nullif(js_trim(c), F.lit(""))


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +", " "))


def strip_norm(c: Column) -> Column:
    """Lower-cased letters and digits alone: the key of brands and ingredients."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


normalize_ingredient = strip_norm


def normalize_gtin(c: Column) -> Column:
    """Digits padded to 14; NULL unless there are 8 to 14 of them."""
    digits = F.regexp_replace(c, "[^0-9]+", "")
    return F.when(F.length(digits).between(8, 14), F.lpad(digits, 14, "0"))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_name(c), " "), lambda t: t != "")


def first_name_token(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.try_element_at(F.filter(name_tokens(c), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)), F.lit(1))


def normalized_set(c: Column) -> Column:
    """Distinct normalised ingredients in order; empty for NULL."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, normalize_ingredient), lambda x: x != "")), F.array().cast("array<string>"))


def parse_quantity(c: Column) -> Column:
    """struct<size_value, size_unit> of the first number that a unit follows; both NULL if there is none."""
    pattern = r"([0-9.]+)\s*([a-zA-Z]+)"
    value = F.regexp_extract(c, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    good = value.isNotNull() & (unit != "")
    return F.struct(F.when(good, value).alias("size_value"), F.when(good, unit).alias("size_unit"))


def primary_brand(c: Column) -> Column:
    return F.coalesce(js_trim(F.split(c, ",")[0]), F.lit(""))


def ingredient_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def split_ingredients(c: Column) -> Column:
    """Parts between commas and bullets, lower-cased, of 2 to 120 characters."""
    parts = F.transform(F.split(c, "[,•·]"), lambda x: F.lower(clean(x)))
    return F.filter(parts, lambda x: F.length(x).between(2, 120))


def sizes_equal(va: Column, ua: Column, vb: Column, ub: Column) -> Column:
    unit = lambda u: F.regexp_replace(F.lower(u), "[.]?$", "")
    return (unit(ua) == unit(ub)) & (F.abs(va - vb) < 0.5)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared members by the smaller set; arguments are distinct arrays."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def extract_category(tags: Column, text: Column) -> Column:
    tag = F.try_element_at(tags, F.lit(-1))
    from_tag = F.trim(F.regexp_replace(F.regexp_replace(tag, "^[a-z]{2}:", ""), "[-_]+", " "))
    last = js_trim(F.try_element_at(F.split(text, ","), F.lit(-1)))
    return F.when(F.nullif(tag, F.lit("")).isNotNull(), from_tag).otherwise(F.coalesce(F.nullif(last, F.lit("")), F.lit("uncategorized")))


def asin_from_url(url: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(url, r"/(?:dp|gp/product)/([A-Za-z0-9]{10})(?:[/?#]|$)", 1), F.lit("")))


def normalize_api_base(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(js_trim(c), "/+$", ""), F.lit("")), F.lit(default))


def hash_32(*keys: Column) -> Column:
    """32 bits made from the keys, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")


def hash_unit(*keys: Column) -> Column:
    """A number in [0, 1) made from the keys: what sampling uses, the same in every run and engine."""
    return hash_32(*keys).cast("double") / F.lit(4294967296.0)


def pick(values: Column, u: Column) -> Column:
    return F.try_element_at(values, (F.floor(u * F.size(values)) + 1).cast("int"))
