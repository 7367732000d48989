"""Shop pages to sightings: URL tests as columns; documents are parsed once by a small Arrow helper, and columns choose."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import asin_from_url, clean, present, split_ingredients

# What tells cosmetics from other things.
CATEGORY_WORDS = ["beauty", "personal care", "skin care", "skincare", "cosmetics", "makeup", "fragrance", "hair care", "haircare", "bath & body"]
NOUN_WORDS = [
    "moisturizer", "cream", "lotion", "serum", "cleanser", "shampoo", "conditioner", "sunscreen", "spf", "lipstick", "lip balm", "mascara", "foundation",
    "concealer", "eyeliner", "blush", "toner", "exfoliant", "deodorant", "antiperspirant", "perfume", "cologne", "eau de toilette", "eau de parfum", "body wash", "face wash",
]
# Where each shop keeps things.
DETAIL_IDS = [
    "productDetails_feature_div", "productDetails_techSpec_section_1", "productDetails_techSpec_section_2", "productDetails_detailBullets_sections1",
    "detailBullets_feature_div", "prodDetails", "productDetailsTable", "technicalSpecifications_feature_div", "important-information",
]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def site_of(url: Column) -> Column:
    """amazon or sephora for product pages of theirs, else NULL."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    a = host.rlike(r"(^|\.)amazon\.com$") & path.rlike(r"(?i)/(?:dp|gp/product)/[A-Z0-9]{10}")
    s = host.rlike(r"(^|\.)sephora\.com$") & path.rlike(r"(?i)^/product/")
    return F.when(a, "amazon").when(s, "sephora")


class _Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def nodes(self):
        for k in self.kids:
            if isinstance(k, _Node):
                yield k
                yield from k.nodes()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def elements(self):
        return [k for k in self.kids if isinstance(k, _Node)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def _squeezed(s: str) -> str:
    return " ".join(s.split())


def _rows(node) -> list[list[str]]:
    """[label, value] of table rows with at least two cells, labels lower-cased."""
    out = []
    for tr in (n for n in node.nodes() if n.tag == "tr"):
        cells = [c.text().strip() for c in tr.nodes() if c.tag in ("th", "td")]
        if len(cells) >= 2:
            out.append([cells[0].lower(), cells[1]])
    return out


def _candidates(root, site: str) -> dict:
    """Texts at the places where a shop keeps things, in order of preference; columns choose among them."""
    every = list(root.nodes())
    by_id, by_at = {}, {}
    for n in every:
        by_id.setdefault(n.attrs.get("id"), n)
        by_at.setdefault(n.attrs.get("data-at"), []).append(n)
    texts = lambda ns: [n.text().strip() for n in ns if n is not None and n.text().strip()]
    links = lambda n: texts(a for a in n.nodes() if a.tag == "a") if n is not None else []
    labelled = lambda n: n.attrs.get("aria-label", "")
    heads = [n for n in every if n.tag in ("h2", "h3", "h4", "h5", "b", "strong") or site == "sephora" and (n.tag == "h1" or n.attrs.get("data-at") == "ingredients")]
    heads = [h for h in heads if h.text().strip().lower().startswith("ingredients") and not h.text().strip()[11:12].isalnum()]
    out: dict = {"names": [], "brands": [], "crumbs": [], "ingredients": [], "gtins": [], "image": None, "prices": []}
    if site == "amazon":
        out["names"] = texts([by_id.get("productTitle"), by_id.get("title")])
        stores = [a for a in every if a.tag == "a" and "/stores/" in a.attrs.get("href", "") and 3 <= len(a.text().strip()) <= 80]
        out["brands"] = texts([by_id.get("bylineInfo"), by_id.get("visitStoreLink"), *stores])
        out["row_brands"] = [v for k, v in _rows(root) if k == "brand" and v]
        nav = next((n for n in every if n.tag == "nav" and labelled(n) == "Breadcrumb"), None)
        out["crumbs"] = next((c for c in map(links, (by_id.get("wayfinding-breadcrumbs_feature_div"), by_id.get("nav-subnav"), nav)) if c), [])
        for h in heads:
            around = h.up.elements()
            after = around[around.index(h) + 1 :][:1]
            for n in after:
                lis = [x for x in n.nodes() if x.tag == "li"] if n.tag in ("ul", "ol") else [n]
                out["ingredients"].append(" • ".join(_squeezed(x.text()) for x in lis))
            out["ingredients"].append(_squeezed(h.up.text().replace(h.text(), "", 1)))
        out["ingredients"] += [v for k, v in _rows(root) if k == "ingredients"]
        for box in (by_id.get(i) for i in DETAIL_IDS):
            if box is not None:
                out["gtins"] += ["".join(v.split()) for k, v in _rows(box) if any(k == x or k.startswith(x + " ") for x in ("upc", "ean", "gtin", "isbn"))]
                out["gtins"] += [f" {n.text()} " for n in box.nodes() if n.tag == "li" and any(x in n.text().lower() for x in ("upc", "ean", "gtin", "isbn"))]
        out["image"] = next((by_id[i].attrs["src"] for i in ("landingImage", "imgBlkFront") if i in by_id and by_id[i].attrs.get("src", "").strip()), None)
        out["prices"] = texts(n for n in every if "a-offscreen" in n.attrs.get("class", "").split() and n.up is not None) + texts([by_id.get("priceblock_ourprice")])
    else:
        at = lambda k: by_at.get(k, [])
        out["names"] = texts([*at("product_name")[:1], *[n for n in every if n.tag == "h1"][:1]])
        out["brands"] = texts([*[n for n in at("brand_name") if n.tag == "a"][:1], *at("brand_name")[:1]])
        keep = lambda xs: list(dict.fromkeys(x for x in xs if x.lower() not in ("home", "sephora")))
        navs = [n for n in every if n.tag == "nav" and "readcrumb" in labelled(n).lower()]
        lists = [n for n in every if n.tag == "ol" and "BreadcrumbList" in n.attrs.get("itemtype", "")]
        plain = [n for v in every if v.tag == "nav" for n in v.nodes() if n.tag == "ol"]
        out["crumbs"] = next((c for c in (keep(texts(at("pdp_bread_crumb"))), *(keep(x for n in g for x in links(n)) for g in (navs, lists, plain))) if c), [])
        scope = heads[0] if heads else None
        for _ in range(5):
            if scope is None:
                break
            leaves = [n for n in scope.nodes() if not n.elements() and n is not heads[0] and n.text().count(",") > 3]
            if leaves:
                out["ingredients"].append(_squeezed(max(leaves, key=lambda n: n.text().count(",")).text()))
            scope = scope.up
        out["image"] = next((n.attrs.get("content") for n in every if n.tag == "meta" and n.attrs.get("property") == "og:image"), None)
        out["prices"] = texts([*at("product_list_price")[:1], *at("price")[:1]])
    out["ld"] = [n.text() for n in every if n.tag == "script" and n.attrs.get("type") == "application/ld+json"]
    return out


CANDIDATES = (
    "names array<string>, brands array<string>, row_brands array<string>, crumbs array<string>, ingredients array<string>, gtins array<string>, "
    "image string, prices array<string>, ld array<string>"
)


def candidates(html: Column, site: Column) -> Column:
    @F.pandas_udf("string")
    def apply(pages: pd.Series, sites: pd.Series) -> pd.Series:
        def one(page, site):
            if not site or not isinstance(page, str):
                return None
            tree = _Tree()
            tree.feed(page)
            return json.dumps(_candidates(tree.root, site))

        return pd.Series([one(p, s) for p, s in zip(pages, sites, strict=True)], dtype="object")

    # taken for non-deterministic, so that filters on it stay above and no page is parsed twice
    return F.from_json(apply.asNondeterministic()(html, site), CANDIDATES)


def ld_nodes(scripts: Column) -> Column:
    """JSON texts of the product nodes in ld+json scripts, arrays and graphs two levels deep; broken scripts have none."""
    arr = "array<string>"

    def level(one: Column) -> Column:
        as_list = F.from_json(one, arr)
        graph = F.from_json(F.get_json_object(one, "$.@graph"), arr)
        return F.when(F.ltrim(one).startswith("["), as_list).when(graph.isNotNull(), graph).otherwise(F.array(one))

    twice = F.flatten(F.transform(F.flatten(F.transform(scripts, lambda s: F.coalesce(level(s), F.array().cast(arr)))), lambda s: F.coalesce(level(s), F.array().cast(arr))))
    kind = lambda n: F.get_json_object(n, "$.@type")
    is_product = lambda n: F.coalesce((kind(n) == "Product") | F.array_contains(F.from_json(kind(n), arr), "Product"), F.lit(False))
    return F.filter(twice, is_product)


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def sightings(pages: DataFrame) -> DataFrame:
    """(page_id, source, url, asin, raw_name, raw_brand, raw_gtin, raw_ingredients, category, price_text, image_url) of product
    pages with a title; other pages give no row."""
    known = pages.withColumn("source", site_of(F.col("url"))).where("source IS NOT NULL")
    c = known.withColumn("c", candidates(F.col("html"), F.col("source")))
    stripped = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?i)^(?:visit the |brand:\s*|by\s+)", ""), r"(?i)\s+store$", ""))
    ld = ld_nodes(F.col("c.ld"))
    ld_brand = _first(F.transform(ld, lambda n: F.coalesce(F.get_json_object(n, "$.brand.name"), F.when(~F.get_json_object(n, "$.brand").startswith("{"), F.get_json_object(n, "$.brand")))))
    code = lambda n: F.regexp_extract(F.coalesce(*[F.get_json_object(n, f"$.{k}") for k in ("gtin13", "gtin12", "gtin14", "gtin", "sku")]), r"(?<![0-9A-Za-z_])\d{8,14}(?![0-9A-Za-z_])", 0)
    amazon = F.col("source") == "amazon"
    brand = F.when(amazon, F.coalesce(_first(F.transform("c.brands", stripped)), _first(F.col("c.row_brands")))).otherwise(F.coalesce(_first(F.col("c.brands")), ld_brand))
    gtin = F.when(amazon, _first(F.transform("c.gtins", lambda g: F.regexp_extract(g, r"\d{8,14}", 0)))).otherwise(_first(F.transform(ld, code)))
    lists = F.transform("c.ingredients", split_ingredients)
    least = F.when(amazon, 0).otherwise(2)
    good = F.try_element_at(F.filter(lists, lambda x: F.size(x) > least), F.lit(1))
    return c.where(F.size("c.names") > 0).select(
        "page_id", "source", "url", asin_from_url(F.col("url")).alias("asin"), clean(F.col("c.names")[0]).alias("raw_name"), clean(brand).alias("raw_brand"), gtin.alias("raw_gtin"),
        F.coalesce(good, F.array().cast("array<string>")).alias("raw_ingredients"), F.when(F.size("c.crumbs") > 0, F.col("c.crumbs")).alias("category"),
        _first(F.col("c.prices")).alias("price_text"), present(F.col("c.image")).alias("image_url"),
    )


def classify_cosmetic(name: Column, category: Column) -> Column:
    """struct<cosmetic, reason>: a category and a noun, or two categories; a noun alone doesn't do."""
    words = F.array(*[F.lit(w) for w in CATEGORY_WORDS])
    hits = F.filter(F.transform(F.coalesce(category, F.array().cast("array<string>")), F.lower), lambda c: F.exists(words, lambda w: F.contains(c, w)))
    noun = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in NOUN_WORDS]), lambda w: F.contains(F.lower(name), w)), F.lit(1))
    both = (F.size(hits) > 0) & noun.isNotNull()
    reason = (
        F.when(both, F.concat(F.lit("category["), F.try_element_at(hits, F.lit(1)), F.lit("] + noun["), noun, F.lit("]")))
        .when(F.size(hits) >= 2, F.concat(F.lit("category["), F.array_join(F.slice(hits, 1, 2), " > "), F.lit("]")))
        .when(noun.isNotNull(), F.concat(F.lit("noun-only["), noun, F.lit("]")))
        .otherwise(F.lit("no signals"))
    )
    return F.struct((both | (F.size(hits) >= 2)).alias("cosmetic"), reason.alias("reason"))


def sighting_items(seen: DataFrame) -> DataFrame:
    """Sightings as items to resolve; an empty ingredient list is absent."""
    return seen.select(
        F.col("page_id").cast("string").alias("id"), F.col("raw_brand").alias("brand"), F.col("raw_name").alias("name"), F.col("raw_gtin").alias("gtin"),
        F.when(F.size("raw_ingredients") > 0, F.col("raw_ingredients")).alias("ingredients"), F.lit(None).cast("double").alias("size_value"), F.lit(None).cast("string").alias("size_unit"),
        F.col("page_id").alias("ord"), "asin",
    )
