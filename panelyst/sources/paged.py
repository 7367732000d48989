"""A Python data source for paged product feeds, for batches and streams: one input partition a page, so pages are pulled in parallel.

The HTTP call is a parameter (option ``opener``, the dotted name of a function of a URL that returns text); queries read
landed files instead and need no network.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE_MOST = 100


def page_url(base: str, page: int, size: int, term: str = "", filters: str = "") -> str:
    query = {"page": page, "page_size": min(size, PAGE_MOST), "json": 1}
    if term:
        query["search_terms"] = term
    for f in filter(None, filters.split(",")):
        key, _, value = f.partition("=")
        query[key] = value
    return f"{base}?{urlencode(query)}"


class Pages:
    """Pulls pages; a pull that fails, or whose answer isn't the JSON of a page, is tried again, each time after twice the pause."""

    def __init__(self, options):
        self.o = dict(options)
        self.size = min(int(self.o.get("page_size", PAGE_MOST)), PAGE_MOST)
        self.first = int(self.o.get("page_start", 1))

    def pull(self, page: int) -> dict:
        module, _, name = self.o["opener"].rpartition(".")
        opener = getattr(importlib.import_module(module), name)
        url = page_url(self.o["base"], page, self.size, self.o.get("term", ""), self.o.get("filters", ""))
        attempts, pause = int(self.o.get("attempts", 4)), float(self.o.get("pause_s", 1))
        for attempt in range(1, attempts + 1):
            try:
                got = json.loads(opener(url))
                if not isinstance(got, dict) or not isinstance(got.get("products", []), list):
                    raise ValueError(f"no page: {url}")
                return got
            except (OSError, ValueError):
                if attempt == attempts:
                    raise
                time.sleep(pause * 2 ** (attempt - 1))
        raise ValueError("attempts has to be 1 or more")


@dataclass
class Page(InputPartition):
    """Products ``low`` to ``high`` - 1 of a page; ``high`` None: to its end. ``products``: those of a page that is at hand already."""

    number: int
    low: int = 0
    high: int | None = None
    products: list | None = None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.pages = Pages(options)

    def partitions(self):
        p = self.pages
        first = p.pull(p.first)
        size = int(first.get("page_size") or p.size)
        last = int(first.get("page_count") or max(1, math.ceil(int(first.get("count", 0)) / max(1, size))))
        if "pages" in p.o:
            last = min(last, p.first + int(p.o["pages"]) - 1)
        # the first page tells how many there are, and is not pulled again
        return [Page(p.first, products=first.get("products", [])), *[Page(n) for n in range(p.first + 1, last + 1)]]

    def read(self, partition: Page):
        products = partition.products
        if products is None:
            time.sleep(float(self.pages.o.get("spacing_s", 0)))
            products = self.pages.pull(partition.number).get("products", [])
        for product in products:
            yield (partition.number, json.dumps(product))


class _StreamReader(DataSourceStreamReader):
    """Offsets count products, so that a page that was half full when it was read goes on where it stopped. The feed puts new
    products at its end and keeps the order of old ones."""

    def __init__(self, options):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        p = self.pages
        return {"at": max(0, int(p.pull(p.first).get("count", 0)) - (p.first - 1) * p.size)}

    def partitions(self, start: dict, end: dict):
        at, upto, size = int(start["at"]), int(end["at"]), self.pages.size
        return [
            Page(self.pages.first + n, max(at - n * size, 0), min(upto - n * size, size))
            for n in range(at // size, -(-upto // size))
            if at < upto
        ]

    def read(self, partition: Page):
        time.sleep(float(self.pages.o.get("spacing_s", 0)))
        products = self.pages.pull(partition.number).get("products", [])
        if len(products) < partition.high:
            raise ValueError(f"page {partition.number} has {len(products)} products of the {partition.high} that were announced")
        for product in products[partition.low : partition.high]:
            yield (partition.number, json.dumps(product))

    def commit(self, end: dict) -> None:
        """Offsets are the checkpoint's; the feed keeps none."""


class PagedFeed(DataSource):
    """format("paged_feed"): page int, raw string. Options: base, opener, term, filters, page_size, page_start, pages, spacing_s,
    attempts, pause_s.

    A batch takes all pages that the first one announces, or ``pages`` of them. A stream takes in each micro-batch what has
    been added since; what its checkpoint has is neither lost nor taken twice, whenever it stops.
    """

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return "page int, raw string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
