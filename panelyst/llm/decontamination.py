"""Benchmark decontamination by the q-gram lemma.

Documents and benchmark items are compared as lower-cased letters and digits alone. An alignment of a window of an item with
at most so many edits keeps at least length - q + 1 - q * edits of its q-grams, all on diagonals that differ by the edits at
most. So shared q-grams are counted in overlapping bands of diagonals; windows of a band with enough of them are aligned
within the band. Documents are scanned once for each block of the benchmark, of
which one at a time is held and sent, and nothing is shuffled before the matches.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import new_path

#: Characters (bytes) of a q-gram; eight make one 64-bit number.
Q = 8
#: Bytes of a window of an item, distance between windows, and edits allowed for each byte.
WINDOW = 64
STRIDE = 16
RATE = 0.08
#: Items of fewer letters and digits are too common within texts; they match documents that hold nothing else.
LEAST = 24
#: Bytes of items that are sent to the executors at a time; an index takes about 30 bytes for each.
BLOCK_BYTES = 4 << 20
#: Shared q-grams that are laid out at a time.
HITS = 1 << 20
#: Matches that a task hands on at a time.
ROWS = 1 << 16

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True
_TABLE_BITS = 21
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def normalise(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and digits, their offsets by document, the place of each in ``values``)."""
    keep = _KEEP[values]
    upto = np.concatenate([[0], np.cumsum(keep)])
    return textscan._LOWER[values[keep]], upto[offsets], np.flatnonzero(keep)


def grams(values: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    if len(values) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(values) - Q + 1,), "<u8", np.ascontiguousarray(values), strides=(1,)).copy()


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _MULTIPLY) >> np.uint64(64 - _TABLE_BITS)


class Index:
    """q-grams of a block of items, and their windows."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, stride: int = STRIDE, rate: float = RATE):
        self.ids, self.texts, self.windows, codes, where, place = [], [], [], [], [], []
        self.short: dict[bytes, list[int]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            norm, _, _ = normalise(raw, np.array([0, len(raw)]))
            if len(norm) < LEAST:
                if len(norm):
                    self.short.setdefault(norm.tobytes(), []).append(item)
                continue
            length = min(window, len(norm))
            starts = sorted({*range(0, len(norm) - length + 1, stride), len(norm) - length})
            g = grams(norm)
            codes.append(g)
            where.append(np.full(len(g), len(self.ids), np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
            self.ids.append(item)
            self.texts.append(norm)
            self.windows.append((length, np.array(starts)))
        self.edits = [int(rate * length) for length, _ in self.windows]
        self.least = np.array([length - Q + 1 - Q * k for (length, _), k in zip(self.windows, self.edits, strict=True)], np.int64)
        self.band = (max(self.edits) if self.edits else 0) + 1
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        # items end to end: where each begins, and the place of every q-gram, ascending for each code
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)])
        self.reach = max((length for length, _ in self.windows), default=0) + 2 * self.band
        self.item = np.concatenate(where)[order] if codes else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order] if codes else np.empty(0, np.int32)
        self.codes, first, many = np.unique(code[order], return_index=True, return_counts=True)
        self.key: np.ndarray | None = None
        self.first, self.many = first.astype(np.int32), many.astype(np.int32)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.codes)] = True

    def _shared(self, norm: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in norm, number of the code, document) of every q-gram of the documents that an item has.

        Of places with one code within ``band`` places from a multiple of it, the first and the last are enough: whichever
        diagonals a band has, it meets an item's place at one of them if at any.
        """
        g = grams(norm)
        at = np.flatnonzero(self.table[_slot(g)])
        if not len(at) or not len(self.codes):
            return (np.empty(0, np.int64),) * 3
        i = np.minimum(np.searchsorted(self.codes, g[at]), len(self.codes) - 1)
        same = self.codes[i] == g[at]
        at, i = at[same], i[same]
        doc = np.searchsorted(docs, at, side="right") - 1
        inside = at + Q <= docs[doc + 1]
        at, i, doc = at[inside], i[inside], doc[inside]
        order = np.lexsort((at, i))
        code, block, of = i[order], at[order] // self.band, doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (of[1:] != of[:-1])
        ends = np.append(new[1:], True) if len(order) else new
        stay = np.zeros(len(order), bool)
        stay[order[new | ends]] = True
        return at[stay], i[stay], doc[stay]

    def hits(self, norm: np.ndarray, docs: np.ndarray, wanted: np.ndarray | None = None):
        """((document, place in it, item, place in that) of shared q-grams, the part that is owned), HITS at a time or so.

        Documents come whole, some at a time. One with more hits comes in cells of its places and the items' places: each
        cell owns ranges of both, and has all hits of whatever begins there; the part is None where all is owned.
        """
        at, i, doc = self._shared(norm, docs)
        if wanted is not None:
            among = np.isin(doc, wanted)
            at, i, doc = at[among], i[among], doc[among]
        upto = np.concatenate([[0], np.cumsum(self.many[i], dtype=np.int64)])
        a = 0
        while a < len(at):
            b = min(int(np.searchsorted(upto, upto[a] + HITS)), len(at))
            b = int(np.searchsorted(doc, doc[b])) if b < len(at) else b
            if b > a:
                yield self._laid_out(at[a:b] - docs[doc[a:b]], doc[a:b], self.first[i[a:b]], self.many[i[a:b]]), None
            else:
                b = int(np.searchsorted(doc, doc[a], side="right"))
                yield from self._cells(at[a:b] - docs[doc[a]], i[a:b], int(doc[a]))
            a = b

    def _laid_out(self, place: np.ndarray, doc: np.ndarray, first: np.ndarray, many: np.ndarray):
        which = np.arange(int(many.sum())) - np.repeat(np.cumsum(many, dtype=np.int64) - many, many) + np.repeat(first, many)
        return np.repeat(doc, many), np.repeat(place, many), self.item[which].astype(np.int64), self.place[which].astype(np.int64)

    def _cells(self, place: np.ndarray, code: np.ndarray, doc: int):
        """Cells of one document: ranges of its places and of the items', halved until their hits are few."""
        far = 1 << 40
        todo = [(-far, far, -far, far)]
        size = int(self.begin[-1])
        if self.key is None:  # postings of a code ascend by the items' places, so one key orders all
            self.key = np.repeat(np.arange(len(self.codes), dtype=np.int64), self.many) * (size + 1) + self.begin[self.item] + self.place
        key = self.key
        while todo:
            low, high, below, above = todo.pop()
            a, b = np.searchsorted(place, [low, high + self.reach])
            own = code[a:b].astype(np.int64) * (size + 1)
            first = np.searchsorted(key, own + max(0, below))
            many = np.maximum(np.searchsorted(key, own + min(size, above + self.reach)) - first, 0)
            if not len(many) or not many.any():
                continue
            some = many > 0
            text_low, text_high = max(low, int(place[a:b][some][0]) - 2 * self.reach), min(high, int(place[a:b][some][-1]) + 1)
            item_low, item_high = max(below, -2 * self.reach), min(above, size)
            wide, deep = text_high - text_low, item_high - item_low
            if many.sum() <= HITS or max(wide, deep) <= 4 * self.reach:
                yield self._laid_out(place[a:b][some], np.full(int(some.sum()), doc), first[some], many[some]), (low, high, below, above)
            elif wide >= deep:
                middle = (text_low + text_high) // 2
                todo += [(low, middle, below, above), (middle, high, below, above)]
            else:
                middle = (item_low + item_high) // 2
                todo += [(low, high, below, middle), (low, high, middle, above)]

    def regions(self, norm: np.ndarray, docs: np.ndarray, strided: bool, wanted: dict[int, set[int]] | None = None):
        """(document, item, window starts, first diagonal of the band, of more) of windows with enough shared q-grams in a band:
        those at the stride, or else the others; ``more`` tells whether there are others. ``wanted``: items by document."""
        among = None if wanted is None else np.array(sorted(wanted), np.int64)
        for hits, part in self.hits(norm, docs, among):
            yield from self._banded(*hits, part, strided, wanted)

    def _banded(self, doc: np.ndarray, place: np.ndarray, item: np.ndarray, inner: np.ndarray, part, strided: bool, wanted):
        diagonal = place - inner + (1 << 40)
        band = diagonal // self.band
        doc, item, inner = (np.concatenate([x, x]) for x in (doc, item, inner))
        band = np.concatenate([band, band - 1])
        order = np.lexsort((inner, band, item, doc))
        doc, item, inner, band = doc[order], item[order], inner[order], band[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(doc))
        enough = np.flatnonzero(ends - starts >= self.least[item[starts]])
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            d, i, first = int(doc[a]), int(item[a]), int(band[a]) * self.band - (1 << 40)
            if wanted is not None and i not in wanted[d]:
                continue
            length, at_stride = self.windows[i]
            own = np.unique(inner[a:b])
            low, high = max(0, int(own[0]) - length + Q), min(int(own[-1]), len(self.texts[i]) - length)
            if part is not None:  # windows whose first place in the text and in the items lies in the part
                low = max(low, part[0] - first, part[2] - int(self.begin[i]))
                high = min(high, part[1] - first - 1, part[3] - int(self.begin[i]) - 1)
            if low > high:
                continue
            windows = np.arange(low, high + 1)
            count = np.searchsorted(own, windows + length - Q, side="right") - np.searchsorted(own, windows)
            windows = windows[count >= self.least[i]]
            at = np.isin(windows, at_stride)
            chosen = windows[at if strided else ~at]
            if len(windows):
                yield d, i, chosen.tolist(), first, not at.all()


def banded_edits(patterns: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each pattern and any stretch of its text on the band's diagonals, and the diagonal it ends on.

    patterns: (n, length); texts: (n, length + width - 1), of which row i of the pattern meets places i to i + width - 1.
    Byte 0 stands for no text.
    """
    n, length = patterns.shape
    width = texts.shape[1] - length + 1
    steps = np.arange(width, dtype=np.int32)
    d = np.zeros((n, width), np.int32)
    far = np.full((n, 1), 1 << 20, np.int32)
    for i in range(length):
        new = d + (texts[:, i : i + width] != patterns[:, i : i + 1])
        new = np.minimum(new, np.concatenate([d[:, 1:], far], axis=1) + 1)
        d = np.minimum.accumulate(new - steps, axis=1) + steps
    best = d.argmin(axis=1)
    return d[np.arange(n), best], best


def matches(index: Index, values: np.ndarray, offsets: np.ndarray):
    """(document, item, first byte, last byte + 1, edits) of every verified window in a slice of documents.

    Windows at the stride are aligned first; a document and item without a verified one have all their other windows with
    enough shared q-grams aligned, so whether they match doesn't depend on where an excerpt begins.
    """
    norm, docs, raw = normalise(values, offsets)
    sizes = np.diff(docs)
    for doc in np.flatnonzero((sizes > 0) & (sizes < LEAST)).tolist() if index.short else ():
        for item in index.short.get(norm[docs[doc] : docs[doc + 1]].tobytes(), ()):
            yield doc, item, int(raw[docs[doc]] - offsets[doc]), int(raw[docs[doc + 1] - 1] + 1 - offsets[doc]), 0
    seen: set[tuple[int, int]] = set()
    more: set[tuple[int, int]] = set()
    for match in _aligned(index, norm, docs, raw, offsets, _windows(index.regions(norm, docs, True), more)):
        seen.add(match[:2])
        yield match[0], index.ids[match[1]], *match[2:]
    rest: dict[int, set[int]] = {}
    for doc, item in more - seen:
        rest.setdefault(doc, set()).add(item)
    if rest:
        for doc, item, *place in _aligned(index, norm, docs, raw, offsets, _windows(index.regions(norm, docs, False, rest), set())):
            yield doc, index.ids[item], *place


def _windows(regions, more: set):
    """(document, item, window start, first diagonal) one by one; puts pairs that have other windows too into ``more``."""
    for doc, item, starts, diagonal, others in regions:
        if others:
            more.add((doc, item))
        for s in starts:
            yield doc, item, s, diagonal


def _aligned(index: Index, norm: np.ndarray, docs: np.ndarray, raw: np.ndarray, offsets: np.ndarray, windows):
    """(document, place of the item, first byte, last byte + 1, edits) of windows whose alignment in their band is near enough;
    windows are taken as they come, some thousands at a time."""
    held: dict[tuple[int, int], list] = {}
    for row in windows:
        kind = (index.windows[row[1]][0], index.edits[row[1]])
        rows = held.setdefault(kind, [])
        rows.append(row)
        if len(rows) >= 4096:
            yield from _aligned_part(index, norm, docs, raw, offsets, *kind, held.pop(kind))
    for kind, rows in held.items():
        yield from _aligned_part(index, norm, docs, raw, offsets, *kind, rows)


def _aligned_part(index: Index, norm: np.ndarray, docs: np.ndarray, raw: np.ndarray, offsets: np.ndarray, length: int, edits: int, part: list):
    width = 2 * index.band + 2 * edits
    patterns = np.stack([index.texts[item][s : s + length] for _, item, s, _ in part])
    base = np.array([docs[doc] + diagonal + s - edits for doc, _, s, diagonal in part])
    low = np.array([docs[doc] for doc, *_ in part])
    high = np.array([docs[doc + 1] for doc, *_ in part])
    at = base[:, None] + np.arange(length + width - 1)
    inside = (at >= low[:, None]) & (at < high[:, None])
    texts = np.where(inside, norm[np.clip(at, 0, len(norm) - 1)], 0)
    cost, end = banded_edits(patterns, texts)
    for j in np.flatnonzero(cost <= edits).tolist():
        doc, item, *_ = part[j]
        last = min(int(base[j] + end[j] + length), int(high[j])) - 1
        first = max(int(low[j]), last - length + 1)
        yield doc, item, int(raw[first] - offsets[doc]), int(raw[last] + 1 - offsets[doc]), int(cost[j])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches: doc_id, item_id, windows (of the item that were found), edits (fewest), first_byte, end_byte (their extent).

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Any ``window`` letters and digits in a row of an
    item, or the whole of a shorter item, match with at most ``rate`` edits a byte; items of fewer than LEAST match documents
    that hold nothing else. windows counts those ``stride`` apart, or, where none of these matches, all. Null and empty texts
    match nothing. Rows with equal doc_id make one row of the result with an item. The benchmark goes to the executors in blocks of about ``block_bytes``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = new_path(spark, "matches")
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        # about block_bytes of items; written before the next one is collected
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in own.collect()], window, stride, rate))
        found = docs.select("doc_id", "text").mapInArrow(textscan.tidy(_scan(shared)), f"doc_id {kind}, item_id long, edits long, first_byte long, end_byte long")
        _summed(found, F.count("*")).write.mode("append").parquet(path)
        shared.destroy()
    # an item is in one block, so its rows are whole
    return spark.read.schema(f"doc_id {kind}, item_id long, windows long, edits long, first_byte long, end_byte long").parquet(path)


def _summed(found: DataFrame, windows: Column) -> DataFrame:
    return found.groupBy("doc_id", "item_id").agg(windows.alias("windows"), F.min("edits").alias("edits"), F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte"))


def _scan(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for cut in textscan.slices(batch, limit=2 << 20):
                found = matches(index, *textscan.text_buffer(cut.column(1)))
                while rows := list(islice(found, ROWS)):
                    doc, item, first, end, edits = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [cut.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), *[pa.array(x, pa.int64()) for x in (edits, first, end)]],
                        ["doc_id", "item_id", "edits", "first_byte", "end_byte"],
                    )

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a match; those with a null doc_id stay only if no document with one matches."""
    leaks = contamination(docs, benchmark, **options).select("doc_id").distinct().alias("leaks")
    return docs.alias("docs").join(leaks, F.expr("docs.doc_id <=> leaks.doc_id"), "left_anti")
