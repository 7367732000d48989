"""Token-ID output in patched frame-of-reference blocks.

Texts are encoded by a given tokenizer file, and the ids of each document, with an end id after them, are written in
ascending doc_id order as segments: rows of a Parquet table, so that Spark's commit protocol covers them. A segment's
payload is the binary file format described at encode_segment.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import new_path

BLOCK = 128
#: Code points whose pieces are looked up at a time; one longer text makes a longer group.
GROUP = 1 << 20
#: Share of a block's values that its bit width must hold; the others become exceptions.
PERCENTILE = 0.9
#: Ids after which a segment is closed; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 19
MAGIC = b"PFB1"
_HEAD = struct.Struct("<4sIQII")

# ---------------------------------------------------------------------------------------------- file format


def _bit_width(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.frexp(v.astype(np.float64))[1], 0).astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Lowest ``width`` bits of every value, big-endian, rows apart: (n, BLOCK) to (n, BLOCK * width / 8) bytes."""
    if width <= 16:
        bits = np.unpackbits(rows.astype(">u2").view(np.uint8).reshape(len(rows), -1), axis=1).reshape(len(rows), BLOCK, 16)
        return np.packbits(bits[:, :, 16 - width :].reshape(len(rows), -1), axis=1)
    bits = np.unpackbits(rows.astype(">u4").view(np.uint8).reshape(len(rows), -1), axis=1).reshape(len(rows), BLOCK, 32)
    return np.packbits(bits[:, :, 32 - width :].reshape(len(rows), -1), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    whole, kind = (16, ">u2") if width <= 16 else (32, ">u4")
    bits = np.zeros((len(packed), BLOCK, whole), np.uint8)
    bits[:, :, whole - width :] = np.unpackbits(packed, axis=1).reshape(len(packed), BLOCK, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1).view(kind).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Block headers, block start index, packed values and exception lists of unsigned 32-bit values.

    Layout: number of values u64, of blocks u32, of exceptions u32; per block minimum u32, width u8, exception count u8,
    start of its packed bytes u64; exceptions as positions u8 and values above the minimum u32; packed bytes.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.empty(0, np.uint32)
    over = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    width = _bit_width(np.partition(over, at, axis=1)[:, at]) if blocks else np.empty(0, np.uint8)
    out = over >> width[:, None].astype(np.uint32) > 0
    count = out.sum(axis=1).astype(np.uint8)
    where = np.nonzero(out)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
    packed = np.empty(int(start[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            packed[start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)] = _pack(over[rows], w)
    return b"".join(
        (
            struct.pack("<QII", n, blocks, len(where[0])),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            count.tobytes(),
            start[:-1].astype("<u8").tobytes(),
            where[1].astype(np.uint8).tobytes(),
            over[where].astype("<u4").tobytes(),
            packed.tobytes(),
        )
    )


def decode_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values, or those of blocks first to last - 1 alone, found by the index."""
    n, blocks, n_out = struct.unpack_from("<QII", data)
    at = 16
    parts = []
    for kind, many in (("<u4", blocks), ("u1", blocks), ("u1", blocks), ("<u8", blocks), ("u1", n_out), ("<u4", n_out)):
        parts.append(np.frombuffer(data, kind, many, at))
        at += many * np.dtype(kind).itemsize
    low, width, count, start, pos, value = parts
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    packed = np.frombuffer(data, np.uint8, offset=at)
    over = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        if w:
            rows = np.flatnonzero(width[first:last] == w)
            over[rows] = _unpack(packed[start[first:last][rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)], w)
    before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    own = slice(before[first], before[last])
    over[np.repeat(np.arange(last - first), count[first:last]), pos[own]] = value[own]
    return (over + low[first:last, None]).reshape(-1)[: max(0, n - first * BLOCK)]


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: magic, number of documents u32, of ids u64, sizes of the two parts u32, u32 (in KiB units unused);
    then doc_ids i64, their null flags, document lengths and ids, the last two in blocks."""
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    lens = encode_blocks(np.asarray(lengths, np.uint32))
    return _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(lens), 0) + keys.tobytes() + nulls.tobytes() + lens + encode_blocks(ids)


def decode_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    magic, docs, _, size, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    at += 9 * docs
    doc_ids = [None if x else k for k, x in zip(keys, nulls.tolist(), strict=True)]
    return doc_ids, decode_blocks(data[at : at + size]), decode_blocks(data[at + size :])


# ---------------------------------------------------------------------------------------------- encoding

#: Code points up to here have one class in every Unicode version; texts with others go to the library whole.
_KNOWN = 0x250
_PUNCTUATION = (0x2010, 0x2027)
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import unicodedata

    out = np.zeros(_PUNCTUATION[1] + 1, np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _BLANK
    return out


_CODE = np.random.default_rng(77).integers(1, 1 << 63, _PUNCTUATION[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_APOSTROPHE = 0x27


def piece_starts(cps: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the pieces begin that byte-level tokenizers encode one by one: contractions, letters, numbers, other, blanks.

    One blank U+0020 joins what follows it; other runs of blanks before something else leave their last one by itself.
    """
    n = len(cps)
    kind = _classes()[cps]
    begin = np.empty(n + 1, bool)
    begin[0] = True
    begin[n] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:n])
    new_doc = np.zeros(n + 1, bool)
    new_doc[docs] = True
    begin |= new_doc
    blank = kind == _BLANK
    # blanks with something else after them in the same document
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~new_doc[1:n])
    begin[last] = True
    begin[last[cps[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cps[: n - 1] == _APOSTROPHE) & begin[: n - 1] & begin[1:n] & ~new_doc[1:n])
    if len(quote):
        ahead = np.concatenate([cps, [0, 0]])
        inside = np.concatenate([new_doc, [True, True]])
        c1, c2 = ahead[quote + 1], np.where(inside[quote + 2], 0, ahead[quote + 2])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for which, length in ((one, 2), (two, 3)):
            begin[quote[which] + 1] = False
            begin[quote[which] + length] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """Encodes lists of texts with a tokenizer file; equal pieces are encoded once and kept by hash.

    The kept table stays under ``keep`` pieces; it is emptied beyond that, which changes no result.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # what piece_starts() cuts; with any other file whole texts are encoded
        before = said.get("pre_tokenizer") or {}
        self.by_pieces = (
            said.get("normalizer") is None
            and said.get("truncation") is None
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and all(t["content"].startswith("<|") for t in said.get("added_tokens") or [])
        )
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.starts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.lengths, self.flat = np.empty(0, np.int32), np.empty(0, np.uint16)
        self.sizes, self.sums = np.empty(0, np.int32), np.empty(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, hashes: np.ndarray, text: str, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Index of each hash (ascending, distinct) in the kept table; missing pieces are encoded."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            new = np.flatnonzero(~known)
            pieces = [text[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            lengths = np.fromiter(map(len, made), np.int32, len(made))
            flat = np.fromiter((i for e in made for i in e), np.uint32, int(lengths.sum()))
            starts = len(self.flat) + np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)])
            wide = self.flat.dtype == np.uint32 or (len(flat) and int(flat.max()) > 0xFFFF)
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32 if wide else np.uint16)])
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.starts = np.insert(self.starts, at[new], starts)
            self.lengths = np.insert(self.lengths, at[new], lengths)
            self.sizes = np.insert(self.sizes, at[new], last[new] - first[new])
            self.sums = np.insert(self.sums, at[new], sums[new])
            at = np.searchsorted(self.hashes, hashes)
        return at

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; all code points are of a known class."""
        text = "".join(texts)
        docs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cps):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = piece_starts(cps, docs)
        terms = _CODE[cps]
        terms *= textscan.powers(textscan._BASE, len(cps))
        sums = np.add.reduceat(terms, starts)
        sums *= textscan.powers(textscan._INVERSE, len(cps))[starts]
        hashes = textscan.mix(sums)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(cps))
        if len(self.hashes) + len(distinct) > self.keep:
            self._clear()
        sizes, plain = ends - starts, np.add.reduceat(cps, starts)
        at = self._find(distinct, text, plain[first], starts[first], ends[first])[which]
        # pieces are found by a hash of 64 bits, and have to agree in length and in the sum of their code points too
        if (self.sizes[at] != sizes).any() or (self.sums[at] != plain).any():
            ids = [self._whole(t) for t in texts]
            return np.concatenate(ids), np.array([len(i) for i in ids])
        lengths = self.lengths[at].astype(np.int64)
        upto = np.cumsum(lengths)
        take = np.arange(int(upto[-1])) + np.repeat(self.starts[at] - (upto - lengths), lengths)
        upto = np.concatenate([[0], upto])
        bounds = upto[np.searchsorted(starts, docs)]
        return self.flat[take].astype(np.uint32), np.diff(bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not self.by_pieces or "<|" in t or not t.isascii() and not self._known(t):
                out[i] = self._whole(t)
            else:
                plain.append(i)
        at = 0
        while at < len(plain):
            group, size = [], 0
            while at < len(plain) and (not group or size + len(texts[plain[at]]) <= GROUP):
                group.append(plain[at])
                size += len(texts[plain[at]])
                at += 1
            ids, lengths = self._plain([texts[i] for i in group])
            for i, part in zip(group, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = part
        return out

    @staticmethod
    def _known(t: str) -> bool:
        cps = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return bool(np.all((cps < _KNOWN) | ((cps >= _PUNCTUATION[0]) & (cps <= _PUNCTUATION[1]))))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


SEGMENT_SCHEMA = "part int, seq int, start long, n_ids long, n_docs long, payload binary"


def _segments(tokenizer_path: str, end_id: int):
    def run(batches):
        encoder = _encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        doc_ids, arrays, held, start, seq = [], [], 0, 0, 0

        def close():
            ids = np.concatenate(arrays)
            row = (part, seq, start, len(ids), len(doc_ids), encode_segment(doc_ids, np.array([len(a) for a in arrays]), ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["part", "seq", "start", "n_ids", "n_docs", "payload"],
            )

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for cut in textscan.slices(batch, limit=2 << 20):
                texts = [t or "" for t in cut.column(1).to_pylist()]
                for doc, ids in zip(cut.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    doc_ids.append(doc)
                    arrays.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
                    if held >= SEGMENT_IDS:
                        yield close()
                        start, seq = start + held, seq + 1
                        doc_ids, arrays, held = [], [], 0
        if doc_ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> str:
    """Encode all whole texts and write segments; returns the path of the table.

    Documents stand in ascending order of doc_id, nulls first, then of the text's hash: range partitions are segments
    ``part``, so a file of one part holds a run of ids. A null text counts as empty and has the end id alone. Documents
    with equal ids are kept, each by itself. Other columns are ignored. An empty table gives an empty table.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", "text")
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(textscan.tidy(_segments(tokenizer_path, end_id)), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def segment_starts(segments: DataFrame) -> DataFrame:
    """The segments with ``start`` counted from the first part: totals of parts, as many rows as tasks wrote, are summed."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    # one row a writing task: bounded by the number of partitions, not by rows
    return segments.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            starts, payloads = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = decode_segment(payloads[i].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(first + starts[i].as_py(), pa.int64()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1:] if len(ends) else [0]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    segments = segment_starts(spark.read.schema(SEGMENT_SCHEMA).parquet(path)).select("start", "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments.mapInArrow(textscan.tidy(_documents(with_ids)), schema)
