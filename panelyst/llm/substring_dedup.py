"""Removal of every byte in a string of ``length`` bytes that also starts elsewhere.

A sample of suffixes decides, as in difference-cover suffix sorting, but the sample is chosen by content: each window of
``length`` bytes names the least of the hashes of its 64-byte strings, so equal windows have their sampled suffix at the same
offset, and neighbouring windows mostly share it. Runs of windows with one sampled suffix are the units. First the names of
sampled suffixes and of whole runs are compared: a run whose name no other has holds nothing repeated, one whose bytes all
recur is repeated throughout. Only windows of the remaining runs, and of one run of each recurring kind, are compared one by
one. Each comparison sends names to shards, sorts them there and looks at neighbours. See the README for why not all suffixes
are ranked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .chunk_counts import by_shard, chunks, pack_keys, pack_rows, unpack_keys, unpack_rows
from .common import written

_U = np.uint64
LENGTH = 400
#: Bytes of the strings whose hashes choose the sample.
GRAM = 64
#: Shared passages of this many bytes and more, which may be too short to go, always show in longest_shared.
PASSAGE = 192
#: Text bytes a shard of names is made for.
SHARD_BYTES = 8 << 20
SLICE = 2 << 20

NAME, RUN, WINDOW, SHORT = 0, 1, 2, 3


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima to both sides of block borders."""
    n = len(values)
    if n < width:
        return np.empty(0, values.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Scan:
    """Runs of windows of a slice of documents, and hashes of any of its strings."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, length: int, short: bool = False):
        n = len(values)
        gram = min(GRAM, length)
        self.length = length
        self.first = self.last = self.picks = np.empty(0, np.int64)
        self.names = self.short_names = np.empty(0, _U)
        if n < min(length, PASSAGE):
            return
        terms = textscan._BYTE[values]
        terms *= textscan.powers(textscan._BASE, n)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(terms, out=self.sums[1:])
        del terms
        self.inverse = textscan.powers(textscan._INVERSE, n + 1)
        grams = self.hashes(np.arange(n - gram + 1), gram)
        # the place breaks ties, so that equal strings in one window stay apart: the first of them is the sample
        place = _U((1 << max(22, n.bit_length())) - 1)
        ranked = (grams & ~place) | np.arange(len(grams), dtype=_U)

        def sampled(width: int) -> tuple[np.ndarray, np.ndarray]:
            """(start, place of the sample) of every window of ``width`` bytes within a document."""
            least = least_of_windows(ranked, width - gram + 1) & place
            room = np.zeros(n + 1, np.int32)
            fits = np.diff(offsets) >= width
            np.add.at(room, offsets[:-1][fits], 1)
            np.add.at(room, offsets[1:][fits] - width + 1, -1)
            start = np.flatnonzero(np.cumsum(room[: len(least)]) > 0)
            return start, least[start]

        if short:
            _, least = sampled(max(gram, min(PASSAGE, length)))
            # places of samples never go back from window to window
            self.picks = least[np.append(True, least[1:] != least[:-1])[: len(least)]].astype(np.int64)
            self.short_names = grams[self.picks]
        start, least = sampled(length)
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        self.names = grams[least[at].astype(np.int64)]
        self.first = start[at]
        self.last = start[np.append(at[1:], len(start)) - 1] if len(at) else self.first

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return textscan.mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def runs(self) -> np.ndarray:
        """A hash of all bytes of each run."""
        size = self.last - self.first + self.length
        return textscan.mix(self.hashes(self.first, size) + size.astype(_U)) if len(size) else np.empty(0, _U)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, key, check) of the windows of some runs; key and check have 80 bits."""
        many = self.last[which] - self.first[which] + 1
        starts = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[which], many)
        if not len(starts):
            return starts, np.empty(0, _U), np.empty(0, "<u2")
        own, name = self.hashes(starts, self.length), np.repeat(self.names[which], many)
        check = textscan.mix(name ^ (self.hashes(starts, min(97, self.length)) + _U(0x51ED270B))) >> _U(48)
        return starts, own, check.astype("<u2")


def _scans(table: pa.Table, length: int, short: bool = False):
    for batch in table.to_batches():
        for cut in textscan.slices(batch, limit=SLICE):
            values, offsets = textscan.text_buffer(cut.column(1))
            yield cut, values, offsets, Scan(values, offsets, length, short)


REQUEST = "shard int, chunk long, kind int, names binary, checks binary, again binary"
ANSWER = "chunk long, shard int, kind int, repeated binary, chosen binary"


def _distinct(keys: np.ndarray, checks: np.ndarray):
    """Ascending distinct (key, check) and whether each occurs more than once."""
    order = np.lexsort((checks, keys)) if len(checks) and checks.any() else np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    return k[at], c[at], np.diff(np.append(at, len(k))) > 1


def _requests(name: int, kind: int, keys: np.ndarray, checks: np.ndarray, shards: int):
    k, c, again = _distinct(keys, checks)
    for s, which in by_shard(k, shards):
        yield s, name, kind, pack_keys(k[which]), c[which].tobytes(), np.packbits(again[which]).tobytes()


def _request_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in REQUEST.split(", ")])


def _answers(asked: DataFrame) -> DataFrame:
    """For each request, which names occur elsewhere, and of which the asking chunk is the one chosen among those that have it."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["chunk"]))
        for kind in sorted({r["kind"] for r in rows}):
            own = [r for r in rows if r["kind"] == kind]
            keys = [unpack_keys(r["names"]) for r in own]
            sizes = [len(k) for k in keys]
            flat, checks = np.concatenate(keys), np.concatenate([np.frombuffer(r["checks"], "<u2") for r in own])
            again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=n) for r, n in zip(own, sizes, strict=True)])
            order = np.lexsort((checks, flat))
            k, c = flat[order], checks[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            times = np.add.reduceat(1 + again[order].astype(np.int64), at)
            group = np.cumsum(new) - 1
            repeated, chosen = np.empty(len(k), bool), np.empty(len(k), bool)
            repeated[order] = times[group] > 1
            chosen[order] = new
            seen = set()
            ends = np.cumsum(sizes)
            for r, b, n in zip(own, ends.tolist(), sizes, strict=True):
                if r["chunk"] not in seen:  # chunks of equal content ask alike
                    seen.add(r["chunk"])
                    out.append((r["chunk"], r["shard"], kind, np.packbits(repeated[b - n : b]).tobytes(), np.packbits(chosen[b - n : b]).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])

    return asked.groupBy("shard").applyInArrow(textscan.tidied(run), ANSWER)


class _Found:
    """Looks up what the shards answered to one chunk."""

    def __init__(self, found: pa.Table, shards: int):
        self.by = {(r["kind"], r["shard"]): r for r in found.to_pylist()}
        self.shards = shards

    def table(self, kind: int, keys: np.ndarray, checks: np.ndarray):
        """(distinct keys, checks, repeated, chosen) for all keys of the chunk."""
        k, c, _ = _distinct(keys, checks)
        repeated, chosen = np.zeros(len(k), bool), np.zeros(len(k), bool)
        for s, which in by_shard(k, self.shards):
            r = self.by.get((kind, s))
            if r is None:
                raise RuntimeError("a chunk has no answer: the documents read differ between two scans of one table")
            for out, bits in ((repeated, r["repeated"]), (chosen, r["chosen"])):
                out[which] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(which)).astype(bool)
        return k, c, repeated, chosen


def _chunk_names(table: pa.Table, length: int) -> dict[int, np.ndarray]:
    scans = [s for *_, s in _scans(table, length, True)]
    parts = {NAME: [s.names for s in scans], RUN: [s.runs() for s in scans], SHORT: [s.short_names for s in scans]}
    return {kind: np.concatenate(own) for kind, own in parts.items()}


def _none(keys: np.ndarray) -> np.ndarray:
    return np.zeros(len(keys), "<u2")


def _judged(table: pa.Table, found: _Found, length: int, short: bool = False) -> list:
    """For each slice: (cut, values, offsets, scan, runs repeated throughout, runs whose windows are to be compared)."""
    slices = list(_scans(table, length, short))
    names = [scan.names for *_, scan in slices]
    runs = [scan.runs() for *_, scan in slices]
    k, _, repeated, _ = found.table(NAME, all_names := np.concatenate(names), _none(all_names))
    r, _, whole, chosen = found.table(RUN, all_runs := np.concatenate(runs), _none(all_runs))
    spoken = np.zeros(len(r), bool)  # one run of each kind speaks for all, if its chunk was chosen
    out = []
    for (cut, values, offsets, scan), name, own in zip(slices, names, runs, strict=True):
        at = np.searchsorted(r, own)
        alive, full, first = (np.zeros(len(own), bool) for _ in range(3))
        if len(own):
            alive, full = repeated[np.searchsorted(k, name)], whole[at]
            _, where = np.unique(at, return_index=True)
            first[where] = True
            first &= ~spoken[at] & chosen[at]
            spoken[at] = True
        out.append((cut, values, offsets, scan, full, np.flatnonzero(alive & (~full | first))))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, longest_shared): spans of repeated bytes, as array<struct<first, end>>, and the other
    bytes, joined; longest_shared, the bytes from the first to the last of strings of GRAM bytes in a row, sampled by content,
    that all start elsewhere too: above 0 wherever PASSAGE bytes recur, though they be too few to be removed.

    docs: doc_id, text; other columns are ignored. Texts are UTF-8 bytes, null ones empty; strings never cross documents,
    and overlapping ones count. Rows with equal ids are documents of their own, and equal rows repeat each other. An empty
    table gives none. Strings are told apart by hashes of 80 bits. The table is read several times and must give
    the same rows each time.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-size // SHARD_BYTES))

    def ask_names(batches):
        for name, table in chunks(batches):
            kinds = _chunk_names(table, length)
            yield _request_batch([r for kind, keys in kinds.items() for r in _requests(name, kind, keys, _none(keys), shards)])

    names = written(_answers(rows.mapInArrow(textscan.tidy(ask_names), REQUEST)), "suffix-names", compression="none")

    def send(batches):
        for name, table in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_rows(table)], pa.binary())], ["chunk", "rows"])

    sent = rows.mapInArrow(textscan.tidy(send), "chunk long, rows binary")

    def joined(windows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([w[1] for w in windows]), np.concatenate([w[2] for w in windows])

    def ask_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, out = _Found(answers, shards), []
        for blob, name in zip(texts.column("rows"), texts.column("chunk").to_pylist(), strict=True):
            windows = [scan.windows(which) for *_, scan, _, which in _judged(unpack_rows(blob.as_py()), found, length)]
            out += _requests(name, WINDOW, *joined(windows), shards)
        return pa.Table.from_batches([_request_batch(out)])

    asked = sent.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(textscan.tidied(ask_windows), REQUEST)
    both = names.unionByName(written(_answers(asked), "suffix-windows", compression="none"))

    def cut_out(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, out = _Found(answers, shards), []
        for blob in texts.column("rows"):
            judged = _judged(unpack_rows(blob.as_py()), found, length, True)
            short = np.concatenate([j[3].short_names for j in judged])
            names, _, common, _ = found.table(SHORT, short, _none(short))
            windows = [scan.windows(which) for *_, scan, _, which in judged]
            k, c, repeated, _ = found.table(WINDOW, *joined(windows))
            both_keys = textscan.mix(k) + c
            order = np.argsort(both_keys)
            both_keys, again = both_keys[order], repeated[order]
            for (cut, values, offsets, scan, full, _), (start, key, check) in zip(judged, windows, strict=True):
                delta = np.zeros(len(values) + 1, np.int64)
                delta[scan.first[full]] += 1
                np.add.at(delta, scan.last[full] + length, -1)
                if len(start):
                    start = start[again[np.searchsorted(both_keys, textscan.mix(key) + check)]]
                    delta[start] += 1  # starts differ
                    delta[start + length] -= 1
                gone = np.cumsum(delta[:-1]) > 0
                out.append(_cut(cut, values, offsets, gone, _longest(scan, offsets, common[np.searchsorted(names, scan.short_names)])))
        return pa.concat_tables(out) if out else _OUT.empty_table()

    schema = "doc_id long, n_bytes long, spans array<struct<first: long, end: long>>, kept binary, longest_shared long"
    return sent.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(textscan.tidied(cut_out), schema)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary()), ("longest_shared", pa.int64())])


def _longest(scan: Scan, offsets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each document, the bytes of its longest row of sampled strings that all recur."""
    out = np.zeros(len(offsets) - 1, np.int64)
    at = scan.picks[common]
    if len(at):
        doc = np.searchsorted(offsets, at, side="right") - 1
        which = np.flatnonzero(common)
        new = np.ones(len(at), bool)
        new[1:] = (which[1:] != which[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        np.maximum.at(out, doc[first], at[last] - at[first] + min(GRAM, scan.length))
    return out


def _cut(cut: pa.RecordBatch, values: np.ndarray, offsets: np.ndarray, gone: np.ndarray, longest: np.ndarray) -> pa.Table:
    """Spans of ``gone`` within each document, and the bytes that stay."""
    edge = np.zeros(len(values) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], gone])
    after = np.append(gone, False)
    first = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    doc = np.searchsorted(offsets, first, side="right") - 1
    at = np.searchsorted(doc, np.arange(cut.num_rows + 1))
    stay = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = values[~gone].tobytes()
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first - offsets[doc]), pa.array(end - offsets[doc])], ["first", "end"]))
    return pa.table(
        {
            "doc_id": cut.column(0),
            "n_bytes": pa.array(np.diff(offsets)),
            "spans": spans,
            "kept": pa.array([kept[a:b] for a, b in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)], pa.binary()),
            "longest_shared": pa.array(longest),
        }
    ).cast(_OUT)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans by comparing all strings in memory, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            key = hashlib.sha1(t[i : i + length]).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for t in texts:
        spans: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[hashlib.sha1(t[i : i + length]).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out
