"""Periodic runs of words: bit planes of word ids shifted against themselves, one lag at a time, in big integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan

#: A run has at least so many words, and at least two periods.
LEAST_WORDS = 12
#: Texts of more words first find the lags that can hold a run at all.
LONG_WORDS = 4096

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane b is an integer whose bit i is bit b of word i's id."""
    return [
        int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little")
        for b in range(max(1, int(ids.max()).bit_length()))
    ]


def stretches(equal: int, least: int) -> int:
    """Positions from which ``least`` ones follow each other: shift-doubling AND."""
    have = 1
    while have < least and equal:
        step = min(have, least - have)
        equal &= equal >> step
        have += step
    return equal


def bits(x: int) -> np.ndarray:
    """Positions of ones."""
    if not x:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(x.to_bytes(x.bit_length() + 7 >> 3, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def runs_at(planes: list[int], alive: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of all maximal stretches of words of which each equals the one ``lag`` before it, ``least`` pairs or more.

    Planes that differ are OR-ed one by one; once few pairs are left, what can't hold a stretch any more ends the lag.
    """
    differ, within = 0, alive >> lag
    for k, plane in enumerate(planes):
        differ |= plane ^ plane >> lag
        if k in (1, 4) and not stretches(within & ~differ, least):
            return []
    at = stretches(within & ~differ, least)
    if not at:
        return []
    first, last = bits(at & ~(at << 1)), bits(at & ~(at >> 1))
    return [(int(a), int(b) + least + lag) for a, b in zip(first, last, strict=True)]


def _prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _primitive(ids: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Whether no smaller period holds: by the periodicity lemma it would be a divisor of lag."""
    return not any(np.array_equal(ids[start : end - lag // r], ids[start + lag // r : end]) for r in _prime_divisors(lag))


def _lags_of(ids: np.ndarray, low: int, high: int, hashes: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Lags from low to high - 1 for which some aligned block of low / 2 words stands again that far on.

    A stretch of low and more matching words holds such a block. A pair of blocks within a known run is left out if the run's
    period fits into a block: then that period divides, in effect, what the lag could add.
    """
    n, block = len(ids), low // 2
    usable = n - block + 1
    _, rank = np.unique(hashes[:usable], return_inverse=True)
    key = np.sort(rank.astype(np.int64) * n + np.arange(usable))
    at = np.arange(0, usable, block)
    base = rank[at].astype(np.int64) * n
    lo = np.searchsorted(key, base + np.minimum(at + low, n - 1))
    hi = np.searchsorted(key, base + np.minimum(at + high, n))
    # positions past the end of the text belong to the next rank: none of them
    hi = np.where(at + low >= usable, lo, np.maximum(hi, lo))
    found = []
    # a limited number of pairs at a time
    ends = np.cumsum(hi - lo)
    cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + 1, 4 << 20), side="left").tolist() + [len(at)]
    short = sorted((s, e) for s, e, p in runs if p <= block)
    starts = np.array([s for s, _ in short], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in short], np.int64)) if short else starts
    for a, b in zip(cuts, cuts[1:], strict=False):
        count = hi[a:b] - lo[a:b]
        if not count.sum():
            continue
        here = np.repeat(at[a:b], count)
        place = np.repeat(lo[a:b], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lag = key[place] % n - here
        if len(starts):
            i = np.searchsorted(starts, here, side="right") - 1
            lag = lag[(i < 0) | (reach[i] < here + block + lag)]
        found.append(np.unique(lag))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of word ids, by start, then period.

    Every lag up to half the text is tried. In a text of more than ``long_words`` lags are tried by octaves, and of each octave
    those alone at which some block of words stands again (by hash); the others can't hold a run.
    """
    n = len(ids)
    if n < least_words:
        return []
    planes, alive = bit_planes(ids), (1 << n) - 1
    found: list[tuple[int, int, int]] = []

    def tried(lag: int) -> None:
        for a, b in runs_at(planes, alive, lag, max(least_words - lag, lag)):
            if _primitive(ids, a, b, lag):
                found.append((a, b, lag))

    most = n // 2
    first = most if n <= long_words else min(most, 2 * least_words)
    for lag in range(1, first + 1):
        tried(lag)
    if first < most:
        rng = np.random.default_rng(13)
        word = rng.integers(1, 1 << 63, int(ids.max()) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hashes, block, low = word[ids], 1, 2
        while low <= most:
            while block < low // 2:
                hashes = textscan.mix(hashes[: n - 2 * block + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[block : n - block + 1])
                block *= 2
            if 2 * low > first:
                for lag in _lags_of(ids, low, min(2 * low, most + 1), hashes, found).tolist():
                    if lag > first:
                        tried(lag)
            low *= 2
    return sorted((a, b - a, q) for a, b, q in found)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, [a + q for a, _, q in runs], 1)
    np.add.at(edges, [a + n for a, n, _ in runs], -1)
    dropped = np.cumsum(edges)[:-1] > 0
    return b" ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d)


def _finder(least_words: int, long_words: int, doc_id: pa.DataType):
    def run(batches):
        for batch in batches:
            for cut in textscan.slices(batch):
                all_runs, texts, counts = [], [], []
                for raw in cut.column(1).cast(pa.binary() if pa.types.is_string(cut.column(1).type) else pa.large_binary()):
                    words = (raw.as_py() or b"").split()  # splits bytes at U+0020 and U+0009..U+000D and nothing else
                    known: dict[bytes, int] = {}
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                    runs = runs_of(ids, least_words, long_words)
                    all_runs.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                    texts.append(collapse(words, runs))
                    counts.append(len(words))
                columns = [cut.column(0).cast(doc_id), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.large_string() if sum(map(len, texts)) >> 31 else pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every document.

    Words are parted by U+0020 and U+0009..U+000D and numbered from 0. A run is a stretch of words with smallest period q, at
    least max(least_words, 2 q) long, that can't be made longer on either side. ``collapsed`` has the words that no run holds
    after its first period, joined by one space. Runs stand by start, then period.

    Each text is one row's work and nothing is shuffled; a text of n words takes n / 2 lags of n bits a plane, beyond
    ``long_words`` a number of lags that follows from its repetitions. A null or empty text has no words and no runs; a
    null doc_id stays null, equal rows give equal rows, an empty table none. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(textscan.tidy(_finder(least_words, long_words, to_arrow_type(kind))), schema)
