"""Vectorised scanning of Arrow text batches: words, word hashes and shingle hashes.

Everything here works on the UTF-8 buffer of an Arrow string array, so no Python object is made per word.
A word is a run of bytes outside U+0020 and U+0009..U+000D; the hashes see A-Z lower-cased and nothing else changed.
Null texts count as empty. Batches are cut into slices of about ``SLICE_BYTES``, so that memory is bounded by that
figure or by the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Bytes whose words are hashed at a time, within a text too; 64-bit terms of more than this, or of one word, never exist at once.
BLOCK_BYTES = 256 << 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BYTE_LOWER[_SPACE] = 0

_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give memory that nothing uses back to the system: workers are kept for later tasks, idle ones with all they once took."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function of batches that releases memory once its partition ends."""

    def batches_of(batches):
        yield from run(batches)
        release()

    return batches_of


def tidied(run):
    """A function of one table, or of two, that releases memory after each."""
    if run.__code__.co_argcount == 1:

        def one(table):
            out = run(table)
            release()
            return out

        return one

    def two(a, b):
        out = run(a, b)
        release()
        return out

    return two


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit of the result depends on every bit of the input."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown on demand, one table a base."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            np.multiply(have[:step], _U(pow(base, done, 1 << 64)), out=have[done : done + step])
            done += step
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; offsets start at 0 and nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return values[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def word_bounds(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word, and for each document the number of words before it (n + 1 entries)."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[values]
    before = np.empty(len(values), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(values)]
    before[inner] = False
    after = np.empty(len(values), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends_at = offsets[1:][offsets[1:] > 0]
    after[ends_at - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the word offsets of the documents."""
    starts, ends, docs = word_bounds(values, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, first + BLOCK_BYTES)))
        last = ends[to - 1]
        terms = _BYTE_LOWER[values[first:last]]
        terms *= powers(_BASE, last - first)
        sums = np.add.reduceat(terms, starts[at:to] - first)
        sums *= powers(_INVERSE, last - first)[starts[at:to] - first]
        out[at:to] = mix(sums)
        at = to
    return out, docs


def hash_word(word: bytes) -> int:
    """The hash of a single word, as word_hashes makes it."""
    h, _ = word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(h[0])


def shingle_hashes(words: np.ndarray, docs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle and the shingle offsets of the documents.

    A document of 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    n_words = np.diff(docs)
    n_shingles = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(int(offs[-1]), np.uint64)
    mult = [_U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    total = len(words)
    if total >= k:
        rolled = words[: total - k + 1] * mult[0]
        for j in range(1, k):
            rolled += words[j : total - k + 1 + j] * mult[j]
        owner_end = np.repeat(docs[1:], n_words)
        full = np.arange(total) + k <= owner_end
        out_full = mix(rolled[full[: total - k + 1]])
    else:
        out_full = np.empty(0, np.uint64)
    long = n_words >= k
    short = np.flatnonzero((n_words > 0) & ~long)
    if len(short):
        is_full = np.ones(len(out), bool)
        is_full[offs[short]] = False
        out[is_full] = out_full
        for d in short.tolist():
            h = _U(0)
            with np.errstate(over="ignore"):
                for j, w in enumerate(words[docs[d] : docs[d + 1]]):
                    h = h + w * mult[j]
            out[offs[d]] = mix(np.array([h], np.uint64) + _U(int(n_words[d])))[0]
    else:
        out = out_full
    return out, offs


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
