"""Chunks of documents that ask shards of a count table for the n-grams they have.

A chunk is a run of rows of one scan partition, named by a hash of its content, so that a second scan of the same table
finds its answers whatever the partitions are called. A chunk asks for each distinct n-gram once, hence requests and
answers are packed arrays and the rows that Spark shuffles stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from . import textscan

#: Text bytes of a chunk; one longer text makes a longer chunk.
CHUNK_BYTES = 8 << 20


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct 64-bit keys as compressed byte planes of their differences."""
    deltas = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pack_planes(deltas)


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, "<u8"), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_rows(rows: pa.Table) -> bytes:
    """Rows of documents as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def name_of(rows: pa.Table) -> int:
    """Signed 64-bit hash of doc_ids and texts."""
    h = xxhash.xxh3_64()
    h.update(repr(rows.column("doc_id").to_pylist()).encode())
    values, offsets = textscan.text_buffer(rows.column("text"))
    h.update(offsets.tobytes())
    h.update(np.ascontiguousarray(values))
    return int(np.uint64(h.intdigest()).view(np.int64))


def chunks(batches, limit: int = CHUNK_BYTES):
    """(name, table) of runs of rows with about ``limit`` bytes of text, the same in every scan of the same rows."""
    held, size = [], 0
    for batch in batches:
        for cut in textscan.slices(batch, limit=limit):
            values, _ = textscan.text_buffer(cut.column(cut.schema.get_field_index("text")))
            if held and size + len(values) > limit:
                yield _chunk(held)
                held, size = [], 0
            held.append(cut)
            size += len(values)
    if held:
        yield _chunk(held)


def _chunk(held: list) -> tuple[int, pa.Table]:
    rows = pa.Table.from_batches(held).combine_chunks()
    return name_of(rows), rows


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so that the keys of a shard lie close together and their differences are small."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, indices of its keys) for shards that have any; the keys are ascending hashes."""
    bounds = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    return [(s, np.arange(bounds[s], bounds[s + 1])) for s in np.flatnonzero(np.diff(bounds)).tolist()]
