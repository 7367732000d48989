"""N-gram Jaccard join: exact links and components of documents by their sets of word shingles.

Documents with equal sets are one node. A global order of shingles, frequent ones last, gives each node a prefix that must
share a shingle with the prefix of any node it links with; rows that share one form tiles by shingle, size band and
block. Positions within the prefixes, then bit counts of hashed bitmaps bound the overlap of a pair from above, and what is
left is settled by intersecting the sorted arrays. First each row meets its tile's leader alone; only then, and only
between rows whose components still differ, all pairs of a tile are looked at, so that groups of copies stay linear.
Shingles and nodes are 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import components, discard, written

#: Links: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
SHINGLE = 5
#: A shingle in so many prefixes is frequent, unless FREQUENT_MOST would be; this orders shingles and drops nothing.
FREQUENT = 50
FREQUENT_MOST = 2_000_000
#: Text bytes a shard of prefixes is made for.
SHARD_BYTES = 48 << 20
#: Rows of a block; a tile has at most two blocks.
BLOCK_ROWS = 2048
#: Leaders that a group of tiles may have in a turn, and turns of leaders before all pairs of open tiles.
LEADERS = 32
TURNS = 2
#: First places of a prefix that a row carries to tell whose pair it is.
HEADS = 12
#: Up to so many ids go to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def least_overlap(total: np.ndarray, percent: int = SIMILARITY) -> np.ndarray:
    """The smallest intersection of two sets of ``total`` elements together that makes them similar enough."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = SIMILARITY) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n // 100) + 1, 0)


def _sets(batch: pa.RecordBatch, k: int):
    """(doc_ids, sorted distinct shingle hashes of each document) of every slice of a batch with doc_id, text."""
    for cut in textscan.slices(batch):
        values, offsets = textscan.text_buffer(cut.column(1))
        hashes, at = textscan.shingle_hashes(*textscan.word_hashes(values, offsets), k)
        yield cut.column(0), [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """One hash for each set; 0 for the empty set."""
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    sums = np.add.reduceat(textscan.mix(np.concatenate([sets[i] for i in full]) ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts)
    out = np.zeros(len(sets), np.uint64)
    out[full] = textscan.mix(sums + n[full].astype(np.uint64)) | np.uint64(1)
    return out


def bitmap_of(s: np.ndarray) -> bytes:
    """Bits s % size set, size a power of two from 4 to 8 times the number of elements, at least 64."""
    size = max(64, 1 << math.ceil(math.log2(4 * max(1, len(s)))))
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No intersection is larger: a set bit that the other lacks stands for at least one element that the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    common = int(np.bitwise_count(x & y).sum())
    return min(n_a - int(np.bitwise_count(x).sum()) + common, n_b - int(np.bitwise_count(y).sum()) + common)


def overlap_bounds(maps: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """overlap_bound of many pairs of rows at once."""
    size = np.array([len(m) for m in maps])
    out = np.empty(len(i), np.int64)
    kinds = size[i] * (1 << 32) + size[j]
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        for part in (own[k : k + 8192] for k in range(0, len(own), 8192)):
            x, y = (np.frombuffer(b"".join([maps[r] for r in side[part].tolist()]), np.uint8).reshape(len(part), -1) for side in (i, j))
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
            ones = lambda m: np.bitwise_count(m).sum(axis=1, dtype=np.int64)
            common = ones(x & y)
            out[part] = np.minimum(n[i[part]] - ones(x), n[j[part]] - ones(y)) + common
    return out


# ------------------------------------------------------------------------------------------------- steps


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, node and bitmap of every document."""

    def run(batches):
        for batch in batches:
            done = 0
            for ids, sets in _sets(batch, k):
                hashes = batch.column(2).slice(done, len(sets))
                done += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids, hashes, pa.array([len(s) for s in sets], pa.int64()), pa.array(textscan.signed(node_of(sets))), pa.array([bitmap_of(s) for s in sets], pa.binary())],
                    ["doc_id", "text_hash", "n", "node", "bitmap"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(textscan.tidy(run), "doc_id long, text_hash long, n long, node long, bitmap binary")


def _sharded(shard: np.ndarray, shards: int, columns: dict[str, np.ndarray]):
    """One row for each shard that has something: the shard and its part of every column as bytes."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    have = np.flatnonzero(np.diff(bounds))
    blobs = {c: v[order] for c, v in columns.items()}
    arrays = [pa.array(have.astype(np.int32))]
    arrays += [pa.array([v[bounds[s] : bounds[s + 1]].tobytes() for s in have.tolist()], pa.binary()) for v in blobs.values()]
    return pa.RecordBatch.from_arrays(arrays, ["shard", *columns])


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def frequent_shingles(docs: DataFrame, k: int, percent: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, number of prefixes that have them) of the frequent shingles, counted over all documents."""

    def send(batches):
        for batch in batches:
            for _, sets in _sets(batch, k):
                keys = [s[: int(prefix_length(np.int64(len(s)), percent))] for s in sets if len(s)]
                if keys:
                    keys = np.concatenate(keys)
                    yield _sharded((textscan.mix(keys) % np.uint64(shards)).astype(np.int64), shards, {"keys": keys})

    def count(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(_joined(table, "keys", np.uint64), return_counts=True)
        many = counts >= FREQUENT
        return pa.table(
            {
                "key": pa.array(np.append(textscan.signed(keys[many]), 0)),
                "n": pa.array(np.append(counts[many], counts.sum()).astype(np.int64)),
                "total": pa.array(np.append(np.zeros(many.sum(), bool), True)),
            }
        )

    sent = docs.select("doc_id", "text").mapInArrow(textscan.tidy(send), "shard int, keys binary")
    counted = written(sent.groupBy("shard").applyInArrow(textscan.tidied(count), "key long, n long, total boolean"), "frequent")
    rows = counted.where("total").agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(FREQUENT, -(-rows // FREQUENT_MOST))
    # at most FREQUENT_MOST rows by the choice of ``least``
    got = counted.where(~F.col("total") & (F.col("n") >= least)).select("key", "n").toPandas()
    keys = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def tile_rows(docs: DataFrame, k: int, percent: int, shards: int, frequent) -> DataFrame:
    """(key, node, n, pos, band) of prefix rows whose shingle others have too, and all rows of frequent ones.

    Shards hold whole shingles, except frequent ones, which are spread over several by node.
    """
    spread = docs.sparkSession.sparkContext.broadcast(frequent)
    one_band = math.log((100 / percent))

    def send(batches):
        hot, many = spread.value
        for batch in batches:
            for _, sets in _sets(batch, k):
                nodes = node_of(sets)
                seen, first = np.unique(nodes, return_index=True)
                parts = []
                for i in first[seen != 0].tolist():
                    s = sets[i]
                    p = int(prefix_length(np.int64(len(s)), percent))
                    if len(hot):
                        at = np.searchsorted(hot, s)
                        at[at == len(hot)] = 0
                        is_hot = hot[at] == s
                        if is_hot.any():
                            s = np.concatenate([s[~is_hot], s[is_hot]])
                    parts.append((s[:p], nodes[i], len(s)))
                if not parts:
                    continue
                keys = np.concatenate([x for x, _, _ in parts])
                sizes = np.array([len(x) for x, _, _ in parts])
                node = np.repeat(np.array([x for _, x, _ in parts], np.uint64), sizes)
                n = np.repeat(np.array([x for _, _, x in parts], np.uint32), sizes)
                pos = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
                salt = np.zeros(len(keys), np.uint64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                    is_hot = hot[at] == keys
                    ways = (many[at[is_hot]] // BLOCK_ROWS + 1).astype(np.uint64)
                    salt[is_hot] = textscan.mix(node[is_hot]) % ways
                shard = (textscan.mix(keys + salt) % np.uint64(shards)).astype(np.int64)
                yield _sharded(shard, shards, {"keys": keys, "nodes": node, "ns": n, "poss": pos})

    def meet(table: pa.Table) -> pa.Table:
        hot, _ = spread.value
        key, node = _joined(table, "keys", np.uint64), _joined(table, "nodes", np.uint64)
        n, pos = _joined(table, "ns", np.uint32).astype(np.int64), _joined(table, "poss", np.uint32).astype(np.int64)
        band = np.floor(np.log(n) / one_band).astype(np.int64)
        order = np.lexsort((node, band, key))
        key, node, n, pos, band = key[order], node[order], n[order], pos[order], band[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, pos, band = key[new], node[new], n[new], pos[new], band[new]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.cumsum(fresh) - 1
        keep = np.bincount(group)[group] > 1
        if len(hot):
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            keep |= hot[at] == key
        key, node, n, pos, band = key[keep], node[keep], n[keep], pos[keep], band[keep]
        return pa.table(
            {
                "key": pa.array(textscan.signed(key)),
                "node": pa.array(textscan.signed(node)),
                "n": pa.array(n),
                "pos": pa.array(pos),
                "band": pa.array(band),
            }
        )

    sent = docs.select("doc_id", "text").mapInArrow(textscan.tidy(send), "shard int, keys binary, nodes binary, ns binary, poss binary")
    return sent.groupBy("shard").applyInArrow(textscan.tidied(meet), "key long, node long, n long, pos long, band long")


def open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with their components, of shingles that more than one component has; ``rows`` counts those of a shingle."""
    joined = rows.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = joined.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    return joined.join(mixed.select("key", "rows"), "key")


def star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of rows of open tiles and a leader of each; tiles of like shingles choose alike, turns differ."""
    lead = F.struct(F.xxhash64("node", F.pmod("key", F.lit(LEADERS)), F.lit(turn)).alias("by"), "node", "n", "pos", "root")
    leaders = rows.groupBy("key", "band").agg(F.min(lead).alias("l"))
    met = rows.join(leaders, ["key", "band"]).where("root <> l.root")
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("l.n")) / (100 + percent))
    met = met.where(F.least(F.col("n") - F.col("pos"), F.col("l.n") - F.col("l.pos")) >= least)
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def first_keys(rows: DataFrame) -> DataFrame:
    """(node, heads): the keys among a node's first HEADS places that others share, with their places."""
    early = rows.where(F.col("pos") < HEADS).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("h"))
    return early.select("node", F.transform("h", lambda x: x["pos"]).alias("head_pos"), F.transform("h", lambda x: x["key"]).alias("head_key"))


def _tiles(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows dealt to tiles: of a shingle with many rows, each pair of blocks of nodes is one; sorted by size within a tile."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    return (
        rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "n", "pos", "node", "root", *extra)
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "n", "node")
    )


def _whole_tiles(batches):
    """(table of the first eight columns, rows of the others) with whole tiles alone; at most a batch and a tile are held."""
    held, more = None, []
    for batch in batches:
        table = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)])
        held = table if held is None else np.concatenate([held, table], axis=1)
        if batch.num_columns > 8:
            more += zip(*(batch.column(i).to_pylist() for i in range(8, batch.num_columns)), strict=True)
        cut = int(np.argmax(np.all(held[:3] == held[:3, -1:], axis=0)))
        if cut:
            yield held[:, :cut], more[:cut]
            held, more = held[:, cut:], more[cut:]
    if held is not None and held.shape[1]:
        yield held, more


def _near_rows(t: np.ndarray, percent: int):
    """Pairs of indices (i, j) of a tile whose components differ and whose sizes and positions allow a link."""
    key, lo, hi, block, n, pos, _, root = t
    i, gap = np.arange(t.shape[1]), 0
    while len(i):
        gap += 1
        i = i[i + gap < t.shape[1]]
        j = i + gap
        near = (key[i] == key[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j]) & (n[j] * percent <= n[i] * 100)
        i, j = i[near], j[near]
        ok = (root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_overlap(n[i] + n[j], percent)
        yield i[ok], j[ok]


def promising(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that some other row of their tile may link with, with ``rows`` counted anew: most share a passage alone."""

    def run(batches):
        for t, _ in _whole_tiles(batches):
            mark = np.zeros(t.shape[1], bool)
            for i, j in _near_rows(t, percent):
                mark[i] = mark[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(t[0][mark]), pa.array(t[6][mark])], ["key", "node"])

    found = _tiles(rows, []).mapInArrow(textscan.tidy(run), "key long, node long")
    kept = written(rows.drop("rows").join(found, ["key", "node"], "left_semi"), "promising")
    return kept.join(kept.groupBy("key").agg(F.count("*").alias("rows")), "key")


def cross_pairs(rows: DataFrame, every: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of rows of one tile whose components differ and whose sizes, positions and bits allow a link.

    A pair that meets in several tiles belongs to the first shingle that both have; tiles that can tell that an earlier
    one exists leave it to that. ``every``: all tile rows, from which the first keys of each node come.
    """
    marked = bitmaps.join(first_keys(every), "node", "left")
    tiles = _tiles(promising(rows, percent).join(marked, "node"), ["bitmap", "head_pos", "head_key"])

    def run(batches):
        for t, more in _whole_tiles(batches):
            yield from pairs(t, more)

    def pairs(t: np.ndarray, more: list):
        _, _, _, _, n, pos, node, _ = t
        maps = [m[0] for m in more]
        heads = np.zeros((t.shape[1], HEADS), np.int64)
        filled = np.zeros((t.shape[1], HEADS), bool)
        for r, (_, at, keys) in enumerate(more):
            before = [k for p, k in zip(at or (), keys or (), strict=True) if p < pos[r]]
            heads[r, : len(before)], filled[r, : len(before)] = before, True
        found = []

        def keep(i, j):
            for part in range(0, len(i), 16384):
                x, y = i[part : part + 16384], j[part : part + 16384]
                met = (heads[x][:, :, None] == heads[y][:, None, :]) & filled[x][:, :, None] & filled[y][:, None, :]
                mine = ~met.any(axis=(1, 2))
                x, y = x[mine], y[mine]
                good = overlap_bounds(maps, n, x, y) >= least_overlap(n[x] + n[y], percent)
                found.append(np.stack([np.minimum(node[x[good]], node[y[good]]), np.maximum(node[x[good]], node[y[good]])], axis=1))

        waiting, count = [], 0
        for i, j in _near_rows(t, percent):
            waiting.append((i, j))
            count += len(i)
            if count > 200_000:
                keep(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, count = [], 0
        if count:
            keep(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        u = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["a", "b"])

    return tiles.mapInArrow(textscan.tidy(run), "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links: bit counts first, then the sorted arrays."""
    pairs = written(pairs, "pairs")
    def sided(p: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            p = p.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return p

    def bounded(batches):
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b"))
            least = least_overlap(np.array(n_a, np.int64) + np.array(n_b, np.int64), percent).tolist()
            keep = [i for i in range(len(a)) if overlap_bound(x[i], y[i], n_a[i], n_b[i]) >= least[i]]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    left = written(sided(pairs, nodes, ["n", "bitmap"]).mapInArrow(textscan.tidy(bounded), "a long, b long"), "bounded")
    need = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(need, "node", "left_semi")
    ids = written(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct(), "ids")
    nameless = written(wanted.where("doc_id IS NULL").select("node"), "nameless")  # sets that only rows without an id have

    def arrays(batches):
        for batch in batches:
            for _, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(textscan.signed(node_of(sets))), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select("doc_id", "text").join(some, "doc_id", "left_semi")
    found = chosen.mapInArrow(textscan.tidy(arrays), "node long, items binary").where("node <> 0")
    if not nameless.isEmpty():
        rest = docs.select("doc_id", "text").where("doc_id IS NULL").mapInArrow(textscan.tidy(arrays), "node long, items binary")
        # one row for each set: any number of rows without an id may have it
        found = found.unionByName(rest.join(nameless, "node", "left_semi").groupBy("node").agg(F.min("items").alias("items")))
    items = written(found, "items", compression="none")

    def exact(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "items_a", "items_b"))
            keep = []
            for i in range(batch.num_rows):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= int(least_overlap(np.int64(len(s) + len(t)), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    links = written(sided(left, items, ["items"]).mapInArrow(textscan.tidy(exact), "a long, b long").distinct(), "links")
    for table in (pairs, left, ids, nameless, items):  # nothing reads them any more
        discard(table)
    return links


def similar_components(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, node, root): component_id is the smallest doc_id that links lead to,
    itself included; root, the same for all rows of a component, is 0 for those without shingles; text_hash is xxhash64.

    docs: doc_id, text; other columns are ignored. Words are parted by U+0020 and U+0009..U+000D, A-Z lower-cased. A set
    has the distinct k-word shingles; a text with fewer words has its whole sequence; one without words or a null text has
    an empty set and is a component of its own. Rows with equal sets link. Null doc_ids are never the smallest; rows
    with equal ids stay apart. An empty table gives none.
    """
    profile = written(profiles(docs, k), "profiles")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    rows = written(tile_rows(docs, k, percent, shards, frequent_shingles(docs, k, percent, shards)), "tiles")
    nodes = written(profile.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")), "nodes")
    links, roots = None, nodes.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(TURNS + 1):
        open_ = open_rows(rows, roots)
        found = star_pairs(open_, turn, percent) if turn < TURNS else cross_pairs(open_, rows, nodes.select("node", "bitmap"), percent)
        more = verified(found, nodes, docs, k, percent)
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            roots = written(components(links), "roots")
    for table in (rows, nodes):
        discard(table)
    placed = profile.where("node <> 0").join(roots, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "root").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "node", "root")
    alone = profile.where("node = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", F.lit(0).cast("long").alias("root"))
    return linked.unionByName(alone)
