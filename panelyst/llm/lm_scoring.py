"""Language-model scoring by deleted interpolation of word trigrams, bigrams, unigrams and a uniform model.

Maximum-likelihood estimates are mixed with weights that depend on how often the context was seen: first bigram, unigram and
uniform part by the word before, then the trigram and that mixture by the two words before. Expectation-maximisation learns
them on a tenth of the training documents, whose counts are left out of the estimates meanwhile. Counts cover all training
documents and lie in shards; chunks of documents ask them for what they have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .chunk_counts import by_shard, chunks, pack_keys, pack_planes, pack_rows, unpack_keys, unpack_planes, unpack_rows
from .common import written

_U = np.uint64
#: Stand for the end of a text and for what is before its first word; no word's hash is made this way.
END = _U(0x1D8E4E27C47D124F)
START = _U(0xEB44ACCAB455D165)
#: Text bytes a shard of counts is made for.
SHARD_BYTES = 16 << 20
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...; the last is open.
BUCKETS = 24
#: Steps of the grid on which probabilities are gathered for expectation-maximisation: quarters of a power of two.
STEP = 4
#: Weight that the uniform part keeps at least, so that unseen words have a probability.
FLOOR = 1e-6


def tokens(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, offsets of documents): words, lower-cased, and one end for each text."""
    words, at = textscan.word_hashes(values, offsets)
    docs = np.arange(len(at) - 1)
    out = np.empty(len(words) + len(docs), _U)
    ends = at[1:] + docs
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = words
    before = np.empty(len(out), _U)
    before[1:] = out[:-1]
    starts = at[:-1] + docs
    before[starts] = START
    return out, before, np.append(starts, len(out))


def unigram_keys(token: np.ndarray) -> np.ndarray:
    return token


def bigram_keys(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    return textscan.mix(before * _U(0x9E6C63D0876A9A47) + token)


def trigram_keys(token: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of each token with the two before it."""
    pairs = np.empty(len(token), _U)
    pairs[1:] = bigram_keys(token, before)[:-1]
    pairs[at[:-1]] = START
    return textscan.mix(pairs * _U(0xD6E8FEB86659FD93) + token)


def _keys(token: np.ndarray, before: np.ndarray, at: np.ndarray):
    """(level, keys of all tokens) of each level in turn."""
    yield 1, unigram_keys(token)
    yield 2, bigram_keys(token, before)
    yield 3, trigram_keys(token, before, at)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tokens(*textscan.text_buffer(table.column("text")))


def _split(batches):
    """Chunks of held-out-for-weights documents (part 1) apart from the others."""
    for batch in batches:
        part = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
        for own in (part == 1, part != 1):
            if own.any():
                yield bool(part[np.argmax(own)] == 1), batch.filter(pa.array(own))


def _chunks(batches):
    held: dict[bool, list] = {True: [], False: []}
    # both kinds are cut apart, so the order of batches decides and a second scan cuts alike
    size = {True: 0, False: 0}
    for kind, batch in _split(batches):
        held[kind].append(batch)
        size[kind] += batch.nbytes
        if size[kind] > 16 << 20:
            for name, rows in chunks(held[kind]):
                yield kind, name, rows
            held[kind], size[kind] = [], 0
    for kind, batches_ in held.items():
        for name, rows in chunks(batches_):
            yield kind, name, rows


REQUEST = "shard int, chunk long, level int, dev boolean, keys binary, counts binary"


def requests(docs: DataFrame, shards: int) -> DataFrame:
    """For each chunk, level (1 to 3) and shard: the distinct keys that the chunk has, and its training counts."""

    def run(batches):
        for dev, name, rows in _chunks(batches):
            token, before, at = _rows_of(rows)
            learn = np.repeat(rows.column("part").to_numpy() > 0, np.diff(at))
            out = []
            for level, keys in _keys(token, before, at):
                distinct, which = np.unique(keys, return_inverse=True)
                counts = np.bincount(which[learn], minlength=len(distinct)).astype("<u4")
                for s, which in by_shard(distinct, shards):
                    out.append((s, name, level, dev, pack_keys(distinct[which]), pack_planes(counts[which])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
                ["shard", "chunk", "level", "dev", "keys", "counts"],
            )

    return docs.mapInArrow(textscan.tidy(run), REQUEST)


ANSWER = "chunk long, of_dev boolean, shard int, level int, rest binary, dev binary, tokens_rest long, tokens_dev long, types_rest long, types_all long"


def answers(asked: DataFrame) -> DataFrame:
    """For each request, the counts of its keys without and within the held-out documents; totals where chunk is null."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for level in (1, 2, 3):
            own = [r for r in rows if r["level"] == level]
            if not own:
                continue
            keys = [unpack_keys(r["keys"]) for r in own]
            distinct = np.unique(np.concatenate(keys))
            sums = {True: np.zeros(len(distinct), np.int64), False: np.zeros(len(distinct), np.int64)}
            places = []
            seen = set()
            for r, k in zip(own, keys, strict=True):
                places.append(np.searchsorted(distinct, k))
                sums[r["dev"]][places[-1]] += unpack_planes(r["counts"], "<u4")
            rest, dev = (sums[d].astype("<u4") for d in (False, True))
            for r, at in zip(own, places, strict=True):
                if r["chunk"] not in seen:  # chunks of the same content ask alike
                    seen.add(r["chunk"])
                    out.append((r["chunk"], r["dev"], r["shard"], level, pack_planes(rest[at]), pack_planes(dev[at]), None, None, None, None))
            if level == 1:
                r, d = sums[False], sums[True]
                out.append((None, None, own[0]["shard"], 1, None, None, int(r.sum()), int(d.sum()), int((r > 0).sum()), int((r + d > 0).sum())))
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in ANSWER.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return asked.groupBy("shard").applyInArrow(textscan.tidied(run), ANSWER)


def _looked_up(rows: pa.Table, replies: pa.Table, shards: int, within: bool):
    """(offsets, counts of each token's word, word before, bigram, bigram before, trigram), held-out ones among them or not."""
    token, before, at = _rows_of(rows)
    by = {(r["level"], r["shard"]): r for r in replies.to_pylist()}
    found = {}
    end = 0
    for level, every in _keys(token, before, at):
        keys, places = np.unique(every, return_inverse=True)
        counts = np.zeros(len(keys), np.uint32)
        for s, which in by_shard(keys, shards):
            r = by.get((level, s))
            if r is None:
                raise RuntimeError("a chunk has no answer: the documents read differ between two scans of one table")
            counts[which] = unpack_planes(r["rest"], "<u4")
            if within:
                counts[which] += unpack_planes(r["dev"], "<u4")
        found[level] = counts[places]
        if level == 1 and len(at) > 1:
            end = counts[np.searchsorted(keys, END)]  # all texts have an end

    def of_before(counts: np.ndarray) -> np.ndarray:
        """The counts of what stands before each token; as many texts start as end."""
        out = np.empty_like(counts)
        out[1:] = counts[:-1]
        out[at[:-1]] = end
        return out

    return at, found[1], of_before(found[1]), found[2], of_before(found[2]), found[3]


def _estimates(word, context, pair, tokens_: int, types: int):
    p2 = pair / np.maximum(context, 1)
    p1 = word / max(tokens_, 1)
    return p2, p1, 1.0 / (types + 1)


def em_weights(cells: pd.DataFrame, rounds: int = 60, parts: tuple[str, ...] = ("p2", "p1", "p0")) -> np.ndarray:
    """(BUCKETS, parts) weights of the parts by expectation-maximisation over a grid of cells.

    cells: bucket, the parts' probabilities and n, how many held-out tokens have them. Buckets without tokens take those of
    the next lower bucket that has some, and at first the mean of all. In bucket 0 the first part says nothing.
    """
    many = len(parts)
    weights = np.full((BUCKETS, many), 1 / many)
    p = cells[list(parts)].to_numpy(float)
    n, b = cells["n"].to_numpy(float), cells["bucket"].to_numpy(int)
    held = np.bincount(b, n, BUCKETS) if len(cells) else np.zeros(BUCKETS)
    for _ in range(rounds if len(cells) else 0):
        part = weights[b] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, part[:, i], BUCKETS) for i in range(many)], axis=1)
        weights = np.where(held[:, None] > 0, new / np.maximum(held[:, None], 1e-300), weights)
    last = weights[held > 0].mean(axis=0) if (held > 0).any() else weights[0]
    for i in range(BUCKETS):
        if held[i] > 0:
            last = weights[i]
        else:
            weights[i] = last
    weights[0, 1:] += weights[0, 0] / (many - 1)
    weights[0, 0] = 0
    weights = np.maximum(weights, [0] + [FLOOR] * (many - 1))
    return weights / weights.sum(axis=1, keepdims=True)


def role(doc_id: Column) -> Column:
    """crc32 of the doc_id as text modulo 10: 0 is held out, 1 is for the weights, the others for counts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(10)).cast("int")


def score_texts(docs: DataFrame) -> DataFrame:
    """Score all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose role() is 0 are held out; the others teach. A null text counts as empty and has the end alone; a null
    doc_id has the role of the text 'null'. Rows with equal ids are scored each by itself. Without training documents all
    counts are 0 and the uniform part is left. An empty table gives none. Other columns are ignored. The table is
    read several times and must give the same rows each time.
    """
    part = role(F.col("doc_id"))
    rows = docs.select("doc_id", "text", F.when(part == 0, 0).when(part == 1, 1).otherwise(2).cast("int").alias("part"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    replies = written(answers(requests(rows, shards)), "lm-answers", compression="none")
    total = replies.where("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_rest", "tokens_dev", "types_rest", "types_all")]).first()
    replies = replies.where("chunk IS NOT NULL").select("chunk", "of_dev", "shard", "level", "rest", "dev")

    def send(only_dev: bool):
        def run(batches):
            for dev, name, table in _chunks(batches):
                if dev or not only_dev:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack_rows(table)], pa.binary())], ["chunk", "rows"])

        return run

    def mixed(word, context, pair, weights: np.ndarray, n: int, v: int) -> np.ndarray:
        p2, p1, p0 = _estimates(word, context, pair, n, v)
        w = weights[bucket(context)]
        return w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0

    def gathered(columns: list[str], grid_of) -> pd.DataFrame:
        """Cells of a grid of held-out tokens: bucket, quantised probabilities and how many; bounded by the grid, not by documents."""

        def cells(sent: pa.Table, found: pa.Table) -> pa.Table:
            frames = [np.empty((0, len(columns) + 2))]
            for blob in sent.column("rows"):
                which, probabilities = grid_of(*_looked_up(unpack_rows(blob.as_py()), found, shards, False)[1:])
                grid = [np.where(p > 0, np.round(STEP * np.log2(np.maximum(p, 1e-300))), -9999) for p in probabilities]
                u, n = np.unique(np.stack([which, *grid], axis=1), axis=0, return_counts=True)
                frames.append(np.column_stack([u, n]))
            t = np.concatenate(frames).astype(np.int64)
            return pa.table({c: pa.array(t[:, i]) for i, c in enumerate(["bucket", *columns, "n"])})

        texts = rows.mapInArrow(textscan.tidy(send(True)), "chunk long, rows binary").groupBy("chunk")
        schema = ", ".join(f"{c} long" for c in ["bucket", *columns, "n"])
        made = texts.cogroup(replies.where("of_dev").groupBy("chunk")).applyInArrow(textscan.tidied(cells), schema)
        grid = made.groupBy("bucket", *columns).agg(F.sum("n").alias("n")).orderBy("bucket", *columns).toPandas()
        for c in columns:
            grid[c] = np.where(grid[c] > -9999, np.exp2(grid[c] / STEP), 0.0)
        return grid

    n_rest, v_rest = total["tokens_rest"], total["types_rest"]
    first = gathered(["p2", "p1"], lambda word, context, pair, *_: (bucket(context), _estimates(word, context, pair, n_rest, v_rest)[:2]))
    weights = em_weights(first.assign(p0=1.0 / (v_rest + 1)))
    second = gathered(["p3", "rest"], lambda word, context, pair, before, triple: (bucket(before), (triple / np.maximum(before, 1), mixed(word, context, pair, weights, n_rest, v_rest))))
    upper = em_weights(second, parts=("p3", "rest"))
    n_all, v_all = total["tokens_rest"] + total["tokens_dev"], total["types_all"]

    def score(sent: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        for blob in sent.column("rows"):
            table = unpack_rows(blob.as_py())
            at, word, context, pair, before, triple = _looked_up(table, found, shards, True)
            w = upper[bucket(before)]
            p = w[:, 0] * (triple / np.maximum(before, 1)) + w[:, 1] * mixed(word, context, pair, weights, n_all, v_all)
            sums = lambda x, at=at: np.add.reduceat(x, at[:-1])
            parts.append(
                pa.table(
                    {
                        "doc_id": table.column("doc_id"),
                        "held_out": pa.array(table.column("part").to_numpy() == 0),
                        "n_tokens": pa.array(np.diff(at)),
                        "n_known": pa.array(sums((word > 0).astype(np.int64))),
                        "train_tokens": pa.array(np.full(len(at) - 1, n_all, np.int64)),
                        "base_score": pa.array(sums(np.log10((word + 0.1) / (n_all + 0.1 * (v_all + 1))))),
                        "score": pa.array(sums(np.log10(p))),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else OUT.empty_table()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
    return rows.mapInArrow(textscan.tidy(send(False)), "chunk long, rows binary").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(textscan.tidied(score), schema)
