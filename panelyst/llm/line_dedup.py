"""Line dedup by a deletion-neighbourhood join; DataFrame functions only.

A line goes if an earlier one is equal or within one edit (a character put in, left out or changed). Lines within one edit
share a half, and then all but one block of characters; only blocks whose surroundings meet those of another line emit
their variants, each with one character left out. Equal variants are joined: two lines that leave out the same place differ
by a change there, and a variant equal to another line's block by an insertion. The earliest line of each group is what
decides, so groups need no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of a block.
BLOCK = 64
#: Blocks that are summed up in one.
RUN = 64
#: Up to so many lines (about 60 bytes each) are looked up by a broadcast; more by a shuffle.
BROADCAST_LINES = 500_000

_L = F.lit


def _lines(docs: DataFrame) -> DataFrame:
    """doc (whose order is that of documents), line_no, line of every line."""
    text = F.coalesce(F.col("text"), _L(""))
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    # in two steps, so that the text is hashed once and not again for each line
    return docs.select(doc.alias("doc"), F.split(text, "\n", -1).alias("parts")).select("doc", F.posexplode("parts").alias("line_no", "line"))


def _hash(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(_L("second"), line, _L(7)).alias("b"))


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and last characters, half as many as the line has, and half as many as one fewer."""
    keys = []
    for half in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys += [F.xxhash64(_L("first"), half, F.left(line, half)), F.xxhash64(_L("last"), half, F.right(line, half))]
    return F.array_distinct(F.array(*keys))


def _chunks(line: Column) -> Column:
    """The line in blocks of BLOCK characters, found in one pass."""
    return F.regexp_extract_all(line, _L(f"(?s)(.{{1,{BLOCK}}})"), _L(1))


def _running(hashes: Column) -> Column:
    """array: XOR of what stands before each place of an array of longs, and of the whole at the end.

    Runs of RUN places are summed up first, so that a place costs RUN steps at most, whatever the length.
    """
    xor = lambda values: F.aggregate(values, _L(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    n = F.size(hashes)
    runs = F.transform(F.sequence(_L(0), F.floor(n / RUN).cast("int")), lambda r: xor(F.slice(hashes, r * RUN + 1, _L(RUN))))
    # struct<all, last>: one entry a run
    start = F.struct(F.array(_L(0).cast("long")).alias("all"), _L(0).cast("long").alias("last"))
    before = F.aggregate(runs, start, lambda s, x: F.struct(F.array_append(s["all"], s["last"].bitwiseXOR(x)).alias("all"), s["last"].bitwiseXOR(x).alias("last")))["all"]

    def all_of(bound: Column) -> Column:
        return F.transform(F.sequence(_L(0), n), lambda i: F.get(bound, F.floor(i / RUN).cast("int")).bitwiseXOR(xor(F.slice(hashes, (F.floor(i / RUN) * RUN + 1).cast("int"), (i % RUN).cast("int")))))

    # the one-element outer array binds what every place reads to a variable
    return F.element_at(F.transform(F.array(before), all_of), 1)


def _hashed(chunks: Column) -> Column:
    return F.transform(chunks, lambda c, k: F.xxhash64(k, c))


def _blocks(lines: DataFrame) -> DataFrame:
    """h, first and b, a struct (key, block, short, j), of lines (h, first, line): each block with a hash of what surrounds it, as of
    a line of this length and, short, of one that has a character more in the block.

    What lies before a block is the XOR of hashes of blocks with their numbers, and so is what lies behind. Behind a block that
    lacks a character, blocks begin one character earlier.
    """
    n = F.length("line")
    rows = lines.select("h", "first", n.alias("n"), _chunks(F.col("line")).alias("whole"), _chunks(F.concat(_L("\x01"), "line")).alias("early"))
    # columns of their own, so that no place hashes the line again
    rows = rows.select("h", "first", "n", "whole", _hashed(F.col("whole")).alias("wh"), _hashed(F.col("early")).alias("eh"))
    rows = rows.select("h", "first", "n", "whole", _running(F.col("wh")).alias("w"), _running(F.col("eh")).alias("e"))

    def made(short: int) -> Column:
        full = F.col("n") + short
        runs = F.col("e" if short else "w")

        def one(j: Column) -> Column:
            after = F.greatest(_L(0), full - j * BLOCK - BLOCK).cast("int")
            size = F.size(runs) - 1
            behind = F.get(runs, size).bitwiseXOR(F.get(runs, F.least(j + 1, size)))
            chunk = F.coalesce(F.get("whole", j), _L(""))
            key = F.xxhash64(j, after, F.get("w", j), F.when(after > 0, behind).otherwise(_L(0)))
            return F.struct(key.alias("key"), (F.left(chunk, _L(BLOCK - 1)) if short else chunk).alias("block"), _L(bool(short)).alias("short"), j.alias("j"))

        return F.transform(F.sequence(_L(0), F.floor((full - 1) / BLOCK).cast("int")), one)

    return rows.select("h", "first", F.explode(F.concat(made(0), made(1))).alias("b"))


def near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Hashes h of the distinct lines that have an earlier line within one edit.

    lines: h, first (doc and line_no where it is first), keys.
    """
    keyed = lines.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = written(keyed.join(shared, "key", "left_semi").select("h").distinct().join(lines.select("h", "first"), "h"), "line-candidates")
    table = F.broadcast(some) if some.count() <= BROADCAST_LINES else some
    texts = _lines(docs).withColumn("h", _hash(F.col("line"))).join(table, "h").where((F.col("doc") == F.col("first.doc")) & (F.col("line_no") == F.col("first.line_no")))
    texts = written(texts.select("h", "first", "line").dropDuplicates(["h"]), "line-texts")
    blocks = _blocks(texts).select("h", "first", "b.*")
    met = blocks.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    blocks = written(blocks.join(met, "key", "left_semi"), "line-blocks")
    size = F.length("block")
    own = blocks.where(~F.col("short") & (size > 0)).select("h", "first", "j", "key", "block", F.explode(F.sequence(_L(1), size)).alias("p"))
    variant = F.concat(F.left("block", F.col("p") - 1), F.substr("block", F.col("p") + 1, F.lit(BLOCK)))
    left_out = own.select("h", "first", "j", "p", F.xxhash64("key", variant).alias("v"))
    whole = blocks.where("short").select("h", "first", "j", F.xxhash64("key", "block").alias("v"))
    earliest = F.struct("first", "h")
    # of variants that several lines have; read from a table, so that a hot one can be split
    several = left_out.groupBy("v", "p").agg(F.min(earliest).alias("e"), F.max("h").alias("hi"), F.min("h").alias("lo")).where("lo <> hi")
    changed = written(several.select("v", "p", "e"), "line-variants")
    with_change = left_out.join(changed, ["v", "p"]).where(F.col("first") > F.col("e.first")).select("h", "e", "j")
    longer = left_out.groupBy("v").agg(F.min(earliest).alias("e"))
    shorter = whole.groupBy("v").agg(F.min(earliest).alias("e"))
    with_more = left_out.join(shorter, "v").where(F.col("first") > F.col("e.first")).select("h", "e", "j")
    with_less = whole.join(longer, "v").where(F.col("first") > F.col("e.first")).select("h", "e", "j")
    pairs = with_change.unionByName(with_more).unionByName(with_less).select("h", F.col("e.h").alias("other"), "j").distinct()
    a, b = texts.select("h", "line"), texts.select(F.col("h").alias("other"), F.col("line").alias("other_line"))
    return pairs.join(a, "h").join(b, "other").where(_within_one(F.col("line"), F.col("other_line"), F.col("j"))).select("h").distinct()


def _within_one(a: Column, b: Column, j: Column) -> Column:
    """Whether lines are equal but for block j, and that within one edit; what stands around is compared in one pass."""
    start = j * BLOCK
    after = F.greatest(_L(0), F.greatest(F.length(a), F.length(b)) - start - BLOCK)
    block = lambda x: F.substr(x, start + 1, F.length(x) - start - after)
    around = (F.left(a, start) == F.left(b, start)) & (F.right(a, after) == F.right(b, after))
    return around & (F.levenshtein(block(a), block(b), 1) >= 0)


def line_removals(docs: DataFrame) -> DataFrame:
    """doc (id and text hash), n_lines, removed (line numbers from 0), n_near (how many of them only for an edit)."""
    line, n = F.col("line"), F.length("line")
    blank = F.trim(line) == ""
    occ = written(_lines(docs).where(~blank).distinct().select("doc", "line_no", _hash(line).alias("h"), _half_keys(line, n).alias("keys")), "lines")
    firsts = written(occ.groupBy("h").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.min("keys").alias("keys")), "distinct-lines")
    near = near_lines(firsts, docs).withColumn("near", _L(True))
    judged = firsts.select("h", "first").join(near, "h", "left")
    gone = occ.select("doc", "line_no", "h").join(judged, "h")
    again = (F.col("doc") != F.col("first.doc")) | (F.col("line_no") != F.col("first.line_no"))
    gone = gone.where(again | F.col("near"))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_list("line_no")).alias("removed"), F.count_if(~again).alias("n_near"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text less its removed lines, and n_lines, n_removed, n_near (columns of these names are replaced).

    Lines are parted by U+000A. Documents stand in ascending order of doc_id, null ids last, then of a hash of the text.
    A line goes if an earlier line, of this document or another, equals it or is within one edit; that the earlier one goes
    too doesn't matter. Lines of blanks stay and are compared with
    none. A null text stays null and counts as one blank line. Rows equal in doc_id and text are one document and lose
    the same lines. An empty table gives none. Equality of lines is that of 128-bit hashes.
    """
    docs = docs.drop("n_lines", "n_removed", "n_near")
    # the row is one struct, so that its columns' names meet none of these
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", _L(""))).alias("hash")).alias("b")
    lost = line_removals(docs).alias("l")
    joined = base.join(lost, F.expr("b.id <=> l.doc.id AND b.hash = l.doc.hash"), "left")
    row, removed = F.col("row"), F.col("l.removed")
    parts = F.split(row["text"], "\n", -1)
    # numbers of lines that stay, in one pass over both, whatever their numbers
    stay = F.array_except(F.sequence(_L(0), F.size(parts) - 1), removed)
    kept = F.element_at(F.transform(F.array(parts), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), 1)
    out = {c: row[c] for c in docs.columns}
    out["text"] = F.when(removed.isNull(), row["text"]).otherwise(kept)
    return joined.select(
        *[c.alias(k) for k, c in out.items()],
        F.coalesce(F.size(parts), _L(1)).alias("n_lines"),
        F.coalesce(F.size(removed), _L(0)).alias("n_removed"),
        F.coalesce("l.n_near", _L(0)).alias("n_near"),
    )
