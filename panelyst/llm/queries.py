"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fingerprints, importance_resampling, line_dedup, lm_scoring, ngram_join, periodic_runs, quality_classifier, sharding, source_mixing, substring_dedup, token_blocks
from .common import WORD, small_batches

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write segments in doc_id order, read them back."""
    path = token_blocks.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_blocks.read_tokens(spark, path)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are at least 75 % alike."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, and where."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each text without repeated strings of 400 bytes."""
    out = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_shared")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document against its language's threshold."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without lines that came before, equal or within one edit."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.col("n_near").cast("long"), F.col("text").alias("kept_text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of texts, edited texts and their likeness."""
    return fingerprints.compared_with_edit(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts under the interpolated model and under the base."""
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    taken = source_mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write 24 shards and read back what lies where."""
    docs = table(spark, sf_dir, "documents")
    columns = {
        "doc_id": F.col("doc_id"),
        "size": sharding.record_size(F.col("text")),
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit(""))),
        "law": F.lit("key"),
        "grown_shard": sharding.shard_of(F.col("doc_id"), 25),
    }
    return sharding.write_shards(docs, 24, columns=columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weighed by how much likelier benchmark texts make their words, and a tenth of them drawn."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target, orders=1, buckets=10_000, seed=2024, least_words=20, percent=10).select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for space, and which of each group stays."""
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def with_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document of ten, by crc32 of its id, goes over into a repetition of its own words; null ids count as 'null'."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8)))))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", turned)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, and its text with each run cut to its first period."""
    out = periodic_runs.find_runs(with_period(table(spark, sf_dir, "documents")))
    # the longest; among equals the first start, then the shortest period
    best = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum((y["length"] - x["length"]).cast("double"))).when(x["start"] != y["start"], F.signum((x["start"] - y["start"]).cast("double"))).otherwise(F.signum((x["period"] - y["period"]).cast("double"))).cast("int")), F.lit(1))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("best.length * 1000 div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_lm_scores": op8_lm_scores,
    "op9_mix_sources": op9_mix_sources,
    "op10_shards": op10_shards,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER ()) * 1.0::DOUBLE AS budget,
             coalesce(sum(cap) OVER o, 0) AS caps_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights_left
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - caps_before) / weights_left AS level FROM r),
f AS (SELECT min(caps_before) AS caps, arg_min(level, caps_before) AS level FROM l WHERE level <= cap::DOUBLE / weight),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.caps IS NULL OR l.caps_before < f.caps THEN l.cap::DOUBLE ELSE least(l.cap::DOUBLE, f.level * l.weight) END AS target
      FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS expected, coalesce(source, chr(0) || 'null') AS name FROM t),
k AS (SELECT e.*, k, ('0x' || substr(md5('17' || chr(31) || k || chr(31) || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
             least(expected * CASE WHEN k % 2 = 1 THEN 0.5::DOUBLE + 2 * ('0x' || substr(md5('17' || chr(31) || 'f' || chr(31) || k || chr(31) || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE ELSE 1.0::DOUBLE END, 3.0::DOUBLE) AS rate
      FROM e, (SELECT unnest(range(128)) AS k)),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, k, doc_id) AS i FROM sized),
z AS (SELECT source, size, min(i) - 1 AS before, count(*) AS n FROM d GROUP BY source, size),
o AS (SELECT k.source, k.k, k.u, k.rate, k.source_size, k.target, sum(z.size * (floor((z.before + z.n) * k.rate + k.u) - floor(z.before * k.rate + k.u))) AS words
      FROM k JOIN z ON z.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words - target), k) = 1)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * d.size AS taken,
       CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) AS copies
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
"""

OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, p[i] AS line, len(p) AS n_lines
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))),
f AS (SELECT line, min(struct_pack(a := doc_id, b := line_no)) AS o FROM l WHERE trim(line) <> '' GROUP BY line),
h AS (SELECT line, o, length(line) AS n FROM f),
k AS (SELECT line, o, n, unnest(list_distinct([('P', n // 2, left(line, n // 2)), ('P', (n - 1) // 2, left(line, (n - 1) // 2)),
                                 ('S', n // 2, right(line, n // 2)), ('S', (n - 1) // 2, right(line, (n - 1) // 2))])) AS key FROM h),
near AS (SELECT DISTINCT x.line FROM k x JOIN k y ON x.key = y.key AND y.o < x.o AND abs(x.n - y.n) <= 1
         -- one edit of characters; levenshtein() counts bytes
         WHERE len(list_filter(range(0, greatest(x.n, y.n)), lambda i: left(x.line, i) = left(y.line, i)
               AND substr(x.line, CAST(i + CASE WHEN x.n >= y.n THEN 2 ELSE 1 END AS BIGINT)) = substr(y.line, CAST(i + CASE WHEN y.n >= x.n THEN 2 ELSE 1 END AS BIGINT)))) > 0),
j AS (SELECT l.*, trim(l.line) <> '' AND (struct_pack(a := doc_id, b := line_no) <> f.o) AS again,
             trim(l.line) <> '' AND near.line IS NOT NULL AS near
      FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, max(n_lines) AS n_lines, count(*) FILTER (again OR near) AS n_removed, count(*) FILTER (near AND NOT again) AS n_near,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(again OR near, FALSE)), '') AS kept_text
FROM j GROUP BY doc_id
"""

OP11_SQL = r"""
WITH c AS (SELECT i, CAST(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS BIGINT) AS v FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM c),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS n FROM w),
p AS (SELECT doc_id, unnest(ws) AS word FROM w),
b AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM benchmark),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM p UNION SELECT word FROM b)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
             lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS s FROM p JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM p) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM p JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT d.doc_id, CAST(n AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20 QUALIFY rank <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100)
SELECT z.*, CAST(r.rank AS BIGINT) AS rank FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""

OP12_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id NULLS LAST) AS place,
             first_value(doc_id) OVER (PARTITION BY normal ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY normal) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM r
"""

ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_mix_sources": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_exact_dedup": OP12_SQL}
