import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, node string, part int, shard int, n_removed int, removed int, _size int, _nth int, copy_no int, _tie int, _crc int, _start int, _id int, _near int, row int, size int, hash int, bucket_start int, by_id int, by_text int"


def words(text):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


def odd_rows(seed=0):
    """Nulls in any column, empty and long texts, ties, repeated rows; other columns' names clash with operators' own."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    rows = [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t in enumerate(made)]
    rows += [(100, None, "en", "s1", None), (101, "", None, None, 0), (102, " \n\t ", "en", None, 4), (103, "x" * 30_000 + " y" * 3000, "fr", "s2", 1)]
    rows += [rows[3], rows[3], (3, "another text of the same id", "en", "s0", 9), (None, made[5], "en", "s1", 2), (None, None, None, None, None)]
    rows += [(200 + i, made[7] + f" end{i}", "de", "s0", 3) for i in range(5)]
    return [(*r, 1, "n", 2, 3, 4, *range(5, 20)) for r in rows]


def odd(spark, seed=0):
    return spark.createDataFrame(odd_rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
