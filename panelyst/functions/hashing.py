"""32-bit hashes and MinHash band keys as columns; products stay within 64 bits, so ANSI mode never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash family.
OFFSET, PRIME = 2166136261, 16777619
HASHES, BANDS, ROWS = 64, 16, 4
LEAST_INGREDIENTS = 5
_M32 = 0xFFFFFFFF


def seeds() -> list[int]:
    """The seeds of the family, from a linear congruential rule."""
    out, state = [], 0x9E3779B9
    for _ in range(HASHES):
        state = (state * 1664525 + 1013904223) & _M32
        out.append(state)
    return out


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside lambdas Spark repeats an expression wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mul32(a: Column, b: int) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, by halves of the first."""
    low = a.bitwiseAND(0xFFFF) * F.lit(b)
    high = F.shiftright(a, 16) * F.lit(b)
    return (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(_M32)


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(OFFSET).cast("long"), lambda h, x: mul32(h.bitwiseXOR(x), PRIME))


def fmix32(h: Column) -> Column:
    steps = [
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)), lambda h: mul32(h, 0x85EBCA6B), lambda h: h.bitwiseXOR(F.shiftright(h, 13)), lambda h: mul32(h, 0xC2B2AE35), lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
    ]
    for step in steps:
        h = _let(h, step)
    return h


def minhash_signature(tokens: Column) -> Column:
    """array<long> of 64 minima; 2**32 - 1 throughout for no tokens."""
    bases = F.transform(tokens, fnv1a32)
    family = F.array(*[F.lit(s).cast("long") for s in seeds()])

    def minima(known: Column) -> Column:
        return F.transform(family, lambda s: F.coalesce(F.array_min(F.transform(known, lambda b: fmix32(b.bitwiseXOR(s)))), F.lit(_M32).cast("long")))

    return F.element_at(F.transform(F.array(bases), minima), 1)


def band_keys(signature: Column) -> Column:
    def key(b: Column) -> Column:
        words = F.slice(signature, b * ROWS + 1, ROWS)
        h = F.aggregate(words, F.lit(OFFSET).cast("long"), lambda a, w: mul32(a.bitwiseXOR(w), PRIME))
        return F.concat_ws(":", F.lit("ing"), b.cast("string"), F.lower(F.conv(h.cast("string"), 10, 36)))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)


def ingredient_keys(tokens: Column) -> Column:
    """Band keys of sets of at least five; none for smaller ones."""
    made = F.element_at(F.transform(F.array(minhash_signature(tokens)), band_keys), 1)
    return F.when(F.size(tokens) >= LEAST_INGREDIENTS, made).otherwise(F.array().cast("array<string>"))
