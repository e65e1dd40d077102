"""Column functions over DNA strings (alphabet A, C, G, T; anything else is N)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: 26 letters in turn over the bases, then digits as unknown bases.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
AS_DNA = "".join(BASES[i % 4] for i in range(26)) + "N" * 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalise(seq: Column) -> Column:
    """Upper case, without white space; what is not A, C, G or T becomes N."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s", "")), "[^ACGT]", "N")


def from_text(text: Column) -> Column:
    """A deterministic DNA view of any text: letters become bases, digits N, the rest goes."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LETTERS[:26])
    return F.translate(F.regexp_replace(low, "[^a-z0-9]", ""), LETTERS, AS_DNA)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def base_ordinal(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, any other 4."""
    at = F.position(F.upper(base), F.lit("ACGT"))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def ordinal_base(ordinal: Column) -> Column:
    return F.substring(F.lit("ACGTN"), (F.least(ordinal, F.lit(4)) + 1).cast("int"), F.lit(1))


def has_unknown(seq: Column) -> Column:
    return seq.contains("N")


def first_unknown(seq: Column) -> Column:
    """Offset of the first N, or null."""
    at = F.instr(seq, "N")
    return F.when(at > 0, at - 1)


def at(seq: Column, i: int) -> Column:
    """Base at offset ``i``."""
    return F.substring(seq, i + 1, 1)


def hamming(a: Column, b: Column, width: int) -> Column:
    """Differing positions of two words of ``width`` bases."""
    return reduce(add, [(at(a, i) != at(b, i)).cast("int") for i in range(width)])


def shifted_distance(a: Column, b: Column, width: int) -> Column:
    """The least of shift + Hamming distance of the overlap, over shifts either way."""
    found = [hamming(a, b, width)]
    for s in range(1, width):
        part = width - s
        found.append(F.lit(s) + hamming(F.substring(a, s + 1, part), F.substring(b, 1, part), part))
        found.append(F.lit(s) + hamming(F.substring(b, s + 1, part), F.substring(a, 1, part), part))
    return F.least(*found)


def shifted_distance_rc(a: Column, b: Column, width: int) -> Column:
    """:func:`shifted_distance`, or that to the reverse complement if it is less."""
    return F.least(shifted_distance(a, b, width), shifted_distance(reverse_complement(a), b, width))


def close_seeds(a: Column, b: Column, width: int) -> Column:
    return shifted_distance_rc(a, b, width) <= F.floor(F.lit(width) / 3)


def word_ordinal(word: Column, width: int) -> Column:
    """The word as a number to base 4, first base least significant."""
    terms = [F.when(at(word, i) == "C", 1).when(at(word, i) == "G", 2).when(at(word, i) == "T", 3).otherwise(0).cast("long") * (4**i) for i in range(width)]
    return reduce(add, terms)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def odds_to_probability(r: Column) -> Column:
    return r / (1 + r)


def probability_to_odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def log_sum(x: Column, y: Column) -> Column:
    """ln(exp(x) + exp(y)), stable; a null is the logarithm of 0."""
    both = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
    return F.coalesce(both, x, y)


def log_difference(x: Column, y: Column) -> Column:
    """ln(exp(x) - exp(y)) for x > y; null where it is the logarithm of 0."""
    return F.when(y.isNull(), x).when(x > y, x + F.log1p(-F.exp(y - x)))


def x_log_y(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def footprint(pos: Column, word: Column) -> Column:
    """Half-open interval of a site."""
    return F.struct(pos.alias("start"), (pos + F.length(word)).alias("end"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases that two half-open intervals share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def words(seq: Column, width: int) -> Column:
    """All words of ``width`` bases, in order: one linear pass of a look-ahead."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{width}}}))"), F.lit(1))
