"""Column expressions. Random numbers are hashes of a key, so they don't depend on partitioning and have a twin in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the range of draw().
DRAWS = 1 << 52


def draw(*key: Column | str | int) -> Column:
    """A number in [0, 2^52) from the key's parts; strings are constants, as are numbers."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")


def bit_length(x: Column) -> Column:
    """Bits of a number in [0, 2^52): the binary logarithm, put right where rounding takes it over or under a power of two."""
    guess = F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double"))).cast("int")
    power = F.expr("1L").cast("bigint")
    return F.when(x == 0, 0).when(F.call_function("shiftleft", power, guess) > x, guess).when(F.call_function("shiftleft", power, guess + 1) <= x, guess + 2).otherwise(guess + 1)


def tree_distance(a: Column, b: Column) -> Column:
    """Height at which two leaves of a binary tree meet: the bit length of their XOR."""
    return bit_length(a.bitwiseXOR(b))


def pair_distance(z1: Column, z2: Column, dims: int) -> Column:
    """Mean tree distance of two coordinate arrays of dims numbers.

    A sum over a zipped array: unrolled over the dimensions it makes a method beyond the size that Java compiles, and takes three times as long.
    """
    bits = lambda a, b: F.when(a == b, 0).otherwise(F.length(F.bin(a.bitwiseXOR(b))))
    total = F.aggregate(F.zip_with(z1, z2, bits), F.lit(0), lambda s, v: s + v)
    return total / F.lit(float(dims))


def link_probability(distance: Column, deg1: Column, deg2: Column, alpha: float, gamma: float, eps: float = 1e-5) -> Column:
    """1 / (1 + ((D + eps) / ln((deg1 + 1)(deg2 + 1)))^gamma / alpha), and 0 where both degrees are 0."""
    prod = (deg1 + 1).cast("double") * (deg2 + 1).cast("double")
    safe = F.when(prod > 1, F.log(prod))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.pow((distance + F.lit(eps)) / safe, F.lit(float(gamma))) / F.lit(float(alpha))), F.lit(0.0))


#: Probability that a training term wants to be high, from those of the pair as an edge and as the opposite edge.
SELECTORS = {
    "out": lambda p12, p21: p12,
    "in": lambda p12, p21: p21,
    "not_out": lambda p12, p21: 1 - p12,
    "not_in": lambda p12, p21: 1 - p21,
    "neither": lambda p12, p21: (1 - p12) * (1 - p21),
}


def selected(key: str, p12, p21):
    """SELECTORS for columns or arrays."""
    if key not in SELECTORS:
        raise ValueError(f"one of {sorted(SELECTORS)}, not {key}")
    return SELECTORS[key](p12, p21)


def log_loss(p: Column, eps: float = 1e-5) -> Column:
    return -F.log(p + F.lit(eps))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one of them is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
