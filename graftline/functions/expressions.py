"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = "→"
VALUE_LENGTH = 50
#: Fixed values of the signature family: p, and the seed and factor of the coefficients.
P, SEED, FACTOR = 2**31 - 1, 20231, 48271


def leaf_value(text: str | Column) -> Column:
    """The value of a leaf: arrows, line feeds and tabs spelt out, then cut to 50 characters."""
    c = F.col(text) if isinstance(text, str) else text
    for a, b in ((ARROW, "->"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.substring(c, 1, VALUE_LENGTH)


def render(name: Column, value: Column) -> Column:
    """``name(value)``, or just the name where the value is null or empty."""
    return F.when(F.length(value) > 0, F.concat(name, F.lit("("), value, F.lit(")"))).otherwise(name)


def base_hash(text: str | Column) -> Column:
    """The first 32 bits of md5, read big-endian, modulo p."""
    c = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") % P


def coefficients(num_perm: int = 128) -> list[tuple[int, int]]:
    x, out = SEED, []
    for _ in range(num_perm):
        a = x = FACTOR * x % P
        b = x = FACTOR * x % P
        out.append((a, b))
    return out


def jaccard_estimate(a: str, b: str) -> Column:
    """Share of equal positions; signatures of empty sets (empty arrays) estimate 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.greatest(F.size(a), F.size(b)))


def overlaps(path_a: str, s_a: str, e_a: str, path_b: str, s_b: str, e_b: str) -> Column:
    """Two line ranges of one path that share a line."""
    return (F.col(path_a) == F.col(path_b)) & (F.col(s_a) <= F.col(e_b)) & (F.col(s_b) <= F.col(e_a))


def sarif_level(similarity: str = "similarity") -> Column:
    s = F.col(similarity)
    return F.when(s >= 0.95, "error").when(s >= 0.85, "warning").otherwise("note")


def lines(start: str = "start_line", end: str = "end_line") -> Column:
    return F.col(end) - F.col(start) + 1
