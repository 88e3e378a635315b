"""Line and character diffs of two regions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.runtime import skew_join

OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))


def opcodes(a, b) -> list[tuple[str, int, int, int, int]]:
    return [tuple(x) for x in SequenceMatcher(None, a, b).get_opcodes()]


@F.pandas_udf(OPCODES)
def line_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [dict(zip(("tag", "i1", "i2", "j1", "j2"), o)) for o in opcodes(list(x), list(y))] for x, y in zip(a, b)])


@F.pandas_udf(OPCODES)
def char_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes inside a pair of replaced lines, for highlighting."""
    return pd.Series([None if x is None or y is None else [dict(zip(("tag", "i1", "i2", "j1", "j2"), o)) for o in opcodes(x, y)] for x, y in zip(a, b)])


def region_lines(regions: DataFrame, files: DataFrame) -> DataFrame:
    """``(region_id, lines)``: each region's source lines; null where there is no source."""
    f = files.select(F.col("file_id").alias("tree_id"), F.split(F.decode("source", "ISO-8859-1"), "\n", -1).alias("ls"))
    return regions.select("region_id", "tree_id", "start_line", "end_line").join(f, "tree_id", "left").select("region_id", F.slice("ls", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))).alias("lines"))


def identical(ops: str) -> Column:
    """Whether the opcodes are one equal block (or none: both sides empty)."""
    return (F.size(ops) == 0) | ((F.size(ops) == 1) & (F.element_at(F.col(ops), 1)["tag"] == "equal"))


def group_diffs(members: DataFrame, regions: DataFrame, files: DataFrame, texts: bool = False) -> DataFrame:
    """``(group_id, a, b, ops, identical)`` of each group's first two members, with their
    lines ``la`` and ``lb`` if ``texts``."""
    #: the two least by aggregation, so that no group has to be sorted in one task
    order = F.struct("path", "start_line", "end_line", "region_id")
    m = members.join(regions.select("region_id", "path", "start_line", "end_line"), "region_id")
    first = m.groupBy("group_id").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n"))
    rest = skew_join(m, first, ["group_id"]).filter(order != F.col("x")).groupBy("group_id").agg(F.min(order).alias("y"))
    both = first.join(rest, "group_id", "left").select("group_id", F.col("x.region_id").alias("a"), F.coalesce("y.region_id", "x.region_id").alias("b"))
    text = region_lines(regions, files)
    d = both.join(text.toDF("a", "la"), "a").join(text.toDF("b", "lb"), "b")
    same = F.col("la") == F.col("lb")
    whole = F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("i1"), F.size("la").alias("i2"), F.lit(0).alias("j1"), F.size("lb").alias("j2")))
    d = d.withColumn("ops", F.when(same, whole).otherwise(line_opcodes("la", "lb")))
    return d.select("group_id", "a", "b", "ops", identical("ops").alias("identical"), *(["la", "lb"] if texts else []))


def side_by_side(a: list[str], b: list[str], width: int = 120) -> list[str]:
    """Two columns of lines with a mark between: blank, ``|``, ``<`` or ``>``; long lines
    are cut to their column."""
    w = max(10, (width - 3) // 2)
    fit = lambda s: (s if len(s) <= w else s[: w - 1] + "…").ljust(w)
    out = []
    for tag, i1, i2, j1, j2 in opcodes(a, b):
        for k in range(max(i2 - i1, j2 - j1)):
            x = a[i1 + k] if i1 + k < i2 else None
            y = b[j1 + k] if j1 + k < j2 else None
            mark = " " if tag == "equal" else "<" if y is None else ">" if x is None else "|"
            out.append(f"{fit(x or '')} {mark} {fit(y or '')}".rstrip())
    return out
