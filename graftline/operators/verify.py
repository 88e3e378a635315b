"""Order-sensitive verification of groups."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.expressions import lines
from graftline.operators.rules import Rule, anonymises_name
from graftline.runtime import settled, skew_join

GATED = ("function", "class", "method")
#: Variants of a group in one block of its pairs.
BLOCK = 128


def ordered_ratio(a: list, b: list) -> float:
    """Twice the matched elements over all elements; 0 if either list is empty."""
    if not len(a) or not len(b):
        return 0.0
    return SequenceMatcher(None, list(a), list(b), autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ordered_ratio(x.tolist() if x is not None else [], y.tolist() if y is not None else []) for x, y in zip(a, b)])


def ratio(a: str, b: str) -> Column:
    """The ordered ratio of two array columns; equal arrays never reach Python."""
    x, y = F.col(a), F.col(b)
    return F.when((F.size(x) <= 0) | (F.size(y) <= 0) | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(_ratio(x, y))


def content_lists(shingles: DataFrame) -> DataFrame:
    """``(region_id, contents)``: the list of each region in order, one entry per seq, the
    least of its contents. Rows are shuffled once, redeliveries collapse before."""
    per = shingles.filter("content is not null").groupBy("region_id").agg(F.array_sort(F.collect_set(F.struct("seq", "content"))).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | ~x["seq"].eqNullSafe(F.col("s")[F.greatest(i - 1, F.lit(0))]["seq"]))
    return per.select("region_id", F.transform(first, lambda x: x["content"]).alias("contents"))


def looked_up(lists: DataFrame, regions: DataFrame) -> DataFrame:
    """The lists by (path, start_line): of the regions that start on one line the last (by
    end line and id) gives its list to all; a region without any has null."""
    r = regions.select("region_id", "path", "start_line", "end_line").join(lists, "region_id")
    last = r.groupBy("path", "start_line").agg(F.max_by("contents", F.struct("end_line", "region_id")).alias("contents"))
    return regions.select("region_id", "path", "start_line").join(last, ["path", "start_line"], "left").select("region_id", "contents")


def signature_lines(regions: DataFrame, files: DataFrame) -> DataFrame:
    """``(region_id, signature)``: the stripped first source line of each region; null
    where the source is missing or too short, which counts as a match."""
    f = files.select(F.col("file_id").alias("tree_id"), F.split(F.decode("source", "ISO-8859-1"), "\n", -1).alias("ls"))
    line = F.try_element_at("ls", F.col("start_line"))
    return regions.select("region_id", "tree_id", "start_line").join(f, "tree_id", "left").select("region_id", F.regexp_replace(line, r"^\s+|\s+$", "").alias("signature"))


def names_checked(rules: list[Rule]) -> Column:
    """Whether a row's kind of region (``language``, ``region_type``) is one whose names no
    active rule replaces; a kind without a language is judged by the rules for all."""
    hidden = F.lit(False)
    named = sorted({x for r in rules for x in r.languages})
    for t in GATED:
        langs = [x for x in named if x != "*" and anonymises_name(rules, x, t)]
        always = anonymises_name([r for r in rules if "*" in r.languages], "*", t)
        hidden = hidden | ((F.col("region_type") == t) & (F.lit(True) if always else F.coalesce(F.col("language").isin(*langs), F.lit(False)) if langs else F.lit(False)))
    return F.coalesce(F.col("region_type").isin(*GATED) & ~hidden, F.lit(False))


def verified(members: DataFrame, lists: DataFrame, regions: DataFrame, signatures: DataFrame | None = None, rules: list[Rule] | None = None, gate: float = 0.98) -> DataFrame:
    """``(group_id, size, similarity)``: the mean ordered ratio over all member pairs.

    Members with one list (and, where names are checked, one signature line) are one class
    with a weight, so copies are compared once; lists are read for members only, and go on
    as digests but where classes of one group are compared. Pairs of classes are joined by group; a
    pair is taken in the order of path, start, end and class. A ratio of at least ``gate`` between
    functions, classes or methods whose first lines differ counts 0, unless the active
    rules replace both names."""
    #: which region gives its list to those that start on its line, as in ``looked_up``
    last = regions.select("region_id", "path", "start_line", "end_line").join(lists.select("region_id"), "region_id", "left_semi")
    last = last.groupBy("path", "start_line").agg(F.max_by("region_id", F.struct("end_line", "region_id")).alias("source"))
    m = settled(members.join(regions.select("region_id", "path", "start_line", "end_line", "region_type", "language"), "region_id").join(last, ["path", "start_line"], "left"))
    lists = settled(lists.join(m.select(F.col("source").alias("region_id")).filter("region_id is not null").distinct(), "region_id", "left_semi"))
    m = m.join(lists.select(F.col("region_id").alias("source"), F.sha2(F.to_json(F.struct("contents")), 256).alias("digest")), "source", "left")
    if signatures is not None:
        m = m.join(signatures, "region_id", "left").withColumn("named", F.coalesce(F.col("region_type").isin(*GATED), F.lit(False))).withColumn("checked", names_checked(rules or []))
    else:
        m = m.withColumn("signature", F.lit(None).cast("string")).withColumn("named", F.lit(False)).withColumn("checked", F.lit(False))
    key = F.sha2(F.to_json(F.struct(F.coalesce("digest", F.lit("")).alias("c"), F.when(F.col("named"), F.col("signature")).alias("s"), "named", "checked")), 256)
    c = m.withColumn("cls", key).groupBy("group_id", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("source"), F.first("signature").alias("sig"), F.first("named").alias("named"), F.first("checked").alias("checked"), F.min(F.struct("path", "start_line", "end_line", "cls")).alias("ord"))
    c = settled(c)
    #: a group's pairs of variants are spread over tasks: one side lies in blocks, the other meets each
    sizes = c.groupBy("group_id").agg(F.count(F.lit(1)).alias("_k"))
    blocks = F.greatest(F.ceil(F.col("_k") / F.lit(BLOCK)), F.lit(1)).cast("int")
    d = skew_join(c, sizes.filter("_k > 1"), ["group_id"], "_k").join(lists.withColumnRenamed("region_id", "source"), "source", "left")
    side = lambda d, s: d.select("group_id", "_block", *[F.col(k).alias(f"{k}_{s}") for k in ("n", "contents", "sig", "named", "checked", "ord")])
    x, y = side(d.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))), "a"), side(d.withColumn("_block", F.pmod(F.xxhash64("cls"), blocks).cast("int")), "b")
    p = x.join(y, ["group_id", "_block"]).filter("ord_a < ord_b").withColumn("r", ratio("contents_a", "contents_b"))
    differ = F.col("named_a") & F.col("named_b") & (F.col("checked_a") | F.col("checked_b")) & F.coalesce(F.col("sig_a") != F.col("sig_b"), F.lit(False))
    p = p.withColumn("r", F.when((F.col("r") >= gate) & differ, 0.0).otherwise(F.col("r")))
    across = p.groupBy("group_id").agg(F.sum(F.col("r") * F.col("n_a") * F.col("n_b")).alias("across"))
    inside = c.groupBy("group_id").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("source").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0)).alias("inside"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    mean = F.when(F.col("size") < 2, 1.0).otherwise((F.coalesce("across", F.lit(0.0)) + F.col("inside")) / pairs)
    return inside.join(across, "group_id", "left").select("group_id", "size", mean.alias("similarity"))


def long_groups(members: DataFrame, regions: DataFrame, min_lines: int) -> DataFrame:
    """Groups all of whose members have at least ``min_lines`` lines."""
    m = members.join(regions.select("region_id", "start_line", "end_line"), "region_id")
    return m.groupBy("group_id").agg(F.min(lines()).alias("least"), F.count(F.lit(1)).alias("size")).filter(F.col("least") >= min_lines).select("group_id", "size")
