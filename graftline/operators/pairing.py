"""Pairs of records that share a bucket, found without pairing whole buckets, and pairs of
line ranges that overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.runtime import cut, skew_join

#: Members of a bucket that one task compares with all of the bucket.
BLOCK = 2000
#: Lines of one block of a path, in which overlapping ranges meet.
LINES = 64


def _halves(rows: DataFrame, n: Column, id_: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a bucket's self-join, split into blocks: the left side is repeated for
    every block, the right side lies in one, so no task gets a large bucket whole."""
    k = F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("int")
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), k - 1)))
    return left, rows.withColumn("_block", F.pmod(F.xxhash64(id_), k).cast("int"))


def bucket_pairs(buckets: DataFrame, id_: str = "region_id", key: str = "bucket", block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of records that share a bucket."""
    sizes = buckets.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left, right = _halves(skew_join(buckets, sizes, [key]), F.col("n"), id_, block)
    x, y = left.select(key, "_block", F.col(id_).alias("a")), right.select(key, "_block", F.col(id_).alias("b"))
    return x.join(y, [key, "_block"]).filter("a < b").select("a", "b").distinct()


def joining_pairs(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    components: Callable[[DataFrame], DataFrame],
    fits: Callable[[Column, Column], Column] | None = None,
    rounds: int = 1,
    block: int = BLOCK,
    last: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """Verified pairs that join all near records: every pair of a common bucket, but those
    whose ends a chain of ``strong`` pairs already joins.

    ``buckets`` is (cls, size, bucket); ``verify`` turns pairs (a, b) into those that are
    near, with ``strong``; ``components`` gives (node, component) of pairs. In each round the
    members of a bucket are compared with one of them, and the strong pairs are contracted;
    only members of different components meet in the last look. ``fits`` tells by the sizes,
    or whatever a column of that name holds, whether a pair can be near. ``last`` does the last look itself: it gives the verified
    pairs of (bucket, cls, size, comp, n, weight) rows, of a bucket's classes and sizes in all;
    buckets of two were looked at whole in a round. ``keep`` ends the plan of what is read
    again."""
    fits = fits or (lambda x, y: F.lit(True))
    many = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keep(skew_join(buckets, many, ["bucket"]).withColumn("comp", F.col("cls")))
    found: DataFrame | None = None
    for turn in range(rounds):
        rank = F.struct((F.xxhash64("cls", F.lit(turn)) if turn else F.col("cls")).alias("rank"), "cls", "size", "comp")
        one = met.groupBy("bucket").agg(F.min(rank).alias("r"), F.max("n").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
        one = one.select("bucket", "n", F.col("r.cls").alias("a"), F.col("r.size").alias("na"), F.col("r.comp").alias("ca"))
        stars = skew_join(met.drop("n"), one, ["bucket"]).filter((F.col("ca") != F.col("comp")) & fits(F.col("na"), F.col("size")))
        stars = stars.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
        more = verify(stars if found is None else stars.join(found.select("a", "b"), ["a", "b"], "left_anti"))
        found = keep(more if found is None else found.unionByName(more))
        comp = components(found.filter("strong").select("a", "b")).withColumnRenamed("node", "cls")
        met = keep(met.drop("comp").join(comp, "cls", "left").select("bucket", "cls", "size", "n", F.coalesce("component", "cls").alias("comp")))
    #: a bucket needs a last look, at all its pairs, only if it still holds two components
    mixed = met.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *([F.sum("size").alias("weight")] if last else []), F.max("n").alias("n")).filter("x <> y")
    if last:
        return found.unionByName(last(met.drop("n").join(mixed.filter("n > 2").select("bucket", "n", "weight"), "bucket")))
    open_ = met.join(mixed.select("bucket"), "bucket", "left_semi")
    left, right = _halves(open_, F.col("n"), "cls", block)
    name = lambda d, s: d.select("bucket", "_block", F.col("cls").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in d.columns if c not in ("bucket", "_block", "cls", "n")])
    rest = name(left, "a").join(name(right, "b"), ["bucket", "_block"])
    rest = rest.filter((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & fits(F.col("a_size"), F.col("b_size")))
    rest = rest.select("a", "b").distinct()
    rest = rest.join(found.select("a", "b"), ["a", "b"], "left_anti")
    return found.unionByName(verify(rest))


def overlapping(regions: DataFrame, lines: int = LINES) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``(region_id, path, start_line, end_line)`` that
    share a line of one path. Ranges meet in blocks of lines, so a path of many ranges is
    no pairing of all of them; each pair is taken in the block of its later start. A range
    without a path or a line, or one that ends before it starts, overlaps none."""
    at = lambda c: F.floor(F.col(c) / F.lit(lines))
    r = regions.select("region_id", "path", "start_line", "end_line").filter("path is not null and start_line <= end_line")
    r = r.withColumn("_block", F.explode(F.sequence(at("start_line"), at("end_line"))))
    x = r.select("path", "_block", F.col("region_id").alias("a"), F.col("start_line").alias("sa"), F.col("end_line").alias("ea"))
    y = r.select("path", "_block", F.col("region_id").alias("b"), F.col("start_line").alias("sb"), F.col("end_line").alias("eb"))
    late = F.floor(F.greatest("sa", "sb") / F.lit(lines))
    j = x.join(y, ["path", "_block"]).filter((F.col("a") < F.col("b")) & (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea")) & (F.col("_block") == late))
    return j.select("a", "b").distinct()
