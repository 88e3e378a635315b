"""Candidate pairs by banding, edges, groups and their mean similarity."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.expressions import jaccard_estimate, lines
from graftline.operators.components import connected_components
from graftline.operators.pairing import bucket_pairs, joining_pairs, overlapping
from graftline.runtime import cut, settled
from graftline.settings import Settings


@lru_cache
def band_shape(threshold: float, num_perm: int = 128, step: float = 0.001) -> tuple[int, int]:
    """Bands and rows with the least equally weighted area of false positives below and
    false negatives above the threshold."""
    best = None
    grid = [step * (i + 0.5) for i in range(round(1 / step))]
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            hit = [1 - (1 - s**r) ** b for s in grid]
            wrong = step * (sum(p for s, p in zip(grid, hit) if s < threshold) + sum(1 - p for s, p in zip(grid, hit) if s >= threshold)) / 2
            if best is None or wrong < best[0]:
                best = (wrong, b, r)
    return best[1], best[2]


#: Shapes for 128 permutations, as ``band_shape`` finds them.
SHAPES = {0.5: (25, 5), 0.49: (25, 5), 0.35: (32, 4), 0.21: (25, 2)}


def shape(threshold: float, num_perm: int = 128) -> tuple[int, int]:
    key = round(threshold, 4)
    return SHAPES[key] if num_perm == 128 and key in SHAPES else band_shape(key, num_perm, 0.005)


def bands(signatures: DataFrame, b: int, r: int) -> DataFrame:
    """``(region_id, band, bucket)``; empty signatures have no band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice("sig", i * r + 1, F.lit(r)).cast("array<string>"), ",")).alias("bucket")))
    return signatures.filter(F.size("sig") >= b * r).select("region_id", F.explode(keys).alias("k")).select("region_id", "k.band", "k.bucket")


def classes(signatures: DataFrame) -> DataFrame:
    """``(region_id, rep)``: regions of equal signatures share the least as representative,
    so that copies are never paired with one another."""
    s = signatures.filter(F.size("sig") > 0).select("region_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("same"))
    reps = s.groupBy("same").agg(F.min("region_id").alias("rep"))
    return s.join(reps, "same").select("region_id", "rep")


def representatives(signatures: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The signatures of the classes' representatives; ``of`` are the classes, if known."""
    of = classes(signatures) if of is None else of
    return signatures.join(of.filter("region_id = rep").select("region_id"), "region_id", "left_semi")


def _buckets(reps: DataFrame, threshold: float) -> DataFrame:
    return bands(reps, *shape(threshold)).select("region_id", F.xxhash64("band", "bucket").alias("bucket"))


def candidates(signatures: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of class representatives that share a bucket; large
    buckets are paired in blocks. ``classes`` has the members."""
    return bucket_pairs(_buckets(representatives(signatures), threshold))


def _partners(pairs: DataFrame, members: DataFrame, alias: str) -> DataFrame:
    """``(region_id, rep, alias)``: of each member, the regions that ``pairs`` of classes
    and its own class pair it with, without writing out a pair of regions."""
    size = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    per = both.join(size.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("m"))
    whole = size.join(per, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias(alias))
    return members.join(whole, "rep").select("region_id", "rep", alias)


def candidate_counts(signatures: DataFrame, threshold: float) -> DataFrame:
    """``(region_id, rep, n_candidates)``: how many other regions share a bucket with each
    region that has a signature; regions of one class share all of theirs."""
    members = classes(signatures.filter(F.size("sig") >= shape(threshold)[0] * shape(threshold)[1]))
    return _partners(candidates(signatures, threshold), members, "n_candidates")


def link_counts(signatures: DataFrame, regions: DataFrame, settings: Settings) -> DataFrame:
    """``(region_id, rep, n_links)``: how many other regions each region forms a pair with:
    candidates whose estimate reaches the pair threshold and that share no line with it.

    Counted per class; what overlaps is taken off one by one, since few ranges of a path
    share a line. Regions without a signature or a place form no pair."""
    placed = regions.select("region_id", "path", "start_line", "end_line").filter("path is not null and start_line is not null and end_line is not null")
    own = cut(classes(signatures).join(placed.select("region_id"), "region_id", "left_semi"))
    near = cut(verified(signatures, settings))
    whole = _partners(near, own, "n_links")
    x, y = own.toDF("a", "ra"), own.toDF("b", "rb")
    over = overlapping(placed).join(x, "a").join(y, "b")
    pair = near.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    alike = over.filter("ra = rb").unionByName(over.filter("ra <> rb").join(pair, (F.least("ra", "rb") == F.col("lo")) & (F.greatest("ra", "rb") == F.col("hi")), "left_semi"))
    off = alike.select(F.explode(F.array("a", "b")).alias("region_id")).groupBy("region_id").agg(F.count(F.lit(1)).alias("off"))
    return whole.join(off, "region_id", "left").select("region_id", "rep", (F.col("n_links") - F.coalesce("off", F.lit(0))).alias("n_links")).filter("n_links > 0")


def estimated(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs with the similarity that their signatures estimate."""
    x = signatures.select(F.col("region_id").alias("a"), F.col("sig").alias("sig_a"))
    y = signatures.select(F.col("region_id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", jaccard_estimate("sig_a", "sig_b").alias("estimate"))


def verified(signatures: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, estimate) of representatives whose estimate reaches the pair threshold."""
    return estimated(candidates(signatures, settings.lsh_threshold), signatures).filter(F.col("estimate") >= settings.pair_threshold)


def _low_bits(num_perm: int) -> Column:
    """The lowest two bits of each value of a signature, as two planes of 64-bit words; null
    for signatures of another length."""
    plane = lambda bit, at: F.aggregate(F.slice("sig", at + 1, F.lit(64)), F.lit(0).cast("long"), lambda w, x: F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(x.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))))
    words = [F.struct(plane(0, at).alias("x"), plane(1, at).alias("y")) for at in range(0, num_perm, 64)]
    return F.when(F.size("sig") == num_perm, F.array(*words))


def _can_agree(a: Column, b: Column, num_perm: int, threshold: float) -> Column:
    """Whether an estimate can reach the threshold: values that differ in their lowest two
    bits differ, and no more than the rest may."""
    words = [F.bit_count(a[w]["x"].bitwiseXOR(b[w]["x"]).bitwiseOR(a[w]["y"].bitwiseXOR(b[w]["y"]))) for w in range(-(-num_perm // 64))]
    return F.coalesce(sum(words[1:], words[0]) <= F.lit(num_perm * (1 - threshold) + 1e-6), F.lit(True))


def joining(reps: DataFrame, by_path: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, estimate) of near classes, given their representatives, that join them all. Two classes that span two paths
    together are wholly linked, so such pairs are contracted before the last look. Pairs of
    a bucket whose signatures' lowest bits differ too often never leave it."""
    paths = settled(by_path.groupBy("rep").agg(F.min("path").alias("lo"), F.max("path").alias("hi")))
    side = lambda s: paths.select(F.col("rep").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))

    def verify(pairs: DataFrame) -> DataFrame:
        e = estimated(pairs, reps).filter(F.col("estimate") >= settings.pair_threshold)
        return e.join(side("a"), "a").join(side("b"), "b").select("a", "b", "estimate", (F.least("lo_a", "lo_b") != F.greatest("hi_a", "hi_b")).alias("strong"))

    n = settings.num_perm
    at = bands(reps.withColumn("region_id", F.struct("region_id", _low_bits(n).alias("bits"))), *shape(settings.lsh_threshold))
    buckets = at.select(F.col("region_id.region_id").alias("cls"), F.col("region_id.bits").alias("size"), F.xxhash64("band", "bucket").alias("bucket"))
    fits = lambda a, b: _can_agree(a, b, n, settings.pair_threshold)
    return settled(joining_pairs(settled(buckets), verify, connected_components, fits, keep=settled)).select("a", "b", "estimate")


def _apart(x: Column, y: Column) -> Column:
    """Two places that share no line; an unknown place is apart from none."""
    return F.coalesce((x["path"] != y["path"]) | (x["start_line"] > y["end_line"]) | (y["start_line"] > x["end_line"]), F.lit(False))


def _linked(x: Column, ys: Column) -> Column:
    """Pairs (a, b), a < b, of a place with those places that are apart from it."""
    pair = lambda y: F.struct(F.least(x["region_id"], y["region_id"]).alias("a"), F.greatest(x["region_id"], y["region_id"]).alias("b"))
    return F.transform(F.filter(ys, lambda y: _apart(x, y)), pair)


def links(signatures: DataFrame, regions: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, estimate) of similar regions that do not overlap, with the components of all
    such pairs. Classes are paired by stars and contraction (``joining_pairs``); copies
    link to their class.

    Three anchors stand for a class: of one path, the member that ends first and the one
    that starts last, and a member of another path. A region that is apart from any member
    is apart from an anchor, and anchors that are apart belong together with all members
    but the loose ones: those of a class within one path that overlap every other member."""
    of = settled(classes(signatures))
    m = settled(of.join(regions.select("region_id", F.struct("region_id", "path", "start_line", "end_line").alias("at")), "region_id").filter("at.path is not null"))
    order = lambda c: F.struct(F.col(f"at.{c}").isNull(), F.col(f"at.{c}"), F.col("region_id"))
    by_path = m.groupBy("rep", F.col("at.path").alias("path")).agg(
        F.min_by("at", order("end_line")).alias("first"), F.max_by("at", F.struct("at.start_line", "region_id")).alias("last"),
        F.max(F.when(F.col("region_id") == F.col("rep"), F.col("at"))).alias("own"), F.count(F.lit(1)).alias("n"))
    ends = F.struct("path", "first", "last")
    cls = by_path.groupBy("rep").agg(F.min(ends).alias("x"), F.max(ends).alias("y"), F.max("own").alias("own"), F.sum("n").alias("n"))
    cls = settled(cls.select("rep", F.array_distinct(F.array("x.first", "x.last", "y.first")).alias("anchors"), "own", ((F.col("x.path") == F.col("y.path")) & (F.col("n") > 1)).alias("within")))

    near = lambda x, ys: F.exists(ys, lambda y: _apart(x, y))
    single = m.join(cls.filter("within").select("rep", "anchors"), "rep").filter(~near(F.col("at"), F.col("anchors")))
    pieces = cls.join(single.groupBy("rep").agg(F.collect_set("at").alias("loose")), "rep", "left")
    pieces = pieces.select("rep", "anchors", "own", F.array_union("anchors", F.coalesce("loose", F.array().cast(pieces.schema["anchors"].dataType))).alias("all"), F.col("loose").isNull().alias("whole"))

    same = m.join(cls.select("rep", "anchors", "own"), "rep").filter("region_id <> rep")
    same = same.select(F.explode(F.when(_apart(F.col("at"), F.col("own")), _linked(F.col("at"), F.array("own"))).otherwise(_linked(F.col("at"), F.col("anchors")))).alias("p"), F.lit(1.0).alias("estimate"))
    side = lambda s: pieces.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("anchors", "own", "all", "whole")])
    j = joining(settled(representatives(signatures, of)), by_path, settings).join(side("a"), "a").join(side("b"), "b")
    c = F.col
    every = F.flatten(F.array(F.flatten(F.transform("all_a", lambda x: _linked(x, c("anchors_b")))), F.flatten(F.transform("all_b", lambda x: _linked(x, c("anchors_a"))))))
    own = _linked(c("own_a"), F.array("own_b"))
    plain = _apart(c("own_a"), c("own_b")) & c("whole_a") & c("whole_b")
    near_pairs = j.select(F.explode(F.when(plain, own).otherwise(F.array_distinct(F.concat(F.when(_apart(c("own_a"), c("own_b")), own).otherwise(F.slice(every, 1, 0)), every)))).alias("p"), "estimate")
    return same.distinct().unionByName(near_pairs).select("p.a", "p.b", "estimate")


def groups(edge_table: DataFrame) -> DataFrame:
    """``(region_id, group_id)``: components of the edges; only linked regions appear."""
    return connected_components(edge_table, "a", "b").select(F.col("node").alias("region_id"), F.col("component").alias("group_id"))


def group_means(members: DataFrame, signatures: DataFrame, num_perm: int = 128) -> DataFrame:
    """``(group_id, size, similarity)``: the mean estimate over all pairs of members, also
    those that are no candidates or overlap, without forming a pair: at each position the
    agreeing pairs are the pairs of members with one value. Groups of one have 1."""
    m = members.join(signatures, "region_id")
    size = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    at = m.select("group_id", F.posexplode("sig").alias("pos", "value")).groupBy("group_id", "pos", "value").agg(F.count(F.lit(1)).alias("n"))
    agree = at.groupBy("group_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("agree"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    mean = F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("agree", F.lit(0.0)) / (pairs * num_perm))
    return size.join(agree, "group_id", "left").select("group_id", "size", mean.alias("similarity"))


def similar_groups(signatures: DataFrame, regions: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Groups whose mean estimate reaches 0.8 of the similarity, and their members."""
    members = groups(links(signatures, regions, settings))
    kept = group_means(members, signatures, settings.num_perm).filter((F.col("similarity") >= settings.pair_threshold) & (F.col("size") >= 2))
    return kept, members.join(kept.select("group_id"), "group_id", "left_semi").select("group_id", "region_id")


def long_enough(regions: DataFrame, min_lines: int) -> DataFrame:
    return regions if min_lines <= 1 else regions.filter(lines() >= min_lines)


def candidate_pair_count(group_sizes: DataFrame) -> DataFrame:
    n = F.col("size")
    return group_sizes.agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("candidate_pairs"))
