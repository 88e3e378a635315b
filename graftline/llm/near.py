"""Problem 3: near-duplicate records, by fast similarity sketching, banding and exact
verification.

Records with equal sets become one class, so copies are never paired. Each class is
sketched and its bands become bucket keys. First every class of a bucket is compared with
one of them only, and the verified links are contracted; then just the pairs of a bucket
that lie in different components are compared. A bucket of any size that holds
one family costs one comparison per member, and no pair is lost by it: pairs that are
skipped have both ends in one component already. Buckets have no cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.buckets import near_in_buckets
from graftline.llm.components import connected_components
from graftline.llm.sketch import band_rows, bit_sketches
from graftline.operators.pairing import joining_pairs
from graftline.runtime import cut, latest, spread

#: 40 bands of 5 rows miss a pair of Jaccard similarity 0.7 in 0.06 % of cases, one of
#: 0.75 in 0.002 %, and meet a pair of 0.15 in 0.3 %.
BANDS, ROWS = 40, 5
MIN_SIZE, THRESHOLD = 8, 0.7


def token_sets(shingles: DataFrame, record: str = "region_id", value: str = "content", min_size: int = MIN_SIZE) -> DataFrame:
    """``(record, tokens, size)``: the sorted distinct 64-bit hashes of each record's
    non-null values; records with fewer than ``min_size`` are left out."""
    s = shingles.select(record, F.xxhash64(value).alias("h")).filter(F.col(value).isNotNull() & F.col(record).isNotNull())
    g = s.groupBy(record).agg(F.array_sort(F.collect_set("h")).alias("tokens"))
    return g.withColumn("size", F.size("tokens")).filter(F.col("size") >= min_size)


def classes(sets: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the members with their places.

    A class has its least member as ``cls``, the least and greatest path, and the members
    that end first and start last. ``places`` is (region_id, path, start_line, end_line);
    a record without a path overlaps nothing."""
    m = sets.join(places, "region_id", "left").withColumn("path", F.coalesce("path", F.concat(F.lit("\0"), F.col("region_id").cast("string"))))
    m = m.withColumn("sig", F.concat_ws(":", F.xxhash64("tokens"), F.xxhash64(F.lit("second"), "tokens"), "size"))
    m = cut(m.select("region_id", "sig", "tokens", "size", "path", F.coalesce("start_line", F.lit(0)).alias("s"), F.coalesce("end_line", F.lit(0)).alias("e")))
    ids = m.groupBy("sig").agg(
        F.min("region_id").alias("cls"), F.count(F.lit(1)).alias("members"), F.min("path").alias("lo"), F.max("path").alias("hi"),
        F.min_by(F.struct("region_id", "e"), F.struct("e", "region_id")).alias("first"), F.max_by(F.struct("region_id", "s"), F.struct("s", "region_id")).alias("last"),
        F.first("tokens").alias("tokens"), F.first("size").alias("size"),
    )
    return cut(ids), m.select("region_id", "sig", "path", "s", "e")


def verify(pairs: DataFrame, cls: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is at least ``threshold``, with
    ``strong``: the two classes span two paths, so all members are linked."""
    side = cls.select("cls", "tokens", "size", "lo", "hi")
    left = side.toDF("a", "ta", "na", "la", "ha")
    right = side.toDF("b", "tb", "nb", "lb", "hb")
    j = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    j = j.filter(F.col("i") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("i")) - 1e-9)
    return j.select("a", "b", (F.least("la", "lb") != F.greatest("ha", "hb")).alias("strong"))


def near_class_pairs(cls: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = 0, rounds: int = 1) -> DataFrame:
    """Verified (a, b, strong) pairs of classes that join all near classes: every pair,
    but those whose ends a chain of strong pairs already joins. Sizes travel with the
    buckets, so pairs of too different ones never fetch their tokens. Where classes of one
    bucket are often alike but not near, bit sketches of ``words`` numbers tell most of them
    apart, the others are compared where the bucket lies (``buckets``), and more ``rounds``
    leave fewer components for the last look."""
    buckets = cut(spread(cls.select("cls", "size", "tokens")).mapInArrow(band_rows(["cls", "size"], bands, rows), "cls long, size int, bucket long"))
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9
    schema = ", ".join(["cls long", "tokens array<long>", *(f"b{w} long" for w in range(words))])

    def last(rows: DataFrame) -> DataFrame:
        pairs = near_in_buckets(rows, spread(cls.select("cls", "tokens")).mapInArrow(bit_sketches(["cls"], words), schema), threshold, words)
        low, high = (cls.select(F.col("cls").alias(x), F.col("lo").alias(f"l{x}"), F.col("hi").alias(f"h{x}")) for x in "ab")
        return pairs.join(low, "a").join(high, "b").select("a", "b", (F.least("la", "lb") != F.greatest("ha", "hb")).alias("strong"))

    return joining_pairs(buckets, lambda p: verify(p, cls, threshold), lambda e: connected_components(e, "a", "b"), fits, rounds, last=last if words else None)


def near_duplicates(shingles: DataFrame, regions: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(region_id, group_id)`` of every region near another one, ``group_id`` being the
    least region reachable through near regions.

    Near means a Jaccard similarity of the sets of distinct non-null contents of at least
    ``threshold``, unless both lie in one path and share a line; sets under ``min_size``
    are left out. Redelivered rows change nothing; a region missing from ``regions`` has
    no path, so overlaps none; an empty table gives no row; extra columns are ignored."""
    places = latest(regions.select("region_id", "path", "start_line", "end_line", F.lit(None).cast("timestamp").alias("_t")), ["region_id"], "_t").drop("_t")
    cls, members = classes(token_sets(shingles, min_size=min_size), places)
    pairs = cut(near_class_pairs(cls, threshold, bands, rows))
    one = F.col("lo") == F.col("hi")
    #: classes all of whose members are linked: to one another or through a strong pair
    whole = cls.filter(~one).select("cls").unionByName(pairs.filter("strong").select(F.explode(F.array("a", "b")).alias("cls"))).distinct()
    at = members.join(cls.select("sig", "cls", "members"), "sig").select("region_id", "cls", "path", "s", "e", "members")
    inner = at.join(whole, "cls", "left_semi").select(F.col("cls").alias("u"), F.col("region_id").alias("v"))
    strong = pairs.filter("strong").select(F.col("a").alias("u"), F.col("b").alias("v"))
    #: within one path, the other class's first-ending and last-starting members stand for
    #: all: whoever is disjoint from any member is disjoint from one of these two
    weak = pairs.filter("not strong").select("a", "b")
    ways = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cls.filter(one & (F.col("members") > 1)).select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    ends = ways.join(cls.select(F.col("cls").alias("b"), "first", "last"), "b")
    near = at.join(ends, F.col("cls") == F.col("a"))
    side = near.filter(F.col("first.e") < F.col("s")).select(F.col("region_id").alias("u"), F.col("first.region_id").alias("v"))
    side = side.unionByName(near.filter(F.col("last.s") > F.col("e")).select(F.col("region_id").alias("u"), F.col("last.region_id").alias("v")))
    found = connected_components(inner.unionByName(strong).unionByName(side))
    return found.select(F.col("node").alias("region_id"), F.col("component").alias("group_id"))
