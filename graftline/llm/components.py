"""Problem 2: consolidate pairwise matches into groups.

``connected_components`` alternates the large-star and small-star rewrites (Kiveris et
al., "Connected components in MapReduce and beyond", 2014) over an edge table until an
iteration changes nothing. Every rewrite is one pre-aggregated minimum and one join, so
no adjacency list is ever gathered; the minima of hubs are broadcast (fewer than 1,000
nodes can hold over a thousandth of the edges), those of other nodes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.runtime import cut, skew_join


def large_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    """(u, v) with u < v becomes (m(u), v), m(u) being the least of u and its neighbours."""
    both = edges.select(F.col("u").alias("k"), F.col("v").alias("o"), F.lit(1).alias("one")).unionByName(edges.select(F.col("v").alias("k"), F.col("u").alias("o"), F.lit(0).alias("one")))
    minima = both.groupBy("k").agg(F.least(F.col("k"), F.min("o")).alias("m"), F.sum("one").cast("long").alias("n")).filter("n > 0")
    up = edges.select(F.col("u").alias("k"), F.col("v").alias("o"))
    return skew_join(up, minima, ["k"], total=total).select(F.col("m").alias("u"), F.col("o").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    """For each v, its smaller neighbours and v itself are linked to the least of them."""
    down = edges.select(F.col("v").alias("k"), F.col("u").alias("o"))
    minima = down.groupBy("k").agg(F.min("o").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = skew_join(down, minima, ["k"], total=total).filter("o <> m").select(F.col("m").alias("u"), F.col("o").alias("v"))
    return moved.unionByName(minima.select(F.col("m").alias("u"), F.col("k").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` of every node with at least one link to another node;
    ``component`` is the least node reachable.

    Null ends and loops link nothing; repeated and reversed links count once; an empty
    table gives an empty result; other columns are ignored. Any orderable type works.
    Each round is checkpointed, so a lost executor costs one round at most."""
    a, b = F.col(u), F.col(v)
    cur = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    cur = cut(cur)
    state = _state(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        #: a rewrite never adds edges, so their number bounds every key's rows
        cur = cut(small_star(large_star(cur, state[0]), state[0]))
        now = _state(cur)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return cur.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(cur.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def match_links(groups: DataFrame, regions: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """Links ``(u, v)`` that the match rows state: each member to the row's least member.

    ``similarity`` above 1 is read as per cent; null or NaN links nothing. Null and
    repeated members and members that are not in ``regions`` are left out; a row with
    fewer than two members left links nothing. The same match found again counts once."""
    sim = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    members = F.array_sort(F.array_distinct(F.filter("regions", lambda x: x.isNotNull())))
    rows = groups.filter(~F.isnan("similarity") & (sim >= min_similarity)).select(members.alias("ms")).filter(F.size("ms") > 1).distinct()
    each = rows.select(F.sha2(F.array_join(F.col("ms").cast("array<string>"), ","), 256).alias("match"), F.explode("ms").alias("v"))
    ids = regions.select(F.col("region_id").cast("long").alias("v")).filter("v is not null").distinct()
    there = each.join(ids, "v", "left_semi")
    least = there.groupBy("match").agg(F.min("v").alias("u"))
    return there.join(least, "match").filter("u <> v").select("u", "v")


def consolidate(groups: DataFrame, regions: DataFrame, min_similarity: float = 0.8) -> DataFrame:
    """``(region_id, component_id)`` of every region that a match links to another."""
    found = connected_components(match_links(groups, regions, min_similarity))
    return found.select(F.col("node").alias("region_id"), F.col("component").alias("component_id"))
