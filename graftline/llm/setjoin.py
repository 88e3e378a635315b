"""Problem 6: all similar pairs between set-valued records, by chosen-path splitting.

Each tree starts with all records in one node. A node at depth d is split by tokens: a
record of n tokens enters the child of token x, which its path has not used yet, where
hash(node, x) < 1 / (threshold * n - d), so a pair at the threshold shares one child or
more on average at every level (Christiani, Pagh, Sivertsen, "Scalable and robust set
similarity join", 2018). A node is compared whole as soon as it holds few pairs, or when
splitting would not lessen them; until then it is split again, however deep that leads.
Trees are added until their number gives the recall wanted at the depth reached.

Only (record, node) numbers are shuffled and written; tokens stay with their records, whose
splits are numpy over Arrow batches. Bit sketches pass over the clearly different pairs,
and the rest is verified exactly. Records with equal sets are one record until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm.near import token_sets
from graftline.llm.sketch import bit_sketches, bits_differ, flatten, mix
from graftline.runtime import bounded, cut, spread

WORDS, RECALL = 4, 0.99999
#: Pairs of a node that is compared whole, and pairs that one block of a larger one holds.
SMALL, BLOCK = 50_000, 1_000_000
#: Node numbers that are broadcast to prune the other side before its rows are written.
NODES = 1_000_000
_U = np.uint64
STATE = "id long, parent long, node long, path array<long>"


def trees_for(recall: float, depth: int) -> int:
    """Trees after which a pair at the threshold is met with probability ``recall``. The
    worst such pair shares a Poisson(1) number of children per level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def _children(threshold: float, roots: list[int] | None):
    """A ``mapInArrow`` function: (id, tokens[, nodes, paths]) to the children's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                tokens, owner = flatten(b.column(1))
                v, size = tokens.astype(np.int64).view(_U), np.bincount(owner, minlength=b.num_rows)
                first = np.cumsum(size) - size
                if roots is None:
                    node, row = flatten(b.column(2))
                    node = node.astype(np.int64).view(_U)
                    path = b.column(3).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U).reshape(len(row), -1)
                else:
                    node, row = np.tile(mix(np.array(roots, np.int64).view(_U)), b.num_rows), np.repeat(np.arange(b.num_rows), len(roots))
                    path = np.zeros((len(row), 0), _U)
                d = path.shape[1]
                n = size[row]
                entry = np.repeat(np.arange(len(row)), n)
                #: the k-th token of an entry's record, for all entries one behind the other
                x = v[np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + first[row][entry]]
                with np.errstate(over="ignore"):
                    h = mix(node[entry] ^ mix(x + _U(0x9E3779B97F4A7C15)))
                pick = (h >> _U(11)).astype(np.float64) * 2.0**-53 * (threshold * n - d)[entry] < 1.0
                for k in range(d):
                    pick &= x != path[entry, k]
                e = entry[pick]
                trail = np.concatenate([path[e], x[pick][:, None]], axis=1).view(np.int64)
                offsets = pa.array((np.arange(len(e) + 1) * (d + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row[e])), pa.array(node[e].view(np.int64)), pa.array(h[pick].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(trail.reshape(-1)))],
                    names=["id", "parent", "node", "path"],
                )

    return run


def _split(sets: DataFrame, state: DataFrame | None, threshold: float, roots: list[int] | None) -> DataFrame:
    """The children's rows of the roots, or of the nodes in ``state``."""
    if state is None:
        return sets.select("id", "tokens").mapInArrow(_children(threshold, roots), STATE)
    per = state.groupBy("id").agg(F.collect_list(F.struct("node", "path")).alias("s"))
    j = sets.select("id", "tokens").join(per, "id").select("id", "tokens", F.col("s.node").alias("nodes"), F.col("s.path").alias("paths"))
    return j.mapInArrow(_children(threshold, None), STATE)


def _bits() -> list[str]:
    return [f"b{w}" for w in range(WORDS)]


def _prepare(sets: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sets with their sketches, and ``(id, member)``: all records of each."""
    s = cut(sets.select(F.col(record).alias("member"), "size", "tokens", F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit("second"), "tokens").alias("s2")))
    ids = s.groupBy("s1", "s2").agg(F.min("member").alias("id"))
    named = s.join(ids, ["s1", "s2"])
    schema = "id long, size int, tokens array<long>, " + ", ".join(f"{b} long" for b in _bits())
    one = named.filter("member = id").select("id", "size", "tokens").dropDuplicates(["id"])
    return cut(spread(one).mapInArrow(bit_sketches(["id", "size"], WORDS), schema)), named.select("id", "member")


def _grow(L: DataFrame, R: DataFrame | None, threshold: float, roots: list[int], small: int) -> tuple[list[tuple[DataFrame, DataFrame, DataFrame]], int]:
    """The nodes to compare whole as (node and work, left rows, right rows) per level, and
    the greatest depth among them."""
    leaves: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    a = b = before = None
    depth = level = 0
    while True:
        level += 1
        up_a, up_b = a, b
        a = cut(_split(L, up_a, threshold, roots))
        count = lambda s, n: s.groupBy("node").agg(F.count(F.lit(1)).alias(n), F.first("parent").alias("parent"))
        if R is None:
            size = count(a, "n").filter("n > 1").select("node", "parent", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("work"))
        else:
            na, _ = bounded(count(a, "na"), NODES)
            #: nodes that only one side reaches are dropped before they are written
            b = cut(_split(R, up_b, threshold, roots).join(na.select("node"), "node", "left_semi"))
            size = na.join(count(b, "nb").drop("parent"), "node").select("node", "parent", (F.col("na") * F.col("nb")).alias("work"))
        size = cut(size)
        if before is not None:
            #: nodes whose children hold no fewer pairs are compared whole
            kids = size.groupBy(F.col("parent").alias("node")).agg(F.sum("work").alias("below"))
            stuck = cut(before.join(kids, "node").filter(F.col("below") > 0.8 * F.col("work")).select("node", "work"))
            if stuck.limit(1).count():
                leaves.append((stuck, up_a, up_b))
                size = cut(size.join(stuck.select(F.col("node").alias("parent")), "parent", "left_anti"))
        few = size.filter(F.col("work") <= small).select("node", "work")
        if few.limit(1).count():
            leaves.append((few, a, b))
            depth = level
        before = size.filter(F.col("work") > small).select("node", "work")
        if not before.limit(1).count():
            return leaves, max(depth, 1)
        a = a.join(before.select("node"), "node", "left_semi")
        b = None if R is None else b.join(before.select("node"), "node", "left_semi")


def _pairs(leaves: list[tuple[DataFrame, DataFrame, DataFrame]], L: DataFrame, R: DataFrame | None, threshold: float) -> DataFrame:
    """Distinct pairs in a common node that the sizes and the bit sketches let pass.
    A node of much work is compared in blocks: each left row meets each block of the right."""
    names = ["size", *_bits()]
    blocks = F.ceil(F.col("work") / F.lit(float(BLOCK))).cast("int")
    xs = ys = None
    for size, a, b in leaves:
        x = a.select("id", "node").join(size, "node").select("id", "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        y = (a if R is None else b).select("id", "node").join(size, "node").select("id", "node", F.pmod(F.xxhash64("id", "node"), blocks).cast("int").alias("block"))
        xs, ys = x if xs is None else xs.unionByName(x), y if ys is None else ys.unionByName(y)
    side = lambda s, sets, c: s.join(sets.select("id", *names), "id").select("node", "block", F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in names])
    j = side(xs, L, "a").join(side(ys, L if R is None else R, "b"), ["node", "block"])
    j = j.filter((F.col("a_size") >= F.col("b_size") * threshold) & (F.col("b_size") >= F.col("a_size") * threshold))
    return j.filter(~bits_differ(threshold, WORDS) & (F.lit(True) if R is not None else F.col("a") < F.col("b"))).select("a", "b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float = 0.5, recall: float = RECALL, small: int = SMALL, seed: int = 3) -> DataFrame:
    """``(a, b, similarity)`` for the records of ``left`` and ``right`` (or the unordered
    pairs within ``left``, a < b) whose sets overlap by a Jaccard similarity of at least
    ``threshold``. Both sides are (record, tokens, size) as ``token_sets`` gives them; the
    smaller one is best on the left.

    No node, bucket or number of partners is capped. Empty sets match nothing; an empty
    side gives no pair."""
    one = right is None
    L, lm = _prepare(left, left.columns[0])
    R, rm = (None, lm) if one else _prepare(right, right.columns[0])
    leaves: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    trees, wanted = 0, trees_for(recall, 4)
    while trees < wanted:
        more, depth = _grow(L, R, threshold, [seed * 1_000_003 + t for t in range(trees, wanted)], small)
        leaves += more
        trees, wanted = wanted, max(wanted, trees_for(recall, depth))
    sets = L if one else R
    x, y = L.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("size").alias("na")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("size").alias("nb"))
    if leaves:
        cand = cut(_pairs(leaves, L, R, threshold))
    else:
        cand = L.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    j = cand.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    sim = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    found = j.filter(F.col("i") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("i")) - 1e-9).select("a", "b", F.round(sim, 6).alias("similarity"))
    if one:
        #: copies are similar to one another; a distinct set of one record has no such pair
        same = lm.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
        found = found.unionByName(same)
    out = found.join(lm.select(F.col("id").alias("a"), F.col("member").alias("ma")), "a").join(rm.select(F.col("id").alias("b"), F.col("member").alias("mb")), "b")
    if one:
        out = out.filter((F.col("a") != F.col("b")) | (F.col("ma") < F.col("mb")))
        return out.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), "similarity")
    return out.select(F.col("ma").alias("a"), F.col("mb").alias("b"), "similarity")


def list_sets(lists: DataFrame, min_size: int = 8) -> DataFrame:
    """Token sets of reference lists: (list_id, tokens, size)."""
    return token_sets(lists.select("list_id", F.explode("shingles").alias("content")), "list_id", "content", min_size)


def lists_to_regions(lists: DataFrame, shingles: DataFrame, threshold: float = 0.5, min_size: int = 8, **how) -> DataFrame:
    """``(list_id, region_id, similarity)``; sets under ``min_size`` distinct non-null
    values, null lists and null members are left out, repeated values count once, and the
    stated ``shingle_count`` is not used."""
    found = similar_pairs(list_sets(lists, min_size), token_sets(shingles, min_size=min_size), threshold, **how)
    return found.select(F.col("a").alias("list_id"), F.col("b").alias("region_id"), "similarity")
