"""Connected components of the similarity graph by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.runtime import settled, skew_join


def _picks(edges: DataFrame, turn: int) -> DataFrame:
    """``(node, rep, n)``: each node's choice among itself and its neighbours, the least by
    a hash of the round, and its number of edges."""
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    per = both.groupBy("x").agg(F.min(rank("y")).alias("least"), F.count(F.lit(1)).alias("n"))
    return per.select(F.col("x").alias("node"), F.least("least", rank("x"))["node"].alias("rep"), "n")


#: Edges that one task joins without trouble.
FEW_EDGES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, rep)`` of all edges of a task: each node's least connected one."""
    up: dict = {}
    kind = None

    def top(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "rep"])


def connected_components(edge_table: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Each round contracts every node into the neighbour that a random order puts first, so
    the graph shrinks geometrically whatever its diameter; then the choices are put
    together from the last round to the first. Rounds are checkpointed reliably; a graph of
    at most ``FEW_EDGES``, from the start or after some rounds, is joined by one task. Null
    ends and loops link nothing; repeated and reversed edges count once."""
    e = edge_table.select(F.least(u, v).alias("x"), F.greatest(u, v).alias("y"), F.col(u).alias("_u"), F.col(v).alias("_v"))
    e = settled(e.filter("_u is not null and _v is not null and x <> y").select("x", "y").distinct())
    chosen: list[DataFrame] = []
    turn = 0
    kind = e.schema["x"].dataType.simpleString()
    while left := e.count():
        if left <= FEW_EDGES:
            chosen.append(settled(e.repartition(1).mapInArrow(_joined, f"node {kind}, rep {kind}")))
            break
        picks = settled(_picks(e, turn))
        chosen.append(picks)
        one = picks.select(F.col("node").alias("x"), F.col("rep").alias("rx"), "n")
        two = picks.select(F.col("node").alias("y"), F.col("rep").alias("ry"), "n")
        moved = skew_join(skew_join(e, one, ["x"]).drop("n"), two, ["y"])
        moved = moved.filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"))
        e = settled(moved.distinct())
        turn += 1
    if not chosen:
        return e.select(F.col("x").alias("node"), F.col("x").alias("component"))
    if len(chosen) == 1 and left:
        return chosen[0].select("node", F.col("rep").alias("component"))
    label = chosen[-1].select("node", "rep")
    for picks in reversed(chosen[:-1]):
        sizes = picks.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        far = sizes.join(label.select(F.col("node").alias("rep"), F.col("rep").alias("far")), "rep", "left")
        label = settled(skew_join(picks.select("node", "rep"), far, ["rep"]).select("node", F.coalesce("far", "rep").alias("rep")))
    least = label.groupBy("rep").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
    return skew_join(label, least, ["rep"]).select("node", "component")
