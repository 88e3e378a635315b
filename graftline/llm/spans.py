"""Problem 7: long exact spans shared between records, by de Bruijn compaction.

Tokens are lines. A window of k lines is an edge of the de Bruijn graph (from its first
k-1 lines to its last k-1). Edges that occur in at least two records are kept; where an
edge is always followed by the same edge, and that always preceded by it, both belong to
one nonbranching path. Paths are compacted by pointer doubling through joins, every
occurrence of a path is one span, and the spans' digests over the source lines verify it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.runtime import cut, latest, skew_join, spread

K = 8


def source_lines(files: DataFrame) -> DataFrame:
    """``(file_id, lines)``: the latest delivery of each file, split at line feeds, without
    an empty last piece and without one carriage return at each line's end. Bytes map to
    characters one to one, so equal strings are equal bytes. A null source has no line."""
    f = latest(files.select("file_id", "source", "ingested_at"), ["file_id"], "ingested_at")
    text = F.decode(F.coalesce(F.col("source"), F.lit(b"")), "ISO-8859-1")
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return f.select("file_id", F.transform(parts, lambda x: F.when(x.endswith("\r"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)).alias("lines"))


def windows(lines: DataFrame, k: int = K) -> DataFrame:
    """``(file_id, pos, h1, h2)``: every window of ``k`` lines by its first line's number,
    with two independent 64-bit fingerprints."""
    ids = lines.filter(F.size("lines") >= k).select("file_id", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("b"))
    at = F.explode(F.sequence(F.lit(1), F.size("a") - (k - 1))).alias("pos")
    each = ids.select("file_id", "a", "b", at)
    return each.select("file_id", "pos", F.xxhash64(F.slice("a", F.col("pos"), F.lit(k))).alias("h1"), F.xxhash64(F.slice("b", F.col("pos"), F.lit(k))).alias("h2"))


def compact(links: DataFrame, edges: DataFrame) -> DataFrame:
    """``(e1, e2, head1, head2, off)`` for each edge: its path's first edge and its place
    there. ``links`` ``(p1, p2, e1, e2)`` are the nonbranching steps, so every edge has at
    most one predecessor; each round doubles the distance looked back over."""
    cur = edges.join(links, ["e1", "e2"], "left").select("e1", "e2", F.coalesce("p1", "e1").alias("head1"), F.coalesce("p2", "e2").alias("head2"), F.when(F.col("p1").isNull(), 0).otherwise(1).alias("off"))
    cur = cut(cur)
    while True:
        back = cur.filter("off > 0").select(F.col("e1").alias("head1"), F.col("e2").alias("head2"), F.col("head1").alias("far1"), F.col("head2").alias("far2"), F.col("off").alias("more"))
        nxt = cur.join(back, ["head1", "head2"], "left").select("e1", "e2", F.coalesce("far1", "head1").alias("head1"), F.coalesce("far2", "head2").alias("head2"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
        nxt = cut(nxt)
        moved = nxt.agg(F.sum("off")).first()[0] != cur.agg(F.sum("off")).first()[0]
        cur = nxt
        if not moved:
            return cur


def shared_spans(files: DataFrame, k: int = K) -> DataFrame:
    """``(file_id, start_line, end_line)``: every maximal run of lines that each lie in
    ``k`` consecutive lines occurring in another record too. Numbers start at 1 and
    include both ends.

    Records of fewer than ``k`` lines share nothing; a run repeated only inside its own
    record is not shared; redelivered rows of a record are one record; an empty table
    gives no row; other columns are ignored."""
    lines = source_lines(spread(files, "file_id"))
    win = windows(lines, k)
    seen = win.groupBy("h1", "h2").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    repeated = cut(seen.filter("lo <> hi").select(F.col("h1"), F.col("h2"), "n"))
    occ = cut(skew_join(win, repeated, ["h1", "h2"]))
    w = Window.partitionBy("file_id").orderBy("pos")
    step = occ.select("*", F.lead("pos").over(w).alias("np"), F.lead("h1").over(w).alias("e1"), F.lead("h2").over(w).alias("e2"), F.lead("n").over(w).alias("m")).filter("np = pos + 1 and n = m")
    links = step.groupBy(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "e1", "e2", "n").agg(F.count(F.lit(1)).alias("c")).filter("c = n").drop("c", "n")
    path = compact(links, repeated.select(F.col("h1").alias("e1"), F.col("h2").alias("e2")))
    length = path.groupBy("head1", "head2").agg((F.max("off") + k).alias("len"))
    heads = length.join(repeated, (F.col("head1") == F.col("h1")) & (F.col("head2") == F.col("h2"))).select("h1", "h2", "len", "n")
    spans = skew_join(occ.drop("n"), heads, ["h1", "h2"]).select("file_id", "h1", "h2", "pos", "len")
    #: the source coordinates verify each span: equal digests in two records
    text = spans.join(lines, "file_id").select("file_id", "pos", "len", "h1", "h2", F.sha2(F.array_join(F.slice("lines", F.col("pos"), F.col("len")), "\n"), 256).alias("digest"))
    text = cut(text)
    sure = text.groupBy("h1", "h2", "digest").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").drop("lo", "hi")
    good = skew_join(text, sure, ["h1", "h2", "digest"]).select("file_id", F.col("pos").alias("s"), (F.col("pos") + F.col("len") - 1).alias("e"))
    return merge_runs(good)


def merge_runs(spans: DataFrame) -> DataFrame:
    """Union of ``(file_id, s, e)`` line ranges into maximal runs; touching ranges merge."""
    w = Window.partitionBy("file_id").orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(top.isNull() | (F.col("s") > top + 1), 1).otherwise(0))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "run").agg(F.min("s").cast("int").alias("start_line"), F.max("e").cast("int").alias("end_line")).drop("run")


def shared_share(files: DataFrame, regions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file ``(file_id, n_lines, shared_lines, share)`` and per region ``(region_id,
    n_lines, shared_lines, share)``; files and regions that share nothing have 0."""
    n = source_lines(files).select("file_id", F.size("lines").alias("n_lines"))
    per = runs.groupBy("file_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("shared_lines"))
    shared = F.coalesce(F.col("shared_lines"), F.lit(0)).alias("shared_lines")
    share = F.round(F.coalesce(F.col("shared_lines") / F.col("n_lines"), F.lit(0.0)), 6).alias("share")
    by_file = n.join(per, "file_id", "left").select("file_id", "n_lines", shared, share)
    r = regions.select("region_id", F.col("tree_id").alias("file_id"), F.col("start_line").alias("rs"), F.col("end_line").alias("re")).distinct()
    #: least and greatest pass over nulls, so a file without runs is told by its null start
    over = F.when(F.col("start_line").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least("re", "end_line") - F.greatest("rs", "start_line") + 1))
    hit = r.join(runs, "file_id", "left").groupBy("region_id", (F.col("re") - F.col("rs") + 1).alias("n_lines")).agg(F.sum(over).alias("shared_lines"))
    return by_file, hit.select("region_id", "n_lines", "shared_lines", F.round(F.col("shared_lines") / F.col("n_lines"), 6).alias("share"))
