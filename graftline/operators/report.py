"""Aggregates over the result, and the result as tables and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.expressions import lines, sarif_level
from graftline.runtime import cut, ranked, skew_join


def language_summary(regions: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """``(language, n_files, n_groups, n_lines)`` per language and a row ``total``.

    Files are distinct paths of all regions; lines are those of group members, under their
    own language; a group counts once, under its first member's language. The total counts
    distinct files anew."""
    m = members.join(regions.select("region_id", "path", "start_line", "end_line", "language"), "region_id").join(groups.select("group_id"), "group_id", "left_semi")
    files = regions.select("language", "path").distinct().groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
    dup = m.groupBy("language").agg(F.sum(lines()).alias("n_lines"))
    first = m.groupBy("group_id").agg(F.min_by("language", F.struct("path", "start_line", "end_line", "region_id")).alias("language"))
    counted = first.groupBy("language").agg(F.count(F.lit(1)).alias("n_groups"))
    per = files.join(dup, "language", "left").join(counted, "language", "left")
    per = per.select("language", "n_files", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
    paths = regions.agg(F.count_distinct("path").alias("n_files"))
    total = per.agg(F.coalesce(F.sum("n_groups"), F.lit(0)).alias("n_groups"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines")).join(F.broadcast(paths), F.lit(True))
    return per.unionByName(total.select(F.lit("total").alias("language"), "n_files", "n_groups", "n_lines"))


def self_similar(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Groups all of whose members lie in one file."""
    m = members.join(regions.select("region_id", "path"), "region_id")
    return m.groupBy("group_id").agg(F.min("path").alias("path"), F.max("path").alias("_hi")).filter("path = _hi").drop("_hi")


def ordinals(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Members with their regions and an ordinal from 0 by path, start and end. All members
    are ranked by ranges and each group's first rank is taken off, so that no group has to
    be sorted in one task."""
    m = members.join(regions.select("region_id", "path", "language", "region_type", "region_name", "start_line", "end_line"), "region_id")
    r = cut(ranked(m, [F.col(c) for c in ("group_id", "path", "start_line", "end_line", "region_id")], "_rank"))
    first = r.groupBy("group_id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return skew_join(r, first, ["group_id"], "_n").withColumn("ordinal", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_n")


def display_order(groups: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """``(group_id, similarity, mean_lines)`` in ascending order of both."""
    mean = members.join(regions.select("region_id", "start_line", "end_line"), "region_id").groupBy("group_id").agg(F.avg(lines()).alias("mean_lines"))
    return groups.select("group_id", "similarity").join(mean, "group_id").orderBy("similarity", "mean_lines", "group_id")


def display_lines(groups: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """``(group_id, ordinal, line)``: a header (ordinal -1) and one line per region."""
    head = groups.select("group_id", F.lit(-1).alias("ordinal"), F.format_string("Similar group (%.1f%%): %d regions", F.col("similarity") * 100, F.col("size").cast("int")).alias("line"))
    each = ordinals(members, regions).select("group_id", "ordinal", F.format_string("  %s [%d:%d] (%d lines) %s(%s)", "path", "start_line", "end_line", lines(), "region_name", "region_type").alias("line"))
    return head.unionByName(each)


def sarif_results(groups: DataFrame, members: DataFrame, regions: DataFrame, uri_base: str = "") -> DataFrame:
    """``(group_id, result)``: one SARIF result per group as JSON; the first member is the
    primary location, the others are related ones with ids from 1."""
    m = ordinals(members, regions)
    loc = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"), F.struct(F.format_string("%s: %s", "region_type", "region_name").alias("text")).alias("message"))
    per = m.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", loc.alias("loc")))).alias("locs"))
    g = groups.join(per, "group_id")
    related = F.transform(F.slice("locs", F.lit(2), F.greatest(F.size("locs") - 1, F.lit(1))), lambda x, i: F.struct((i + 1).alias("id"), x["loc"]["physicalLocation"].alias("physicalLocation"), x["loc"]["message"].alias("message")))
    props = F.struct("similarity", F.round(F.col("similarity") * 100, 1).alias("similarityPercent"), F.size("locs").alias("groupSize"))
    text = F.format_string("%d similar regions (%.1f%%)", F.size("locs"), F.col("similarity") * 100)
    first = F.element_at("locs", 1)["loc"]
    result = F.struct(F.lit("similar-code").alias("ruleId"), sarif_level().alias("level"), F.struct(text.alias("text")).alias("message"), F.array(first).alias("locations"), F.when(F.size("locs") > 1, related).alias("relatedLocations"), props.alias("properties"))
    return g.select("group_id", "similarity", F.to_json(result).alias("result"))


def write_sarif(results: DataFrame, path: str | None = None, version: str = "0.1.0") -> str:
    """A SARIF 2.1.0 log of one run, results by falling similarity, streamed from the
    executors; written to ``path`` or returned."""
    rows = results.orderBy(F.desc("similarity"), "group_id").select("result").toLocalIterator()
    tool = {"driver": {"name": "graftline", "version": version, "rules": [{"id": "similar-code", "shortDescription": {"text": "Structurally similar code"}}]}}
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1] + ', "runs": [{"tool": ' + json.dumps(tool) + ', "results": ['
    if path is None:
        return head + ",".join(r[0] for r in rows) + "]}]}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(head)
        for i, r in enumerate(rows):
            f.write(("," if i else "") + r[0])
        f.write("]}]}")
    return path
