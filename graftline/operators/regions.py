"""Regions: matching rules, names, removal of repeats, filters and injections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.expressions import lines
from graftline.operators.rules import Action, Rule
from graftline.operators.shingles import with_inner, with_parents

#: Types that beat others on the same lines, and kinds that hold a name.
EXPLICIT = ("function", "class", "method", "heading", "section", "head", "body")
NAME_KINDS = ("identifier", "name", "property_identifier")
#: Spellings of fence languages.
FENCE_ALIASES = {"yml": "yaml", "ts": "typescript", "js": "javascript", "py": "python", "sh": "bash", "shell": "bash", "rs": "rust", "kt": "kotlin", "md": "markdown"}


def deduplicated(regions: DataFrame, order: list[str]) -> DataFrame:
    """One region per (path, start, end): the first in ``order``, but an explicit type
    beats others."""
    w = Window.partitionBy("path", "start_line", "end_line").orderBy(F.col("region_type").isin(*EXPLICIT).desc(), *order)
    return regions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def at_least(regions: DataFrame, min_lines: int) -> DataFrame:
    return regions.filter(lines() >= min_lines)


def extract(nodes: DataFrame, files: DataFrame, rules: list[Rule]) -> DataFrame:
    """All regions that the extraction rules find, in (start_byte, end_byte, rule) order
    with repeats removed. A language without rules gives none. ``files`` is (file_id,
    path, language)."""
    found = [r for r in rules if r.action is Action.EXTRACT]
    #: only nodes of a kind that some rule names can be regions; they go into the joins
    kinds = sorted({k for r in found for k in r.match.kinds})
    n = with_parents(nodes).filter(F.col("kind").isin(*kinds)).join(files.select(F.col("file_id").alias("tree_id"), "path", "language"), "tree_id")
    n = with_inner(n, found, nodes)
    hit = [F.when((F.col("language").isin(*r.languages) if "*" not in r.languages else F.lit(True)) & r.match.column(), F.struct(F.lit(i).alias("rule_no"), F.lit(r.params.get("region_type", "unknown")).alias("region_type"), F.lit(r.inject).alias("inject"), F.lit(r.content).alias("content"))) for i, r in enumerate(found)]
    n = n.withColumn("_hit", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull()))).select("*", "_hit.*").drop("_hit")
    named = nodes.filter(F.col("kind").isin(*NAME_KINDS)).groupBy("tree_id", F.col("parent_seq").alias("seq")).agg(F.min_by("text", "seq").alias("_name"))
    n = n.join(named, ["tree_id", "seq"], "left")
    r = n.select("tree_id", F.col("seq").alias("root_seq"), "end_seq", "path", "language", "region_type", F.coalesce("_name", F.lit("anonymous")).alias("region_name"), "start_line", "end_line", "start_byte", "end_byte", "rule_no", "inject", "content", "text")
    r = deduplicated(r, ["start_byte", "end_byte", "rule_no"])
    return r.withColumn("region_id", F.xxhash64("path", "start_line", "end_line")).withColumn("shingle_language", F.col("language"))


def fence_language(info: str | Column) -> Column:
    """The language a fence's info string names, or an empty string: its first word in
    lower case, by nine aliases; unsupported ones are empty."""
    from graftline.sources.languages import SUFFIXES

    c = F.col(info) if isinstance(info, str) else info
    word = F.lower(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")[0])
    table = F.create_map(*[F.lit(x) for p in FENCE_ALIASES.items() for x in p])
    word = F.coalesce(F.try_element_at(table, word), word)
    return F.when(word.isin(*SUFFIXES), word).otherwise("")


def injections(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(region_id, path, language, content, line_offset)`` of regions whose content is to
    be parsed as another language: the first content node's text, or the whole region's;
    blank content and unknown languages inject nothing."""
    kinds = ("code_fence_content", "frontmatter_js_block")
    first = nodes.filter(F.col("kind").isin(*kinds)).groupBy("tree_id", F.col("parent_seq").alias("root_seq")).agg(F.min_by(F.struct("text", "start_line"), "seq").alias("_c"))
    info = nodes.filter("kind = 'info_string'").groupBy("tree_id", F.col("parent_seq").alias("root_seq")).agg(F.min_by("text", "seq").alias("_info"))
    r = regions.filter("inject is not null").join(first, ["tree_id", "root_seq"], "left").join(info, ["tree_id", "root_seq"], "left")
    lang = F.when(F.col("inject") == "*", fence_language(F.coalesce("_info", F.lit("")))).otherwise(F.col("inject"))
    text = F.when(F.col("content").isNotNull(), F.col("_c.text")).otherwise(F.col("text"))
    out = r.select("region_id", "path", lang.alias("language"), text.alias("source"), (F.coalesce("_c.start_line", "start_line") - 1).alias("line_offset"))
    return out.filter((F.col("language") != "") & (F.trim(F.regexp_replace("source", r"\s", " ")) != ""))


def with_injections(regions: DataFrame, injected: DataFrame, trees: DataFrame) -> DataFrame:
    """Regions whose injected content parsed take that tree and its language for their
    shingles and keep their file's language; all others stay as they are."""
    roots = trees.filter("parent_seq is null").select(F.col("tree_id").alias("_tree"), F.col("seq").alias("_root"), F.col("end_seq").alias("_end"))
    i = injected.select("region_id", F.col("language").alias("_lang")).join(roots, F.col("region_id") == F.col("_tree"))
    r = regions.join(i, "region_id", "left")
    pick = lambda new, old: F.coalesce(new, old).alias(old)
    keep = [c for c in regions.columns if c not in ("tree_id", "root_seq", "end_seq", "shingle_language")]
    return r.select(*keep, pick("_tree", "tree_id"), pick("_root", "root_seq"), pick("_end", "end_seq"), pick("_lang", "shingle_language"))


def type_histogram(regions: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent region types; a top-k report."""
    return regions.groupBy("region_type").agg(F.count(F.lit(1)).alias("n_regions")).orderBy(F.desc("n_regions"), "region_type").limit(top)


def types_used(regions: DataFrame) -> DataFrame:
    """``(language, types)``: the sorted types of each language."""
    return regions.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("region_type")), ",").alias("types"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
