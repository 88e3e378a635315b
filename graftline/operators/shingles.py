"""Normalised nodes and vertical k-gram shingles, all as windows, joins and Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.expressions import ARROW, leaf_value, render
from graftline.operators.rules import Action, Rule
from graftline.runtime import settled


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_kind and grandparent_kind, by joins on (tree_id, parent_seq); nodes
    that come with them stay as they are. Only nodes with children can be parents."""
    if "parent_kind" in nodes.columns:
        return nodes
    holders = nodes.filter("n_children > 0")
    up = holders.select("tree_id", F.col("seq").alias("parent_seq"), F.col("kind").alias("parent_kind"), F.col("parent_seq").alias("_g"))
    top = holders.select("tree_id", F.col("seq").alias("_g"), F.col("kind").alias("grandparent_kind"))
    return nodes.join(up, ["tree_id", "parent_seq"], "left").join(top, ["tree_id", "_g"], "left").drop("_g")


def with_inner(nodes: DataFrame, rules: list[Rule], below: DataFrame | None = None) -> DataFrame:
    """Add ``inner``, the kinds and texts of the children that some rule asks about; where
    ``nodes`` are only some of a tree's, ``below`` has all of them."""
    asked = [r for r in rules if r.match.has]
    if not asked:
        return nodes
    kinds, holders = {r.match.has[0] for r in asked}, {k for r in asked for k in r.match.kinds}
    inner = (nodes if below is None else below).filter(F.col("kind").isin(*kinds)).groupBy("tree_id", F.col("parent_seq").alias("seq")).agg(F.collect_list(F.struct("kind", "text")).alias("inner"))
    #: only nodes of the asking kinds are joined; all others pass by
    holds = F.coalesce(F.col("kind").isin(*holders), F.lit(False))
    some = nodes.filter(holds).join(inner, ["tree_id", "seq"], "left")
    return some.unionByName(nodes.filter(~holds).withColumn("inner", F.lit(None).cast(inner.schema["inner"].dataType)))


def region_nodes(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """The nodes of every region's subtree: an equi-join on the tree with a range test."""
    r = regions.select("region_id", "tree_id", F.col("root_seq").alias("_s"), F.col("end_seq").alias("_e"), "shingle_language")
    n = nodes.join(r, "tree_id").filter(F.col("seq").between(F.col("_s"), F.col("_e")))
    root = F.col("seq") == F.col("_s")
    return n.withColumn("parent_seq", F.when(root, F.lit(None)).otherwise(F.col("parent_seq"))).drop("_s", "_e")


def compile_rules(rules: list[Rule], language: str = "shingle_language") -> dict[str, Column]:
    """Columns ``removed``, ``name`` and ``value`` (null: as it is), ``anon`` (prefix to
    number under, also where a later rule overwrites it) and ``numbered`` (whether the
    number is the value in the end). Rules for all languages come first, then those of
    languages, each in order; later rules win per slot; a removal ends a node."""
    rules = [r for r in rules if "*" in r.languages] + [r for r in rules if "*" not in r.languages]

    def on(r: Rule) -> Column:
        c = r.match.column()
        return c if "*" in r.languages else F.col(language).isin(*r.languages) & c

    acts = {a: [r for r in rules if r.action is a] for a in Action}
    removed = reduce(lambda a, r: a | on(r), acts[Action.REMOVE], F.lit(False))
    none = F.lit(None).cast("string")
    name = reduce(lambda a, r: F.when(on(r), r.params.get("token", "<NODE>")).otherwise(a), acts[Action.REPLACE_TYPE], none)
    value, numbered, anon = none, F.lit(False), none
    for r in rules:
        if r.action is Action.REPLACE_VALUE:
            value = F.when(on(r), r.params.get("value", "<LIT>")).otherwise(value)
            numbered = F.when(on(r), False).otherwise(numbered)
        elif r.action is Action.ANONYMIZE:
            anon = F.when(on(r), r.params.get("prefix", "VAR")).otherwise(anon)
            numbered = F.when(on(r), True).otherwise(numbered)
    return {"removed": F.coalesce(removed, F.lit(False)), "new_name": name, "new_value": value, "anon": anon, "numbered": F.coalesce(numbered, F.lit(False))}


def without_removed(nodes: DataFrame, key: str = "region_id") -> DataFrame:
    """Drop removed nodes with their subtrees: in pre-order a node lies below a removed one
    if a removed node before it ends behind it."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("removed"), F.col("end_seq"))).over(w)
    return nodes.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("seq"))).drop("_reach")


def numbered_names(nodes: DataFrame, key: str = "region_id") -> DataFrame:
    """Add ``number``: the rank of a text's first visit among the texts of its prefix."""
    first = nodes.filter("anon is not null").groupBy(key, "anon", "text").agg(F.min("seq").alias("_first"))
    order = Window.partitionBy(key, "anon").orderBy("_first")
    ranked = first.select(key, "anon", "text", F.dense_rank().over(order).alias("number"))
    return nodes.join(ranked, [key, "anon", "text"], "left")


def normalised(nodes: DataFrame, rules: list[Rule], key: str = "region_id") -> DataFrame:
    """Surviving nodes with their representation ``rep``. Rulesets that remove nothing or
    number nothing skip the window or the join for it."""
    acts = {r.action for r in rules}
    n = nodes.withColumns(compile_rules(rules))
    if Action.REMOVE in acts:
        n = without_removed(n, key)
    n = numbered_names(n, key) if Action.ANONYMIZE in acts else n.withColumn("number", F.lit(None).cast("int"))
    own = F.when(F.col("n_children") == 0, leaf_value("text"))
    value = F.when(F.col("numbered"), F.concat(F.col("anon"), F.lit("_"), F.col("number").cast("string"))).otherwise(F.coalesce("new_value", own))
    return n.withColumn("rep", render(F.coalesce("new_name", "kind"), value))


def path_kgrams(nodes: DataFrame, k: int = 3, key: str = "region_id") -> DataFrame:
    """``(key, seq, content, start_line, end_line)``: for every node at depth k or more,
    counted from its region's root, the last k representations of its root path. Lines are
    those of the last node. k-1 joins on the parent; k below 1 is an error."""
    if k < 1:
        raise ValueError("k must be at least 1")
    cur = nodes.select(key, "seq", "start_line", "end_line", F.col("parent_seq").alias("_up"), F.col("rep").alias("content"))
    step = nodes.filter("n_children > 0").select(key, F.col("seq").alias("_up"), F.col("parent_seq").alias("_next"), F.col("rep").alias("_rep"))
    for _ in range(k - 1):
        cur = cur.join(step, [key, "_up"]).withColumn("content", F.concat_ws(ARROW, "_rep", "content")).drop("_up", "_rep").withColumnRenamed("_next", "_up")
    return cur.select(key, "seq", "content", "start_line", "end_line")


def shingle_regions(nodes: DataFrame, regions: DataFrame, rules: list[Rule], k: int = 3) -> DataFrame:
    """Shingles of every region under a ruleset; numbering starts anew in each region."""
    norm = [r for r in rules if r.action is not Action.EXTRACT]
    own = normalised(region_nodes(with_inner(with_parents(nodes), norm), regions), norm)
    #: the joins below read these narrow rows k times, and the windows above run once
    return path_kgrams(settled(own.select("region_id", "seq", "parent_seq", "n_children", "start_line", "end_line", "rep")), k)
