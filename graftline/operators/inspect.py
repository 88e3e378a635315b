"""Views of normalised nodes: tokens by line and the transformed source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.expressions import leaf_value, render
from graftline.operators.rules import Action, Rule
from graftline.operators.shingles import compile_rules, normalised, numbered_names, with_inner, with_parents


def _whole(nodes: DataFrame) -> DataFrame:
    """Each tree as one region; without a language column no language-bound rule matches."""
    n = nodes.withColumn("region_id", F.col("tree_id"))
    return n if "shingle_language" in n.columns else n.withColumn("shingle_language", F.lit(None).cast("string"))


def tokens_by_line(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(tree_id, line, tokens)``: representations by start line in document order. A
    removed node is left out, but its children are still shown."""
    rules = [r for r in rules if r.action is not Action.EXTRACT]
    n = with_inner(with_parents(_whole(nodes)), rules).withColumns(compile_rules(rules)).filter(~F.col("removed"))
    n = numbered_names(n)
    own = F.when(F.col("n_children") == 0, leaf_value("text"))
    value = F.when(F.col("numbered"), F.concat("anon", F.lit("_"), F.col("number").cast("string"))).otherwise(F.coalesce("new_value", own))
    n = n.withColumn("rep", render(F.coalesce("new_name", "kind"), value))
    by = n.groupBy("tree_id", F.col("start_line").alias("line")).agg(F.array_sort(F.collect_list(F.struct("seq", "rep"))).alias("t"))
    return by.select("tree_id", "line", F.array_join(F.transform("t", lambda x: x["rep"]), " ").alias("tokens"))


def _source_lines(files: DataFrame) -> DataFrame:
    """``(tree_id, ls)``: each file's lines; bytes that are no UTF-8 show as U+FFFD."""
    f = files.select(F.col(files.columns[0]).alias("tree_id"), F.col("source").cast("binary").alias("source"))
    return f.select("tree_id", F.split(F.regexp_replace(F.make_valid_utf8(F.col("source").cast("string")), "^\ufeff|\r(?=\n)", ""), "\n", -1).alias("ls"))


def transformed_source(nodes: DataFrame, rules: list[Rule], files: DataFrame | None = None) -> DataFrame:
    """``(tree_id, line, text)``: the surviving leaves' values by line, in the order of
    their columns and behind the indentation of the original line, which ``files``
    (id, ..., source) gives; without them no line is indented. A node all of whose children
    were removed shows as ``<name>``."""
    rules = [r for r in rules if r.action is not Action.EXTRACT]
    n = normalised(with_inner(with_parents(_whole(nodes)), rules), rules)
    kids = n.filter("parent_seq is not null").groupBy("tree_id", F.col("parent_seq").alias("seq")).agg(F.count(F.lit(1)).alias("left"))
    n = n.join(kids, ["tree_id", "seq"], "left")
    gone = (F.col("n_children") > 0) & F.col("left").isNull()
    inside = F.regexp_extract("rep", r"^[^(]*\((.*)\)$", 1)
    shown = F.when(gone, F.concat(F.lit("<"), F.coalesce("new_name", "kind"), F.lit(">"))).when(F.col("left").isNull(), F.when(inside != "", inside).otherwise(F.coalesce("new_name", "kind")))
    by = n.withColumn("shown", shown).filter("shown is not null").groupBy("tree_id", F.col("start_line").alias("line")).agg(F.array_sort(F.collect_list(F.struct("start_byte", "seq", "shown"))).alias("t"))
    by = by.select("tree_id", "line", F.array_join(F.transform("t", lambda x: x["shown"]), " ").alias("text"))
    if files is None:
        return by
    indent = F.regexp_extract(F.coalesce(F.get("ls", F.col("line") - 1), F.lit("")), r"^(\s*)", 1)
    return by.join(_source_lines(files), "tree_id", "left").select("tree_id", "line", F.concat(indent, "text").alias("text"))


def comparison(nodes: DataFrame, rules: list[Rule], files: DataFrame) -> DataFrame:
    """``(tree_id, line, source, text)``: every line of a file next to what the rules leave
    of it (null where nothing is left)."""
    f = _source_lines(files).select("tree_id", F.posexplode("ls").alias("line", "source")).withColumn("line", F.col("line") + 1)
    return f.join(transformed_source(nodes, rules, files), ["tree_id", "line"], "left").select("tree_id", "line", "source", "text")


def totals(tokens: DataFrame) -> DataFrame:
    """``(tree_id, n_lines, n_tokens)`` of a token view."""
    return tokens.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size(F.split("tokens", " "))).alias("n_tokens"))
