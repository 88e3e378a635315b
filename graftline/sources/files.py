"""Sources: files of a directory or rows of a table, and their syntax nodes."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftline.runtime import latest, spread
from graftline.settings import Settings
from graftline.sources import ignore
from graftline.sources.languages import detect_language, glob_filter, in_directory_scan
from graftline.sources.tree import NODE_COLUMNS, NODE_SCHEMA, TEXT_KINDS, rows


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length, source)`` of a file or, recursively, of a directory."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", F.col("content").alias("source"))


def scan_directory(spark: SparkSession, target: str, settings: Settings = Settings()) -> DataFrame:
    """``(file_id, path, rel_path, language, source)`` of the files under a directory. The
    suffix prunes the listing (with regard to case, unlike a single file's); ignored files
    are dropped before their content is read."""
    target = os.path.abspath(target)
    f = read_binary(spark, target, glob_filter())
    f = f.withColumn("rel_path", ignore.relative(F.col("path"), F.lit(target))).filter(in_directory_scan())
    f = f.filter(~ignore.ignored(F.col("rel_path"), list(settings.ignore_patterns)))
    base = lambda d: "" if d == target else os.path.relpath(d, target).replace(os.sep, "/")
    rows = [(base(d), p) for d, patterns in ignore.discover(target, settings.ignore_files).items() for p in patterns]
    if rows:
        rules = spark.createDataFrame(rows, "base string, pattern string").withColumn("_all", F.lit(1))
        f = ignore.drop_by_directory(f.withColumn("_all", F.lit(1)), rules, "_all").drop("_all")
    return f.select(F.xxhash64("path").alias("file_id"), "path", "rel_path", detect_language().alias("language"), "source")


def scan_file(spark: SparkSession, target: str, settings: Settings = Settings()) -> DataFrame:
    """One file; it is tested against ignore settings only where there are any."""
    target = os.path.abspath(target)
    f = read_binary(spark, target).withColumn("rel_path", F.lit(os.path.basename(target)))
    if settings.ignore_patterns:
        f = f.filter(~ignore.ignored(F.col("rel_path"), list(settings.ignore_patterns)))
    return f.select(F.xxhash64("path").alias("file_id"), "path", "rel_path", detect_language().alias("language"), "source").filter("language is not null")


def scan(spark: SparkSession, target: str, settings: Settings = Settings()) -> DataFrame:
    """A file, a directory, or nothing if the path is neither."""
    if os.path.isfile(target):
        return scan_file(spark, target, settings)
    if os.path.isdir(target):
        return scan_directory(spark, target, settings)
    return spark.createDataFrame([], "file_id long, path string, rel_path string, language string, source binary")


def scan_table(source_files: DataFrame) -> DataFrame:
    """The same columns from a table of files; the latest delivery of a file counts and
    its language follows from its path."""
    f = latest(source_files.select("file_id", "path", "rel_path", "source", "ingested_at"), ["file_id"], "ingested_at")
    return f.select("file_id", "path", "rel_path", detect_language().alias("language"), "source").filter("language is not null")


def decoded(source: bytes | None) -> str:
    """A source as the frontends read it: without byte-order marks, lines ended by line feeds."""
    return (source or b"").decode("utf-8", "ignore").lstrip("﻿").replace("\r\n", "\n")


def _parser(batches: Iterator[pa.RecordBatch], tolerant: bool = False, texts: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    from graftline.sources.frontends import parse

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    schema = pa.schema([(c, pa.int64() if c == "tree_id" else pa.string() if c in ("kind", "field", "text") else pa.int32()) for c in NODE_COLUMNS] + [(c, pa.string()) for c in ("parent_kind", "grandparent_kind", "parse_error")])
    parent, kind = NODE_COLUMNS.index("parent_seq"), NODE_COLUMNS.index("kind")
    for b in batches:
        for tree_id, lang, source, offset in zip(*(c.to_pylist() for c in b.columns)):
            try:
                text = decoded(source)
                got = []
                for r in rows(parse(text, lang, tolerant), text, tree_id, offset or 0, texts):
                    #: parents stand before their children, so the kinds above are known already
                    up = got[r[parent]] if r[parent] is not None else None
                    got.append((*r, up and up[kind], up and up[len(NODE_COLUMNS)], None))
            except (ValueError, SyntaxError, RecursionError) as e:
                got = [(tree_id, *[None] * (len(NODE_COLUMNS) + 1), f"{type(e).__name__}: {e}")]
            cols = list(zip(*got))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def parse_files(files: DataFrame, tolerant: bool = False, texts: frozenset[str] | None = None) -> DataFrame:
    """``nodes`` of files ``(file_id, language, source[, line_offset])``, with the kinds of
    the two nodes above each, so that rules on parents need no join, and with one row that
    has just ``parse_error`` for each file that does not parse. A ``tolerant`` parse keeps
    the tree of a file with syntax errors and marks them by nodes of kind ``ERROR``.
    Every node carries its text, or, with ``texts`` (``rules.text_kinds``), only leaves,
    the kinds that the built-in rules read and those named."""
    offset = F.col("line_offset") if "line_offset" in files.columns else F.lit(0)
    f = files.select("file_id", "language", F.col("source").cast("binary").alias("source"), offset.cast("int").alias("line_offset"))
    return spread(f).mapInArrow(partial(_parser, tolerant=tolerant, texts=None if texts is None else TEXT_KINDS | texts), NODE_SCHEMA + ", parent_kind string, grandparent_kind string, parse_error string")


def parsed(nodes: DataFrame) -> DataFrame:
    """The nodes of the files that parsed."""
    return nodes.filter("parse_error is null").drop("parse_error")


def text_nodes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``nodes`` of plain texts, by built-in functions only: document, paragraphs (runs of
    lines that are not blank), lines and words, with the kinds of the two nodes above each.
    Offsets are not filled; a null text has no tree, a blank one only its root.

    Windows run over lines, and words are exploded behind them: a word's place is its
    line's place and its own number there."""
    d = documents.select(F.col(key).alias("tree_id"), F.split(text, "\n", -1).alias("ls")).filter("ls is not null")
    line = d.select("tree_id", F.posexplode("ls").alias("i", "text")).withColumn("blank", ~F.col("text").rlike(r"\S"))
    w = Window.partitionBy("tree_id").orderBy("i")
    first = (~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int")
    line = line.withColumn("first", first).filter("not blank").withColumn("ws", F.regexp_extract_all("text", F.lit(r"\S+"), 0))
    line = line.withColumn("size", F.size("ws") + 1 + F.col("first"))
    line = line.withColumn("at", F.sum("size").over(w) - F.col("size") + 1 + F.col("first"))
    line = line.withColumn("para", F.max(F.when(F.col("first") == 1, F.col("at") - 1)).over(w))
    p = Window.partitionBy("tree_id", "para")
    line = line.withColumns({"p_end": F.max(F.col("at") + F.size("ws")).over(p), "p_kids": F.count(F.lit(1)).over(p), "p_last": F.max("i").over(p)})
    node = lambda kind, seq, up, end, kids, t, last, k1, k2, depth: F.struct(
        seq.cast("int").alias("seq"), up.cast("int").alias("parent_seq"), end.cast("int").alias("end_seq"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), kids.cast("int").alias("n_children"), t.alias("text"),
        (F.col("i") + 1).alias("start_line"), (last + 1).alias("end_line"), F.lit(k1).cast("string").alias("parent_kind"), F.lit(k2).cast("string").alias("grandparent_kind"))
    i, at, n = F.col("i"), F.col("at"), F.size("ws")
    para = F.array(node("paragraph", F.col("para"), F.lit(0), F.col("p_end"), F.col("p_kids"), F.lit(""), F.col("p_last"), "document", None, 2))
    own = F.array(node("line", at, F.col("para"), at + n, n, F.col("text"), i, "paragraph", "document", 3))
    words = F.transform("ws", lambda x, j: node("word", at + j + 1, at, at + j + 1, F.lit(0), x, i, "line", "paragraph", 4))
    below = line.select("tree_id", F.explode(F.concat(F.when(F.col("first") == 1, para).otherwise(F.slice(para, 1, 0)), own, words)).alias("x")).select("tree_id", "x.*")
    whole = line.groupBy("tree_id").agg(F.max(at + n).alias("e"), F.sum("first").alias("k"), F.max("i").alias("last"))
    root = d.select("tree_id").join(whole, "tree_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    none = F.lit(None).cast("string")
    root = root.select("tree_id", F.lit(0).alias("seq"), F.lit(None).cast("int").alias("parent_seq"), zero("e").alias("end_seq"), F.lit(1).alias("depth"), F.lit("document").alias("kind"), zero("k").alias("n_children"), F.lit("").alias("text"), F.lit(1).alias("start_line"), (zero("last") + 1).alias("end_line"), none.alias("parent_kind"), none.alias("grandparent_kind"))
    out = root.unionByName(below)
    return out.select("tree_id", "seq", "parent_seq", "end_seq", "depth", "kind", none.alias("field"), "n_children", "text", "start_line", "end_line", F.lit(None).cast("int").alias("start_byte"), F.lit(None).cast("int").alias("end_byte"), "parent_kind", "grandparent_kind")
