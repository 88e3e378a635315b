"""Problem 5: source files that do not parse.

Each file goes through the recursive-descent parser of the language its suffix names, in
Arrow batches; all errors are stored, with the first cause. Rates come out per repository
and language, next to what the scan itself reported.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.llm import syntax
from graftline.runtime import latest, spread

_ERROR = pa.struct([("line", pa.int32()), ("cause", pa.string())])
SCHEMA = "file_id long, parsed_as string, n_errors int, first_line int, first_cause string, errors array<struct<line: int, cause: string>>"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    for b in batches:
        langs, found = [], []
        for path, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lang = syntax.language_of(path)
            langs.append(lang)
            found.append(syntax.errors(source or b"", lang) if lang else [])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(langs, pa.string()), pa.array([len(e) for e in found], pa.int32()), pa.array([e[0][0] if e else None for e in found], pa.int32()), pa.array([e[0][1] if e else None for e in found], pa.string()), pa.array([[{"line": x, "cause": y} for x, y in e] for e in found], pa.list_(_ERROR))],
            names=["file_id", "parsed_as", "n_errors", "first_line", "first_cause", "errors"],
        )


def checked(files: DataFrame) -> DataFrame:
    """``(file_id, parsed_as, n_errors, first_line, first_cause, errors)`` per file.

    Of a file's deliveries the latest counts. A null or empty source is valid. A file
    without a path, or with a suffix of no known language, has a null ``parsed_as`` and no
    errors. Nesting beyond the recursion limit is judged too (``syntax.errors``)."""
    f = latest(files.select("file_id", "path", "source", "ingested_at"), ["file_id"], "ingested_at")
    return spread(f.select("file_id", "path", "source")).mapInArrow(_check, SCHEMA)


def acceptance(files: DataFrame) -> DataFrame:
    """``(language, n_files, n_valid, rate)`` per language of the suffix."""
    ok = (F.col("n_errors") == 0).cast("long")
    c = checked(files).filter("parsed_as is not null").groupBy(F.col("parsed_as").alias("language"))
    return c.agg(F.count(F.lit(1)).alias("n_files"), F.sum(ok).alias("n_valid"), F.round(F.avg(ok), 6).alias("rate"))


def repository_rates(files: DataFrame, results: DataFrame) -> DataFrame:
    """``(repo_name, language, n_files, n_invalid, invalid_rate, reported_src_files,
    reported_parsed)``: the last two sum over the repository's runs, each run once, and
    are null where no run of it has reported."""
    f = latest(files.select("file_id", "repo_name", "run_id", "ingested_at"), ["file_id"], "ingested_at")
    c = f.join(checked(files).select("file_id", "parsed_as", "n_errors"), "file_id").filter("parsed_as is not null")
    bad = (F.col("n_errors") > 0).cast("long")
    rates = c.groupBy("repo_name", F.col("parsed_as").alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(bad).alias("n_invalid"), F.round(F.avg(bad), 6).alias("invalid_rate"))
    r = latest(results.select("run_id", "name", "src_files", "parse_succeeded", "ingested_at"), ["run_id"], "ingested_at")
    said = r.groupBy(F.col("name").alias("repo_name")).agg(F.sum("src_files").alias("reported_src_files"), F.sum("parse_succeeded").alias("reported_parsed"))
    return rates.join(said, "repo_name", "left")
