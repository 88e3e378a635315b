"""Ignore patterns as Column predicates over relative paths.

Each pattern becomes regular expressions on the driver; matching files is one filter for
patterns of the command line and one anti join for the patterns of ignore files.
"""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.runtime import bounded, cut


def parse_list(text: str) -> list[str]:
    """Patterns between commas."""
    return [p for p in (x.strip() for x in text.split(",")) if p]


def parse_ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments are dropped."""
    return [p for p in (x.strip() for x in text.splitlines()) if p and not p.startswith("#")]


def glob_regex(glob: str, star: str = ".*", one: str = ".") -> str:
    """A glob as a regular expression without anchors; ``*`` crosses slashes unless
    ``star`` says otherwise. A bracket that is never closed stands for itself."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if not out or out[-1] != star:
                out.append(star)
        elif c == "?":
            out.append(one)
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def pattern_regex(pattern: str | None) -> str | None:
    """One Java regular expression that finds what a pattern ignores in a path relative to
    the pattern's base; None for what ignores nothing (blank and negated patterns).

    ``dir/`` ignores what lies under it; ``/x`` is compared with the whole path; other
    patterns with the path and the name, those without a slash also with every folder
    on the way, and ``**`` stands for any way between its two sides."""
    p = (pattern or "").strip()
    if not p or p.startswith("!"):
        return None
    if p.endswith("/"):
        return "(?s)^" + re.escape(p[:-1]) + "/"
    if p.startswith("/"):
        return "(?s)^" + glob_regex(p[1:]) + r"\z"
    part = lambda g: glob_regex(g, "[^/]*", "[^/]")
    ways = ["^" + glob_regex(p) + r"\z", "(?:^|/)" + part(p) + r"\z"]
    if "**" in p:
        before, after = (x.strip("/") for x in p.split("**", 1))
        if not before and not after:
            ways.append("^")
        elif not before:
            ways += ["^.*" + glob_regex(after) + r"\z", "(?:^|/)" + part(after) + r"\z"]
        elif not after:
            ways.append("^" + re.escape(before))
        else:
            ways.append("^" + glob_regex(before + "*" + after) + r"\z")
    elif "/" not in p:
        ways.append("(?:^|/)" + part(p) + r"(?:/|\z)")
    return "(?s)" + "|".join(ways)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def matches(pattern: str, rel: Column, is_dir: bool = False) -> Column:
    """Whether one pattern ignores a path relative to its base; a null path is outside
    the base and never matches, nor does a negated pattern."""
    found = pattern_regex(pattern)
    if found is None:
        return F.lit(False)
    if is_dir and pattern.endswith("/"):
        found = "(?s)^" + glob_regex(pattern[:-1]) + r"\z|(?:^|/)" + glob_regex(pattern[:-1], "[^/]*", "[^/]") + r"\z"
    return F.coalesce(rel.rlike(found), F.lit(False))


def relative(path: Column, base: Column) -> Column:
    """``path`` relative to ``base``, or null where it is not under it."""
    b = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(b), path.substr(F.length(b) + 1, F.length(path)))


def ignored(rel: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(p, rel) for p in patterns), F.lit(False))


def discover(target: str, globs: tuple[str, ...] = ("**/.*ignore",)) -> dict[str, list[str]]:
    """Patterns of the ignore files under a directory, by directory. Spark's listing hides
    dot files, so this walks on the driver; it reads ignore files only. A glob is compared
    with the file's path below ``target``, folder by folder, and ``**`` stands for any
    number of folders."""
    wanted = [re.compile("^" + "/".join("(?:[^/]+/)*" if x == "**" else glob_regex(x, "[^/]*", "[^/]") for x in g.split("/")).replace("(?:[^/]+/)*/", "(?:[^/]+/)*") + r"\Z", re.S) for g in globs]
    found: dict[str, list[str]] = {}
    for root, _, names in os.walk(target):
        for n in sorted(names):
            rel = os.path.relpath(os.path.join(root, n), target).replace(os.sep, "/")
            if any(w.search(rel) for w in wanted):
                try:
                    text = open(os.path.join(root, n), encoding="utf-8").read()
                except (OSError, UnicodeDecodeError):
                    continue
                found.setdefault(root, []).extend(parse_ignore_lines(text))
    return found


@F.pandas_udf(T.StringType())
def _regexes(patterns: pd.Series) -> pd.Series:
    return patterns.map(pattern_regex).astype(object)


def drop_by_directory(files: DataFrame, rules: DataFrame, key: str, rel: str = "rel_path") -> DataFrame:
    """Files that no pattern of their directory ignores. ``rules`` is (key, base, pattern):
    patterns of any kind, compared with the path below ``base`` (empty: the root); a file
    outside the base, or without a path, is not ignored. The rules are broadcast if they are few."""
    r = rules.select(F.col(key).alias("_k"), F.coalesce("base", F.lit("")).alias("_base"), "pattern").distinct()
    hint, _ = bounded(cut(r.select("_k", "_base", _regexes("pattern").alias("_regex")).filter("_regex is not null")))
    below = F.when(F.col("_base") == "", F.col(rel)).when(F.startswith(F.col(rel), F.concat("_base", F.lit("/"))), F.col(rel).substr(F.length("_base") + 2, F.length(rel)))
    return files.join(hint, (F.col(key) == F.col("_k")) & F.coalesce(F.regexp_like(below, F.col("_regex")), F.lit(False)), "left_anti")
