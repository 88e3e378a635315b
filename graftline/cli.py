"""Command line: detect, inspect and list-ruleset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graftline.operators import diff, inspect, report
from graftline.operators.rules import parse_region_specs, ruleset
from graftline.plans.pipeline import detect
from graftline.settings import Settings
from graftline.sources import files as sources
from graftline.sources.ignore import parse_list


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graftline", description="Find structurally similar code.")
    p.add_argument("--ruleset", choices=("none", "default", "loose"), default="default")
    p.add_argument("--log-level", default="ERROR")
    p.add_argument("--version", action="version", version="0.1.0")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect", help="report similar regions under a path")
    d.add_argument("path")
    d.add_argument("--similarity", type=int, default=100, metavar="PERCENT")
    d.add_argument("--min-lines", type=int, default=5)
    d.add_argument("--format", choices=("console", "sarif"), default="console")
    d.add_argument("--output")
    d.add_argument("--ignore", default="", help="patterns between commas")
    d.add_argument("--ignore-files", default="**/.*ignore", help="ignore-file globs between commas")
    d.add_argument("--add-regions", action="append", default=[], metavar="LANG:TYPE,...")
    d.add_argument("--exclude-regions", action="append", default=[], metavar="LANG:TYPE,...")
    d.add_argument("--ignore-node-types", default="", help="kept for compatibility; has no effect")
    d.add_argument("--diff", action="store_true")
    d.add_argument("--fail", action="store_true")
    d.add_argument("--verbose", action="store_true")
    d.add_argument("--progress", action="store_true", help="print each stage as it ends")
    t = sub.add_parser("inspect", help="show a file's normalised tokens")
    t.add_argument("path")
    t.add_argument("--source", action="store_true", help="show the transformed source instead")
    t.add_argument("--compare", action="store_true", help="show the source next to it")
    r = sub.add_parser("list-ruleset", help="list the rules of a ruleset")
    r.add_argument("name", choices=("none", "default", "loose"))
    r.add_argument("--language")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if nothing could be compared, or with --fail if a group was found."""
    args = _parser().parse_args(argv)
    if args.command == "list-ruleset":
        for r in ruleset(args.name):
            if not args.language or args.language in r.languages:
                print(f"{','.join(r.languages)}\t{r.action.value}\t{r.name}\t{' '.join(r.match.kinds)}")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    if args.command == "inspect":
        f = sources.scan(spark, args.path)
        nodes = sources.parsed(sources.parse_files(f, tolerant=True)).join(f.select(F.col("file_id").alias("tree_id"), F.col("language").alias("shingle_language")), "tree_id")
        rules, files = ruleset(args.ruleset), f.select("file_id", "source")
        if args.compare:
            for row in inspect.comparison(nodes, rules, files).orderBy("tree_id", "line").toLocalIterator():
                print(f"{row[1]:5d}  {row[2]:<58.58s} | {row[3] or ''}")
        else:
            view = inspect.transformed_source(nodes, rules, files) if args.source else inspect.tokens_by_line(nodes, rules)
            for row in view.orderBy("tree_id", "line").toLocalIterator():
                print(f"{row[1]:5d}  {row[2]}")
        for row in inspect.totals(inspect.tokens_by_line(nodes, rules)).toLocalIterator():
            print(f"{row[1]} lines, {row[2]} tokens")
        return 0
    try:
        settings = Settings.for_cli(args.similarity, ruleset=args.ruleset, min_lines=args.min_lines, ignore_patterns=tuple(parse_list(args.ignore)), ignore_files=tuple(parse_list(args.ignore_files)), additional_regions=parse_region_specs(args.add_regions), excluded_regions=parse_region_specs(args.exclude_regions))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    tell = (lambda name, n, seconds: print(f"{name}: {n} in {seconds:.1f} s", file=sys.stderr, flush=True)) if args.progress else None
    found = detect(spark, args.path, settings, tell)
    if args.format == "sarif":
        text = report.write_sarif(report.sarif_results(found.groups, found.members, found.regions), args.output)
        if not args.output:
            print(text)
    else:
        out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
        order = report.display_order(found.groups, found.members, found.regions)
        shown = report.display_lines(found.groups, found.members, found.regions).join(order.select("group_id", "similarity", "mean_lines"), "group_id")
        for row in shown.orderBy("similarity", "mean_lines", "group_id", "ordinal").toLocalIterator():
            print(row["line"], file=out)
        for row in report.language_summary(found.regions, found.groups, found.members).orderBy(F.col("language") == "total", "language").toLocalIterator():
            print("\t".join(map(str, row)), file=out)
        if args.output:
            out.close()
    if args.diff:
        for row in diff.group_diffs(found.members, found.regions, found.files, texts=True).orderBy("group_id").toLocalIterator():
            print("identical" if row["identical"] else "\n".join(diff.side_by_side(list(row["la"]), list(row["lb"]))))
    if args.verbose:
        for name, n, seconds, share in found.stage_table():
            print(f"{name}\t{n}\t{seconds:.2f} s\t{share:.0%}")
    if not found.stages["minhash"][0]:
        return 1
    return int(args.fail and found.stages["verify"][0] > 0)


if __name__ == "__main__":
    raise SystemExit(main())
