"""The whole detection as one chain of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import lsh, minhash, regions, trees, verify
from graftline.operators.rules import build_rules, text_kinds
from graftline.runtime import settled
from graftline.settings import Settings
from graftline.sources import files as sources


@dataclass
class Detection:
    """Tables of one run and, per stage, its items and seconds. ``shingles`` are read from
    the files again when they are asked for; the run itself has their fingerprints."""

    files: DataFrame
    regions: DataFrame
    shingles: DataFrame
    signatures: DataFrame
    groups: DataFrame
    members: DataFrame
    stages: dict[str, tuple[int, float]] = field(default_factory=dict)

    def stage_table(self) -> list[tuple[str, int, float, float]]:
        """(stage, items, seconds, share of all seconds)."""
        whole = sum(s for _, s in self.stages.values()) or 1.0
        return [(k, n, s, s / whole) for k, (n, s) in self.stages.items()]


def detect_files(files: DataFrame, settings: Settings = Settings(), progress: Callable[[str, int, float], None] | None = None) -> Detection:
    """Similar regions of files ``(file_id, path, language, source)``.

    Stages are cut by checkpoints, so a lost executor costs the tasks it held. Files that
    do not parse, regions under ``min_lines`` and groups under the similarity drop out;
    no file, region or group leaves empty tables. ``progress`` is told each stage's name,
    items and seconds as it ends."""
    stages: dict[str, tuple[int, float]] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.time()
        df = settled(df)
        told(name, df.count(), began)
        return df

    def told(name: str, items: int, began: float) -> None:
        stages[name] = (items, time.time() - began)
        if progress:
            progress(name, *stages[name])

    rules = build_rules(settings.ruleset, settings.region_filters, settings.additional_regions, settings.excluded_regions)
    began = time.time()
    look = partial(trees.found, files, rules, text_kinds(rules), settings.k, settings.min_lines)
    raw = settled(look(), "zstd")
    told("parse", raw.agg(F.sum("n_nodes")).first()[0] or 0, began)
    some = raw.filter("root_seq is not null").withColumn("region_id", F.xxhash64("path", "start_line", "end_line"))
    tree = F.when(F.col("injected"), F.col("region_id")).otherwise(F.col("file_id")).alias("tree_id")
    found = regions.deduplicated(some.drop("n_nodes", "contents"), ["start_byte", "end_byte", "rule_no", "file_id"])
    found = stage("extract", found.select("*", tree))
    began = time.time()
    if some.count() > stages["extract"][0]:  # files of one path
        some = settled(some.join(found.select("region_id", "file_id"), ["region_id", "file_id"], "left_semi"), "zstd")
    lists = some.filter(F.size("contents") > 0).select("region_id", "contents")
    told("shingle", lists.agg(F.sum(F.size("contents"))).first()[0] or 0, began)
    sig = stage("minhash", minhash.signatures_of(lists.select("region_id", F.array_distinct(F.transform("contents", trees.print_hash)).alias("h"), F.size("contents").alias("shingle_count")), settings.num_perm))
    groups, members = lsh.similar_groups(sig, found, settings)
    members = stage("lsh", members)
    checked = verify.verified(members, lists, found, found.select("region_id", "signature"), rules, settings.signature_ratio)
    kept = checked.filter(F.col("similarity") >= settings.similarity - 1e-12)
    kept = kept.join(verify.long_groups(members, found, settings.min_lines).select("group_id"), "group_id", "left_semi")
    kept = stage("verify", kept)
    at = found.select("region_id", "file_id", F.col("start_line").alias("region_start"), F.col("end_line").alias("region_end"))
    sh = look(contents=True).join(at, ["file_id", "region_start", "region_end"]).select("region_id", "seq", "content", "start_line", "end_line")
    return Detection(files, found, sh, sig, kept, members.join(kept.select("group_id"), "group_id", "left_semi"), stages)


def detect(spark: SparkSession, path: str, settings: Settings = Settings(), progress: Callable[[str, int, float], None] | None = None) -> Detection:
    """Similar regions of a file or of the files under a directory."""
    return detect_files(sources.scan(spark, path, settings), settings, progress)
