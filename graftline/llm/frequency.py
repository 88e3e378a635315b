"""Problem 4: frequency of every distinct value, by heavy-light aggregation.

One scan finds heavy values and hot records by mergeable frequent-items sketches over
64-bit fingerprints. The heavy values, bounded in number and length, are broadcast with a
slot each: their rows travel as (record, slot, place) numbers, never as strings, and end in
one exact counter array per partition. Only the other values are shuffled by value. The two
count tables are disjoint and their union is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Heavy values at most and their greatest length, which bound the broadcast, and counters
#: of the sketch.
HEAVY, HEAVY_CHARS, COUNTERS = 1000, 1000, 16_384
#: A record with more than this share of all rows is hot, and is spread over so many tasks.
HOT_SHARE, SALTS = 0.001, 64


def _print(c: str) -> Column:
    return F.xxhash64(c)


def sketched(rows: DataFrame, record: str, value: str, heavy: int, counters: int) -> tuple[list[int], list[int]]:
    """Fingerprints of at most ``heavy`` frequent values of up to ``HEAVY_CHARS``
    characters, and of the records that may hold more than ``HOT_SHARE`` of all rows (fewer
    than 2,000 can). Both are found over all rows and are hints: no count depends on them."""
    short = F.when(F.length(value) <= HEAVY_CHARS, _print(value))
    got = rows.select(short.alias("v"), _print(record).alias("r")).agg(
        F.expr(f"approx_top_k(v, {heavy}, {counters})").alias("v"), F.expr(f"approx_top_k(r, {heavy}, {counters})").alias("r"), F.count(F.lit(1)).alias("n"))
    top = got.first()
    return sorted(x["item"] for x in top["v"] or [] if x["item"] is not None), sorted(x["item"] for x in top["r"] or [] if x["item"] is not None and x["count"] > HOT_SHARE * top["n"])


def _slots(rows: DataFrame, value: str, prints: list[int]) -> DataFrame:
    """``(slot, value)`` of the heavy fingerprints: one value each, the least; another one
    of the same fingerprint is counted with the others."""
    df = rows.sparkSession.createDataFrame([(x,) for x in prints], "_p long")
    found = rows.select(value).filter(F.length(value) <= HEAVY_CHARS).withColumn("_p", _print(value)).join(F.broadcast(df), "_p").groupBy("_p").agg(F.min(value).alias(value)).collect()
    return rows.sparkSession.createDataFrame([(i, r[value]) for i, r in enumerate(sorted(found))], f"slot int, {value} {rows.schema[value].dataType.simpleString()}")


def _count_arrays(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, records = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False)
            rows += np.bincount(slot, weights=b.column(1).to_numpy(zero_copy_only=False), minlength=size).astype(np.int64)
            records += np.bincount(slot, minlength=size)
        at = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(rows[at]), pa.array(records[at])], names=["slot", "n_rows", "n_records"])

    return count


def _heavy_counts(rows: DataFrame, record: str, key: list[str], slots: DataFrame, value: str, hot: list[int], size: int) -> DataFrame:
    """``(slot, n_rows, n_records)``: per record first, then in one array per partition."""
    h = rows.join(F.broadcast(slots), value).select(*key, *([record] if record not in key else []), "slot")
    #: a record's rows meet in one task, as numbers; those of a hot record in many
    place = [record]
    if hot:
        h = h.withColumn("_s", F.when(_print(record).isin(hot), F.pmod(F.xxhash64(*key), F.lit(SALTS))).otherwise(0).cast("int"))
        place = [record, "_s"]
    h = h.repartition(*place)
    per = h.groupBy(*place, "slot", *[k for k in key if k != record]).agg(F.lit(1).alias("one")).groupBy(*place, "slot").agg(F.count(F.lit(1)).alias("n"))
    if hot:
        is_hot = _print(record).isin(hot)
        rest = per.filter(is_hot).groupBy(record, "slot").agg(F.sum("n").alias("n"))
        per = per.filter(~is_hot).select(record, "slot", "n").unionByName(rest)
    counted = per.select("slot", F.col("n").cast("double")).mapInArrow(_count_arrays(size), "slot int, n_rows long, n_records long")
    return counted.groupBy("slot").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def value_frequencies(df: DataFrame, record: str = "region_id", value: str = "content", key: list[str] | None = None, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """``(value, n_rows, n_records)`` for every distinct non-null value: rows that hold
    it and distinct records that hold it.

    ``key`` (default record and ``seq``) names one row; rows that repeat it are
    redeliveries and count once per value. Values are exact strings, the empty string is
    one of them; a null value or null record is not counted; an empty table gives none.
    Other columns are ignored."""
    key = key or [record, "seq"]
    names = list(dict.fromkeys([*key, record, value]))
    rows = df.select(*names).filter(F.col(record).isNotNull() & F.col(value).isNotNull())
    prints, hot = sketched(rows, record, value, heavy, counters)
    slots = _slots(rows, value, prints)
    counted = _heavy_counts(rows, record, key, slots, value, hot, max(1, len(prints)))
    #: a thousand rows at most, each with its value
    counted = counted.join(F.broadcast(slots), "slot").select(value, "n_rows", "n_records")
    rest = rows.join(F.broadcast(slots.select(value)), value, "left_anti")
    #: one shuffle by value: no value is heavy there, and what follows needs no other
    rest = rest.repartition(value).groupBy(value, *[n for n in names if n != value]).agg(F.lit(1).alias("one"))
    rest = rest.groupBy(value, record).agg(F.count(F.lit(1)).alias("n")).groupBy(value).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))
    return counted.unionByName(rest.select(value, "n_rows", "n_records"))


def marked(df: DataFrame, record: str = "region_id", value: str = "content", rare: int = 1, common: float = 0.05) -> DataFrame:
    """``value_frequencies`` with ``mark``: ``rare`` for at most ``rare`` records,
    ``common`` for at least the share ``common`` of all records in the table (also of
    those whose values are all null), else null. A value that is both is ``rare``."""
    total = df.select(F.col(record)).distinct().agg(F.count(record).alias("t")).first()["t"]
    f = value_frequencies(df, record, value)
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= F.lit(common) * F.lit(total), "common")
    return f.withColumn("mark", mark)
