"""Session-level helpers shared by all operators: checkpoint folder, lineage cuts,
redelivery removal and broadcasts whose size has been checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have at most before it is broadcast.
BROADCAST_ROWS = 20_000


#: Applications whose checkpoints are cleaned already.
_seen: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session or its cluster names in
    ``spark.checkpoint.dir``. Where nothing is set, a local one is made for a local master;
    on a cluster that is an error, since no other machine could read it."""
    sc = spark.sparkContext
    _clean_checkpoints(spark)
    known = sc.getCheckpointDir()
    if known:
        return known
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graftline-checkpoint-"))
    return sc.getCheckpointDir()


def _clean_checkpoints(spark: SparkSession) -> None:
    """Have Spark remove a checkpoint's files once no table refers to it any more, unless
    the session says otherwise; where the setting cannot be reached, files stay."""
    sc, key = spark.sparkContext, "spark.cleaner.referenceTracking.cleanCheckpoints"
    if sc.applicationId in _seen:
        return
    _seen.add(sc.applicationId)
    if sc.getConf().get(key, None) is None:
        try:
            sc._jsc.sc().conf().set(key, "true")
        except AttributeError:
            return


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``cut`` for tables that a loop makes from one another: a table written to the
    checkpoint folder. A checkpointed plan keeps the size estimated from all before it, and
    over many rounds of joins these estimates multiply until the planner chokes on them; a
    written table has the size of its files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (nulls first, so a dated
    row beats an undated one). Rows that repeat a key are redeliveries of one record.

    An aggregate, not a window: equal rows collapse before the shuffle, and a key that
    is redelivered very often never has to be sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is; and
    whether it was hinted. The count stops at the bound."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


#: Rows of one key that a single task can take without trouble.
KEY_ROWS = 100_000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "n", total: int | None = None, share: int = 1000) -> DataFrame:
    """Inner join of many ``left`` rows with one ``right`` row per key, ``n`` being the
    key's rows on the left and ``total`` (counted if not given) a bound of their sum.

    Keys above 1/``share`` of all rows are broadcast (fewer than ``share`` can exist), so
    that no task gets a hot key; the others are shuffled. Where no key has more rows than
    one task can take, the join is a plain one."""
    if total is None:
        got = right.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
        total = got["total"] or 0
        if (got["most"] or 0) <= max(total // share, KEY_ROWS):
            return left.join(right, on)
    if total <= KEY_ROWS:
        return left.join(right, on)
    limit = max(total // share, KEY_ROWS)
    hot = F.broadcast(right.filter(F.col(n) > limit))
    cold = right.filter(F.col(n) <= limit)
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(cold, on))


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the number, from 1, of each row in a total ``order``: rows are sorted by
    ranges and numbered there, behind the numbers of rows in earlier ranges."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("_part").agg(F.count(F.lit(1))).collect())):
        offsets.append((part, before))
        before += n
    at = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(at, "_part").withColumn(name, (own + F.col("_before")).cast("int")).drop("_part", "_before")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str | Column, enough: int | None = None) -> DataFrame:
    """More partitions than a few small files give, for work that costs much CPU a row.

    Without keys, an input that is large enough to come in as many splits anyway (or in
    ``enough``) stays as it is: at scale no text is shuffled just to be read by more tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism * 2)
    if keys:
        return df.repartition(n, *keys)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").rstrip("bB") or "128m")
    large = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > (enough or n) * split
    return df if large else df.repartition(n)


__all__ = ["BROADCAST_ROWS", "Window", "bounded", "cut", "ensure_checkpoint_dir", "latest", "ranked", "read", "settled", "skew_join", "spread"]
