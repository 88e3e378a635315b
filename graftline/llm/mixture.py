"""Problem 9: mix sources to target weights by Poisson replication.

The mixture is the largest in which every source can reach its share: a source of s
tokens that may repeat m times supplies m * s at most. Each document's number of copies is
the inverse of a Poisson distribution, cut at m, at a uniform number hashed from the
document, the mix and a seed. The Poisson mean is solved so that the cut distribution has
the source's repetition rate as its mean. Copies are shuffled by a hash of their own.

A first scan counts the tokens of the sources that some mix names. The draw needs only a
document's id and source, so a second scan draws and then numbers the tokens of the drawn
texts: no text is written or shuffled before the global shuffle of the copies.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm.truncation import clean_source
from graftline.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 11
#: Target rows at most, which bounds what is broadcast.
TARGETS = 10_000
#: A uniform number has 53 bits: probabilities nearer to 0 or 1 than this decide nothing.
TINY = 2.0**-55
_loaded: dict = {}


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read where the driver runs and shipped to the executors."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encoding(shared):
    data = shared.value
    key = hash(data)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _loaded.clear()
        _loaded[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, text: bool = True) -> DataFrame:
    """``documents`` with ``n_tokens``, with or without their ``text``; null texts have 0.
    Texts go to the tokenizer whole. ``tokenizer`` names a vocabulary file that the driver
    can read."""
    names = documents.columns
    at = names.index("text")
    kept = [i for i, c in enumerate(names) if text or c != "text"]
    shared = vocabulary(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared)
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(n, pa.int64())], names=[*(names[i] for i in kept), "n_tokens"])

    schema = ", ".join(f"`{names[i]}` {documents.schema[i].dataType.simpleString()}" for i in kept)
    return spread(documents).mapInArrow(run, f"{schema}, n_tokens long")


def cut_poisson(rate: float, cap: int) -> tuple[int, list[float]]:
    """``(base, cdf)`` of the Poisson distribution cut at ``cap`` whose mean is ``rate``:
    ``base`` copies are sure, and ``cdf`` has P(copies <= k) from there on as long as it
    can decide. A uniform number u stands for base + (number of cdf values below u)
    copies. A rate of ``cap`` or more gives every document ``cap`` copies; any cap and any
    mean will do, since the probabilities are summed from their logarithms."""
    if cap <= 0 or rate <= 0:
        return 0, []
    if rate >= cap:
        return cap, []
    k = np.arange(cap, dtype=np.float64)
    factorials = np.array([math.lgamma(x + 1) for x in range(cap)])

    def below(lam: float) -> np.ndarray:
        return np.minimum(np.cumsum(np.exp(k * math.log(lam) - lam - factorials)), 1.0)

    lo, hi = 0.0, max(1.0, rate)
    while np.sum(1 - below(hi)) < rate:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        if not lo < mid < hi:
            break
        lo, hi = (mid, hi) if np.sum(1 - below(mid)) < rate else (lo, mid)
    cdf = below((lo + hi) / 2)
    base = int(np.searchsorted(cdf, TINY))
    return base, [float(x) for x in cdf[base:] if x < 1 - TINY]


def unit(*c: Column) -> Column:
    return (F.xxhash64(*c).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / float(1 << 53)


def plan(sizes: list[tuple[str, int]], targets: list[tuple[str, str, float, int]]) -> list[tuple]:
    """(mix, source, share, cap, rate, base, cdf) for each target row. Sources without
    tokens cannot reach any share: they are left out of the total's bound and get rate 0."""
    have = dict(sizes)
    total: dict[str, float] = {}
    for mix, source, share, cap in targets:
        if share > 0 and cap > 0 and have.get(source, 0) > 0:
            total[mix] = min(total.get(mix, math.inf), cap * have[source] / share)
    out = []
    for mix, source, share, cap in targets:
        rate = share * total.get(mix, 0.0) / have[source] if have.get(source, 0) > 0 and cap > 0 else 0.0
        rate = min(rate, float(max(cap, 0)))
        rate = float(cap) if rate > cap * (1 - 1e-12) else rate
        out.append((mix, source, float(share), int(cap), rate, *cut_poisson(rate, cap)))
    return out


class Mixture:
    """One mixture of ``documents``: the plan is made once, copies and report follow.

    Documents without a source of the mix, with a null source or text, or without tokens
    are in no mixture. Sources are compared in one spelling. Null or negative shares and
    caps count as 0. A doc_id in several rows is drawn alike in each. The target table is
    read to the driver (a row per mix and source, ``TARGETS`` at most, more are an error);
    the documents never are."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED):
        self.spark, self.tokenizer, self.seed = documents.sparkSession, tokenizer, seed
        share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
        wanted = targets.select("mix_name", clean_source().alias("source"), share, F.coalesce("max_repeats", F.lit(0))).distinct().limit(TARGETS + 1).collect()
        if len(wanted) > TARGETS:
            raise ValueError(f"more than {TARGETS} target rows cannot be broadcast")
        names = sorted({r[1] for r in wanted if r[1] is not None})
        d = documents.select("doc_id", clean_source().alias("source"), "text").filter(F.col("source").isin(*names) & (F.length("text") > 0))
        self.documents = d
        #: three narrow columns a document, all that the draw and the report need
        self.sized = cut(with_tokens(d, tokenizer, text=False).filter("n_tokens > 0"))
        sizes = self.sized.groupBy("source").agg(F.sum("n_tokens")).collect()
        schema = "mix_name string, source string, target_share double, max_repeats int, rate double, base int, cdf array<double>"
        self.rows = self.spark.createDataFrame(plan([tuple(r) for r in sizes], [tuple(r) for r in wanted]), schema)

    def _drawn(self, d: DataFrame) -> DataFrame:
        """``d`` once for each mix that draws it, with the number of ``copies``."""
        u = unit(F.lit(self.seed), F.col("mix_name"), F.col("doc_id"))
        copies = F.col("base") + F.size(F.filter("cdf", lambda x: F.col("u") > x))
        return d.join(F.broadcast(self.rows), "source").withColumn("u", u).withColumn("copies", copies).filter("copies > 0")

    def copies(self) -> DataFrame:
        """``(mix_name, position, doc_id, copy, source, n_tokens, text)``, shuffled globally."""
        per_source = self.rows.groupBy("source").agg(F.collect_list(F.struct("mix_name", "base", "cdf")).alias("mixes"))
        u = lambda m: unit(F.lit(self.seed), m["mix_name"], F.col("doc_id"))
        drawn = F.transform("mixes", lambda m: F.struct(m["mix_name"].alias("mix_name"), (m["base"] + F.size(F.filter(m["cdf"], lambda x: u(m) > x))).alias("copies")))
        #: a text is tokenised once, whatever the number of mixes and copies it is in
        d = self.documents.join(F.broadcast(per_source), "source").select("doc_id", "source", "text", F.filter(drawn, lambda x: x["copies"] > 0).alias("mixes")).filter(F.size("mixes") > 0)
        d = with_tokens(d, self.tokenizer).filter("n_tokens > 0")
        each = d.select(F.explode("mixes").alias("m"), "doc_id", "source", "n_tokens", "text")
        each = each.select("m.mix_name", F.explode(F.sequence(F.lit(1), F.col("m.copies"))).alias("copy"), "doc_id", "source", "n_tokens", "text")
        each = each.withColumn("position", F.xxhash64(F.lit(self.seed), F.lit("place"), "mix_name", "doc_id", "copy"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        #: by hash, not by range: finding range bounds would run the tokenizer once more
        shuffled = each.repartition(n, "position")
        return shuffled.sortWithinPartitions("position").select("mix_name", "position", "doc_id", "copy", "source", "n_tokens", "text")

    def report(self) -> DataFrame:
        """``(mix_name, source, target_share, actual_share, tokens, copies, documents,
        max_repeats, rate)`` of each target row."""
        drawn = self._drawn(self.sized)
        got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").cast("long").alias("copies"), F.count(F.lit(1)).alias("documents"))
        whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        report = self.rows.drop("cdf", "base").join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
        return report.select("mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("copies"), zero("documents"), "max_repeats", F.round("rate", 6).alias("rate"))


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The shuffled copies and the report of a ``Mixture``."""
    m = Mixture(documents, targets, tokenizer, seed)
    return m.copies(), m.report()
