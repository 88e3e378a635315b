"""MinHash signatures of regions' shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.expressions import P, base_hash, coefficients


def _signer(num_perm: int):
    ab = np.array(coefficients(num_perm), np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            size = np.asarray(col.value_lengths().fill_null(0))
            values = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((b.num_rows, num_perm), np.int64)
            some = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[some]
            #: blocks of permutations bound the memory of one batch
            for at in range(0, num_perm, 16):
                a, c = ab[at : at + 16, 0], ab[at : at + 16, 1]
                if len(some):
                    out[some, at : at + 16] = np.minimum.reduceat((values[:, None] * a + c) % P, starts, axis=0)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, num_perm, 0))]).astype(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[size > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), sig, b.column(2)], names=["region_id", "sig", "shingle_count"])

    return sign


def signatures(shingles: DataFrame, num_perm: int = 128) -> DataFrame:
    """``(region_id, sig, shingle_count)``: minima over the set of distinct non-null
    contents; the count keeps repeated shingles. Redelivered rows, which repeat (region_id,
    seq), count once. A region whose contents are all null gets an empty array.

    The set is gathered as 8-byte hashes by a partially aggregated collect_set, and the
    permutations run over Arrow batches in numpy."""
    s = shingles.select("region_id", "seq", base_hash("content").alias("h"))
    per = s.groupBy("region_id").agg(F.collect_set("h").alias("h"), F.size(F.collect_set(F.when(F.col("h").isNotNull(), F.col("seq")))).alias("shingle_count"))
    return signatures_of(per, num_perm)


def signatures_of(sets: DataFrame, num_perm: int = 128) -> DataFrame:
    """The same of sets of base hashes, ``(region_id, h, shingle_count)``."""
    return sets.mapInArrow(_signer(num_perm), "region_id long, sig array<long>, shingle_count int")
