"""All near pairs inside buckets, verified where the bucket lies.

The tokens of a class are shuffled once for each of its buckets and not once for each of
its pairs, of which alike classes have many more, and no pair is written before it is
verified. Large buckets are split into groups, and any two groups meet in one cell, so a
task's memory is bounded and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.sketch import bits_apart, flatten
from graftline.runtime import spread

#: Classes and tokens of a group of a bucket, two of which one task holds at a time.
GROUP_ROWS, GROUP_TOKENS = 8000, 2_000_000
#: Pairs verified together, and tokens of a cell that are compared at once.
PAIRS, STRIPE, SLICE = 1_000_000, 32_768, 2048


def cells(rows: DataFrame, n: Column, weight: Column, id_: str = "cls", group_rows: int = GROUP_ROWS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``rows`` with ``cell``, ``side`` (the row's group) and ``cross``: a bucket of ``n`` rows
    and ``weight`` tokens is split into groups by hash, and each two groups meet in one cell;
    in a cell of two groups (``cross``) only rows of different ones are a pair."""
    g = F.greatest(F.ceil(n / F.lit(group_rows)), F.ceil(weight / F.lit(group_tokens)), F.lit(1)).cast("int")
    r = rows.withColumn("_g", g).withColumn("side", F.pmod(F.xxhash64(id_), F.col("_g")).cast("int"))
    r = r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    cell = F.least("side", "_other").cast("long") * F.col("_g") + F.greatest("side", "_other")
    return r.withColumn("cell", cell).withColumn("cross", F.col("side") != F.col("_other")).drop("_g", "_other")


def _shared(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of common tokens of the pairs of rows (a, b); row i has the distinct tokens
    ``values[starts[i] : starts[i] + sizes[i]]``."""
    used, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    n = sizes[used]
    at = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    _, token, holders = np.unique(values[at], return_inverse=True, return_counts=True)
    #: a token of one row is shared by no pair
    common = holders > 1
    keep = common[token]
    token, row = (np.cumsum(common) - 1)[token[keep]], np.repeat(np.arange(len(used)), n)[keep]
    out = np.zeros(len(a), np.int64)
    for lo in range(0, int(common.sum()), SLICE):
        here = (token >= lo) & (token < lo + SLICE)
        dense = np.zeros((len(used), SLICE), bool)
        dense[row[here], token[here] - lo] = True
        packed = np.packbits(dense, axis=1).view(np.uint64)
        for k in range(0, len(a), STRIPE):
            out[k : k + STRIPE] += np.bitwise_count(packed[a[k : k + STRIPE]] & packed[b[k : k + STRIPE]]).sum(axis=1, dtype=np.int64)
    return out


def _near(whole: pa.Table, threshold: float, apart: int, words: int) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) of whole cells, whose rows are sorted by size within a cell."""
    bucket, cell, cross, side, cls, _, comp, *bits = (whole.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(7 + words))
    tokens = whole.column(7 + words).combine_chunks()
    values, _ = flatten(tokens)
    size = np.asarray(tokens.value_lengths()).astype(np.int64)
    starts = np.cumsum(size) - size
    new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
    edges = np.concatenate([[0], new, [len(bucket)]])
    end, at_cell = np.repeat(edges[1:], np.diff(edges)), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    bits = [x.view(np.uint64) for x in bits]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def verified() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.argsort(at_cell[a], kind="stable")
        a, b = a[order], b[order]
        both = np.concatenate([_shared(values, starts, size, x, y) for x, y in zip(*(np.split(z, np.flatnonzero(np.diff(at_cell[a])) + 1) for z in (a, b)))])
        near = both >= threshold * (size[a] + size[b] - both) - 1e-9
        x, y = cls[a[near]], cls[b[near]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    #: rows i and i + step, for each step that leaves any in one cell
    i, step, held = np.arange(len(bucket)), 1, 0
    while len(i):
        i = i[i + step < end[i]]
        #: sizes rise: who is too small for one is so for all behind it
        i = i[size[i] >= size[i + step] * threshold - 1e-9]
        j = i + step
        meet = (comp[i] != comp[j]) & (~cross[i] | (side[i] != side[j]))
        a, b = i[meet], j[meet]
        if words and len(a):
            differ = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits)
            a, b = a[differ <= apart], b[differ <= apart]
        if len(a):
            found.append((a, b))
            held += len(a)
        if held >= PAIRS:
            yield verified()
            held = 0
        step += 1
    if found:
        yield verified()


def near_in_cells(threshold: float, words: int):
    """A ``mapInArrow`` function from (bucket, cell, cross, side, cls, size, comp, b0.., tokens),
    sorted by bucket, cell and size, to the near pairs (a, b) of different components."""
    apart = bits_apart(threshold, words) if words else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            bucket, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
            #: rows before the batch's last cell, which may go on in the next batch
            n = int(np.count_nonzero((bucket != bucket[-1]) | (cell != cell[-1])))
            if held and (n or last != (bucket[-1], cell[-1])):
                yield from _near(pa.Table.from_batches([*held, b.slice(0, n)]), threshold, apart, words)
                held = []
            elif n:
                yield from _near(pa.Table.from_batches([b.slice(0, n)]), threshold, apart, words)
            held.append(b.slice(n))
            last = (bucket[-1], cell[-1])
        if held:
            yield from _near(pa.Table.from_batches(held), threshold, apart, words)

    return run


def near_in_buckets(rows: DataFrame, sketched: DataFrame, threshold: float, words: int) -> DataFrame:
    """Distinct near pairs (a, b), a < b, of ``rows`` (bucket, cls, size, comp, n, weight) that
    share a bucket and no component; ``sketched`` is (cls, tokens, b0..)."""
    split = cells(rows, F.col("n"), F.col("weight")).join(sketched, "cls")
    cols = ["bucket", "cell", "cross", "side", "cls", "size", "comp", *(f"b{w}" for w in range(words)), "tokens"]
    return spread(split.select(*cols), "bucket", "cell").sortWithinPartitions("bucket", "cell", "size").mapInArrow(near_in_cells(threshold, words), "a long, b long").distinct()
