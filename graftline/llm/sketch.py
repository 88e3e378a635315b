"""Fast similarity sketching (Dahlgaard, Knudsen, Thorup, 2017) over token-id arrays.

A sketch has ``t`` coordinates. In round i < t every token falls into one hashed bin; in
round i >= t all tokens compete for bin i - t, so each coordinate is filled after 2t
rounds at the latest. The least (round, hash) in a bin is its value. Two sets agree in a
coordinate with probability equal to their Jaccard similarity, and the agreement count
is concentrated as that of sampling without replacement. A set of n tokens needs about
(t ln t) / n + 1 rounds, so O(t log t + n) hashes and not the t * n of plain MinHash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64
EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fast_sketch(values: np.ndarray, owner: np.ndarray, n: int, t: int, seed: int = 1) -> np.ndarray:
    """``(n, t)`` sketches; ``values[i]`` (int64) belongs to record ``owner[i]`` in 0..n-1.

    A record without tokens keeps ``EMPTY`` in every coordinate. Repeated tokens change
    nothing."""
    out = np.full(n * t, EMPTY, _U)
    v = values.astype(np.int64).view(_U)
    own = owner.astype(np.int64)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mix(v + _U(seed) * _U(0x9E3779B97F4A7C15) + _U(i + 1) * _U(0xD1B54A32D192ED03))
            bins = (h % _U(t)).astype(np.int64) if i < t else np.full(len(h), i - t, np.int64)
            #: the round is the leading part, so an earlier round always wins
            np.minimum.at(out, own * t + bins, (_U(i) << _U(48)) | (h >> _U(16)))
            full = ~(out.reshape(n, t) == EMPTY).any(axis=1)
            if full.any():
                keep = ~full[own]
                v, own = v[keep], own[keep]
                if not len(v):
                    break
    return out.reshape(n, t)


def flatten(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and owners of a list column; null lists are empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def band_rows(ids: list[str], bands: int, rows: int, seed: int = 1):
    """A ``mapInArrow`` function: (ids..., tokens) to (ids..., band, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                values, owner = flatten(b.column(len(ids)))
                sk = fast_sketch(values, owner, b.num_rows, bands * rows, seed)
                key = np.zeros((b.num_rows, bands), _U)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = mix(key * _U(31) + sk[:, r::rows] + _U(r))
                    key = mix(key + np.arange(bands, dtype=_U)[None, :])
                rep = np.repeat(np.arange(b.num_rows), bands)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rep)) for i in range(len(ids))), pa.array(key.reshape(-1).view(np.int64))], names=[*ids, "bucket"])

    return run


def bits_apart(j: float, words: int) -> int:
    """The most bits in which two sketches of similarity ``j`` differ: four standard
    deviations above those expected, which misses 1 pair in 30,000 there and fewer above."""
    n, p = 64 * words, (1 + j) / 2
    return n - math.floor(n * p - 4 * math.sqrt(n * p * (1 - p)))


def bits_differ(j: float, words: int, a: str = "a_b", b: str = "b_b") -> Column:
    """Whether two bit sketches, in columns like ``a_b0`` and ``b_b0``, differ so much that
    the similarity is below ``j`` (``bits_apart``)."""
    differ = sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in range(words)), F.lit(0))
    return differ > bits_apart(j, words)


def bit_sketches(ids: list[str], words: int = 4, seed: int = 7, tokens: bool = True):
    """A ``mapInArrow`` function: (ids..., tokens) to (ids..., tokens, b0..), or without the
    tokens: one bit of each of 64 * words coordinates, so equal bits estimate (1 + J) / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                values, owner = flatten(b.column(len(ids)))
                with np.errstate(over="ignore"):
                    bits = (mix(fast_sketch(values, owner, b.num_rows, 64 * words, seed)) & _U(1)).astype(np.uint8)
                packed = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.int64).reshape(b.num_rows, words)
                cols = [b.column(i) for i in range(len(ids) + tokens)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(packed[:, w])) for w in range(words))], names=[*ids, *["tokens"] * tokens, *(f"b{w}" for w in range(words))])

    return run
