"""Metrics and intervals as column arithmetic, and the exact tests of small samples."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f_beta(tp: Column, fp: Column, fn: Column, beta: int = 1) -> Column:
    """F score; 0 where nothing was found or expected."""
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval; 0 and 0 for no trials."""
    p = ratio(hits, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test; 1 for no pairs."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n
    return min(1.0, 2 * tail)


def resamples(units: int, iterations: int, seed: int):
    """Rows (iteration, unit) of a bootstrap, replayable by the standard library's generator."""
    rng = random.Random(seed)
    for i in range(iterations):
        for _ in range(units):
            yield i, rng.randrange(units)


def draws(bits: np.random.MT19937, units: int, n: int) -> np.ndarray:
    """The next ``n`` values of random.Random.randrange(units), of at most 2**32 - 1 units, from the same generator's raw numbers."""
    got, left = [np.empty(0, np.int64)], n
    while left:  # a refused number is drawn anew, so no number behind the last one is used up
        raw = bits.random_raw(left) >> (32 - units.bit_length())
        got.append(raw[raw < units].astype(np.int64))
        left -= len(got[-1])
    return np.concatenate(got)


def resample_blocks(units: int, iterations: int, seed: int, most: int = 100_000):
    """Blocks (first iteration, iterations, key, position) of the draws of ``resamples``: the generator's state at each block's start.

    A block has about ``most`` draws; ``draws`` gives them from its state alone, wherever it runs.
    """
    _, state, _ = random.Random(seed).getstate()
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    size = max(1, most // max(1, units))
    for first in range(0, iterations if units else 0, size):
        n, now = min(size, iterations - first), bits.state["state"]
        yield first, n, now["key"].tobytes(), int(now["pos"])
        for _ in range(n):
            draws(bits, units, units)


def resample_table(spark: SparkSession, units: int, iterations: int, seed: int) -> DataFrame:
    """``resamples`` as a table (iteration, unit): the driver only runs through the generator, executors write the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                bits = np.random.MT19937()
                bits.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(b["key"], np.uint32), "pos": b["pos"]}}
                iteration = np.repeat(np.arange(b["first"], b["first"] + b["n"], dtype=np.int32), units)
                yield pa.RecordBatch.from_arrays([pa.array(iteration), pa.array(draws(bits, units, len(iteration)))], names=["iteration", "unit"])

    blocks = spark.createDataFrame(list(resample_blocks(units, iterations, seed)), "first int, n int, key binary, pos int")
    return blocks.mapInArrow(work, "iteration int, unit long")


def sign_flips(units: int, iterations: int, seed: int):
    """Rows (iteration, unit, sign) of a paired permutation test."""
    rng = random.Random(seed)
    for i in range(iterations):
        for u in range(units):
            yield i, u, 1 if rng.random() < 0.5 else -1
