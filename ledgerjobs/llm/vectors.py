"""What the vector operators share: whole-number vectors, exact products of them, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB = 50  # bits


def whole_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """``row``, a struct of ``df``'s other columns, and ``x``: the vector's entries as floor(scale * entry), array<long>.

    Rows are left out whose vector is null or empty, or holds null or non-finite entries. Of
    several lengths the most frequent one stays, of equally frequent ones the longest, since
    vectors of different lengths cannot be compared. What lies beyond the limits of long
    becomes those limits. One small job counts the lengths.
    """
    own = df.select(F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`") for c in df.columns if c != vector]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = own.where(F.coalesce((F.size("v") > 0) & finite, F.lit(False)))
    sizes = own.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    own = own.where(F.size("v") == (sizes["size"] if sizes else 0))
    return own.select("row", F.transform("v", lambda e: F.floor(e * float(scale))).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """One row of int64 per vector of a batch."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), dtype=np.int64)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` = sum of limb i times 2 ** (``bits`` * i), in float64: all but the last are in [0, 2 ** bits), the last is signed and at most 2 ** bits."""
    out = []
    for _ in range(-(-largest(x).bit_length() // bits) - 1):
        out.append((x & (2**bits - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 numbers, exact: int64 where the result surely fits, else Python integers.

    Both sides are split into limbs so short that products of two limbs, summed over the inner
    dimension, stay below 2 ** 53 and are exact in double precision. BLAS multiplies limb by
    limb; the products are shifted and added up in whole numbers.
    """
    inner = max(a.shape[1], 1)
    bits = (52 - inner.bit_length()) // 2
    fits = inner * largest(a) * largest(b) < 2**62
    out = np.zeros((a.shape[0], b.shape[1]), dtype=np.int64 if fits else object)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            part, shift = (x @ y).astype(np.int64), bits * (i + j)
            out += part << shift if fits else part.astype(object) * (1 << shift)
    return out


def whole_sums(df: DataFrame, sums: Callable[[Iterator[np.ndarray]], Iterable[tuple[int, int]]]) -> dict[int, int]:
    """Adds up what ``sums`` makes of each task's vectors (column x): exact whole numbers by cell.

    ``sums`` takes the batches of a task and gives (cell, number). Only cells meet in the
    shuffle, and a number for each comes to the driver, so the caller has to bound them.
    Numbers of any size travel in three limbs of 50 bits, which are added up as decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = 2**LIMB - 1
        cut = [(cell, v & mask, v >> LIMB & mask, v >> 2 * LIMB) for cell, v in sums(matrix(b) for b in batches if b.num_rows) if v]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cut, strict=True)] or [pa.array([], pa.int64())] * 4, names=["cell", "low", "mid", "high"])

    parts = df.select("x").mapInArrow(run, "cell long, low long, mid long, high long").groupBy("cell")
    rows = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "mid", "high")]).collect()
    return {r["cell"]: int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << 2 * LIMB) for r in rows}
