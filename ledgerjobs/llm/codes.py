"""Vector code compression: product quantisation in whole numbers, with exact products by limbs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import Workspace
from .vectors import exact_product, matrix, whole_sums, whole_vectors


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts; zeros fill up the last one if need be, which changes no distance."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return [x[:, i * width : (i + 1) * width] for i in range(parts)]


def squares(x: np.ndarray) -> np.ndarray:
    """Each row's sum of squares, exact."""
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return (x * x).sum(axis=1) if reach * reach * x.shape[1] < 2**62 else (x.astype(object) ** 2).sum(axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of the book's nearest entries, and the squared distance."""
    far = squares(book)[None, :] - 2 * exact_product(x, book.T)
    best = far.argmin(axis=1)  # the first of equal ones
    return best, squares(x) + far[np.arange(len(x)), best]


def first_books(staged: DataFrame, vec_id: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the ``entries`` vectors of smallest id."""
    rows = staged.select(F.col(f"row.`{vec_id}`").alias("id"), "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    return cut(np.array([r["x"] for r in rows], dtype=np.int64), parts)


def moved(staged: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of the parts nearest to it; unused ones stay."""
    entries, width = books[0].shape
    shared = staged.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[np.ndarray]) -> Iterable[tuple[int, int]]:
        total = np.zeros((len(shared.value), entries, width + 1), dtype=object)
        for x in batches:
            for p, (part, book) in enumerate(zip(cut(x, len(shared.value)), shared.value, strict=True)):
                own = nearest(part, book)[0] == np.arange(entries)[:, None]
                total[p] += exact_product(own.astype(np.int64), np.pad(part, ((0, 0), (0, 1)), constant_values=1)).astype(object)
        return enumerate(total.ravel())

    found = whole_sums(staged, sums)
    shared.unpersist()
    out = []
    for p, book in enumerate(books):
        book = book.copy()
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if n := found.get(at + width, 0):
                book[e] = [found.get(at + i, 0) // n for i in range(width)]
        out.append(book)
    return out


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Entries become floor(``scale`` * entry). Each of ``parts`` equal parts has a codebook that
    starts as that part of the ``entries`` vectors of smallest id and is moved ``rounds`` times to
    the floors of the means. Tasks assign parts by exact products (``vectors.exact_product``)
    and add up their own; the driver gets sums and counts of the books' entries alone.
    ``code`` has two hex digits a part, so ``entries`` is at most 256. ``label_error`` is
    ``error`` summed over equal labels, which labels of a third of all rows do not slow down.

    Left out are rows whose vector is null or empty, holds null or non-finite entries, or has
    another length than most. Nulls among ids come last and nulls among labels are one label;
    vectors of equal ids are told apart by their entries; repeated rows each have a row. With
    fewer than ``entries`` vectors the books are smaller; if the length is no multiple of
    ``parts``, zeros fill up the last part. Entries stop at the limits of long; an error beyond
    them is null, as is then the sum of its label. An empty table gives an empty result, and
    other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, for 1 to 256 entries")
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession)
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    staged = space.stage(whole_vectors(slim, "v", scale), "vectors")
    books = first_books(staged, "vec_id", parts, entries) if staged.take(1) else []
    for _ in range(rounds if books else 0):
        books = moved(staged, books)
    shared = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(part, book) for part, book in zip(cut(matrix(batch), len(shared.value)), shared.value, strict=True)]
                codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                errors = [e if e < 2**63 else None for e in map(int, sum(far.astype(object) for _, far in found))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())], names=["row", "code", "error"])

    kind = staged.schema["row"].dataType.simpleString()
    coded = space.stage(staged.mapInArrow(code, f"row {kind}, code string, error long").select("row.vec_id", F.struct("row.label").alias("label"), "code", "error"), "coded")
    long = F.col("total").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")) & (F.col("known") == F.col("n"))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("error").alias("known"), F.count("*").alias("n"))
    labels = space.stage(sums.select("label", F.when(long, F.col("total").cast("long")).alias("label_error"), "n"), "labels")
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    out = attach(coded, labels, ["label"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    space.drop(out)
    return out
