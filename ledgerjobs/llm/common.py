"""What the text operators share: the shared folder, staged tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]`` and its complement, as Java and DuckDB both read them.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder; a cluster is refused, as its
    machines would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_GATHERED: list[list[Workspace]] = []


@contextmanager
def gathered() -> Iterator[list[Workspace]]:
    """The workspaces made meanwhile, for one who writes the result and then drops all that it was read from."""
    made: list[Workspace] = []
    _GATHERED.append(made)
    try:
        yield made
    finally:
        _GATHERED.remove(made)


class Workspace:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs nothing.

    An operator drops all but what its result reads; that goes with the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
        self._n = 0
        for made in _GATHERED:
            made.append(self)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: DataFrame) -> None:
        """Delete the staged tables but for those that ``keep`` reads."""
        kept = {f.split("/staged/")[1].split("/")[1] for df in keep for f in df.inputFiles() if "/staged/" in f}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that no added column can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def word_count(text: Column) -> Column:
    """Number of ``WORD`` runs; null counts as none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def spread(key: Column, buckets: int) -> Column:
    """Bucket of a lowercase hex digest: equal slices of its first eight digits, in their order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long")


def one_by_one(df: DataFrame, count: str, nth: str, most: int, largest: int) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 1. If ``largest``, the largest count, exceeds ``most``, rows beyond are dealt out in parts of that many."""
    if largest <= most:
        return df.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop(count)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / most)))
    dealt = df.withColumn("part", part).repartition("part", *df.columns)
    first = F.col("part") * most
    return dealt.withColumn(nth, F.explode(F.sequence(first + 1, F.least(first + most, F.col(count))))).drop("part", count)
