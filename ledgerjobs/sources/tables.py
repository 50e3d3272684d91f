"""Tables at the edges: typed CSV in, Parquet or CSV out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The orders in which the tables are written.
ORDERS = {
    "transactions": ("transaction_date", "account_id", "transaction_id"),
    "snapshots": ("balance_date", "account_id"),
    "groups": ("-transaction_count", "counterparty_key"),
    "review_queue": ("-maximum_abs_cents", "-total_abs_cents", "counterparty_key"),
    "peaks": ("-amount_cents", "episode_id"),
    "daily": ("date", "account_id"),
}


class Unfit(ValueError):
    """Data that a strict run refuses."""


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """The table marked to be broadcast if it has at most ``most_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


class Staging:
    """Tables written to the folder that the cluster shares, so that several jobs read one result and a lost executor costs nothing.

    That is ``spark.checkpoint.dir`` of the session; where it is unset a local master gets a
    temporary folder, a cluster is refused. A run's tables lie together and go with ``drop``.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
                raise Unfit("spark.checkpoint.dir must name a folder that the whole cluster shares")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/staged/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def in_order(self, name: str) -> DataFrame:
        """The table ``name``, read so that each task gets the rows that one task wrote, in the order in which it wrote them."""
        alone = self.spark.newSession()  # in which a file is one part and a part is one file
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            alone.conf.set(key, 2**50)
        return alone.read.parquet(f"{self.root}/{name}")

    def drop(self, *keep: DataFrame) -> None:
        """Deletes the run's tables but for those that ``keep`` reads."""
        kept = {f.split(f"{_plain_path(self.root)}/")[1].split("/")[0] for df in keep for f in df.inputFiles() if f"{_plain_path(self.root)}/" in f}
        here, fs = _file_system(self.spark, self.root)
        for status in fs.listStatus(here) if fs.exists(here) else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)


def _plain_path(path: str) -> str:
    return re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", path)


#: Where a row stands in a table of files: by the file's path, the part of it that a task reads, and the line in that part.
PLACE = "struct<path:array<string>,block:bigint,line:bigint>"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = (), exact: bool = False, filled: bool = False, placed: bool = False) -> DataFrame:
    """A CSV table with a header, of one file or of all below a folder; blanks are null.

    With ``placed``, ``load_order`` (``PLACE``) orders rows as the files have them: files by
    their paths, however the reader packs and splits them.

    Columns that ``required`` names must stand in the header, with ``exact`` those of the schema
    in its order and no others; with ``filled`` a table without rows is refused.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).option("recursiveFileLookup", "true").csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise Unfit(f"{path}: missing columns {missing}")
    if exact and header != schema.names:
        raise Unfit(f"{path}: columns {header} are not {schema.names}")
    out = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).option("recursiveFileLookup", "true").csv(path)
    if placed:
        place = F.struct(F.split("_metadata.file_path", "/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        out = out.select("*", place.cast(PLACE).alias("load_order"))
    if filled and out.isEmpty():
        raise Unfit(f"{path}: no rows")
    return out


def ordered(df: DataFrame, order: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """Rows range-parted and sorted by ``order``, in which ``-name`` stands for descending; so files in their order are the table in its order."""
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def place_of(order: Column | None) -> Column:
    """``load_order`` of any kind as a ``PLACE``: one that is a number counts lines of one file, without one rows stand as they are read (right for one file only)."""
    line = F.monotonically_increasing_id() if order is None else order.cast("long")
    return F.struct(F.array().cast("array<string>").alias("path"), F.lit(0).cast("long").alias("block"), line.alias("line"))


def load_order(df: DataFrame) -> Column:
    """The place of a row in its table, see ``read_table`` and ``place_of``."""
    if "load_order" not in df.columns:
        return place_of(None)
    return F.col("load_order") if isinstance(df.schema["load_order"].dataType, T.StructType) else place_of(F.col("load_order"))


def write_table(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, form: str = "parquet", order: tuple[str, ...] = (), refuse: dict[str, Column] | None = None) -> None:
    """Replaces ``path``; refuses an empty table and columns that are not the declared ones. ``order`` sorts at the sink only, see ``ordered`` and ``ORDERS``.

    ``refuse`` names conditions that no row may meet: the table is refused if one does.

    The table is written beside ``path`` and takes its place by renaming only when all of it is
    there: a job that fails, or a table that is refused, leaves the old one. Rows, and those
    that meet a condition, are counted while they are written, so nothing is read twice.
    """
    if columns is not None and set(columns) != set(df.columns):
        raise Unfit(f"columns {sorted(df.columns)} are not {sorted(columns)}")
    out = df.select(*(columns or df.columns))
    out = ordered(out, order) if order else out
    out = out.select(*[F.array_join(c, ";").alias(c) if form == "csv" and t.startswith("array") else F.col(c) for c, t in out.dtypes])
    seen = Observation()
    # in the folder of ``path``, under a name that readers pass over
    folder, _, name = path.rstrip("/").rpartition("/")
    beside = f"{folder}/" if folder else ""
    new, old = (f"{beside}_{name}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    gates = refuse or {}
    writer = out.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(f"bad {k}") for k, c in gates.items()]).write
    try:
        writer.option("header", True).csv(new) if form == "csv" else writer.parquet(new)
        if not seen.get["rows"]:
            raise Unfit("an empty table is not written")
        if bad := {k: seen.get[f"bad {k}"] for k in gates if seen.get[f"bad {k}"]}:
            raise Unfit(f"rows that are refused: {bad}")
        _swap(df.sparkSession, path, new, old)
    finally:
        _delete(df.sparkSession, new)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def _swap(spark: SparkSession, path: str, new: str, old: str) -> None:
    """Two renames; if the second fails the first is taken back."""
    here, fs = _file_system(spark, path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    had = fs.exists(here)
    if had and not fs.rename(here, jvm_path(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(jvm_path(new), here):
        if had:
            fs.rename(jvm_path(old), here)
        raise OSError(f"{new} cannot be moved")
    _delete(spark, old)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``position``, from 1: where a row stands when its files are read in the order of their names."""
    rows = spark.read.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    before = F.sum("count").over(Window.orderBy("file_").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = rows.groupBy("file_").count().select("file_", F.coalesce(before, F.lit(0)).alias("before_"))
    return rows.join(F.broadcast(files), "file_").withColumn("position", F.col("before_") + F.col("row_") + 1).drop("file_", "row_", "before_")


def order_violations(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(position, key): rows of ``read_ordered`` that come before the row in front of them by ``order``, whose descending keys are numbers."""
    key = F.struct(*[(-F.col(c[1:])).alias(c[1:]) if c.startswith("-") else F.col(c) for c in order])
    here = rows.select("position", key.alias("key"))
    front = rows.select((F.col("position") + 1).alias("position"), key.alias("front"))
    return here.join(front, "position").where("key < front").select("position", "key")


def require_empty(violations: DataFrame, what: str = "violations") -> None:
    """Strict mode: raises with a few offenders."""
    if found := violations.limit(5).collect():
        raise Unfit(f"{what}: " + "; ".join(":".join(map(str, r)) for r in found))
