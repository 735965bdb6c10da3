"""Durable intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 300_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is a single local JVM (tests), a
    temporary folder stands in; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    return _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quire-"))


class Scratch:
    """Collects the tables materialised inside a ``with`` block, to be dropped once nothing reads them any more.

    ``with Scratch() as s: out = operator(...); out.write...; s.drop(spark)`` cleans up
    after one operator. Blocks of different threads do not see each other; tables
    of an inner block belong to the inner block.
    """

    def __init__(self):
        self.paths: list[str] = []
        self._read_by: list = []

    def __enter__(self) -> Scratch:
        self._outer = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._outer)

    def feeds(self, df: DataFrame) -> bool:
        """Whether ``df`` reads one of the tables."""
        own = [p.split(":")[-1].lstrip("/") for p in self.paths]
        return bool(own) and any(p in f for f in df.inputFiles() for p in own)

    def idle(self, spark: SparkSession) -> bool:
        """Whether no frame of this driver reads one of the tables any more.

        Every plan over a table shares its file index, so the tables are idle
        once the collector has taken the indexes.
        """
        gc.collect()
        spark._jvm.System.gc()
        return all(ref.get() is None for ref in self._read_by)

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths.clear()
        self._read_by.clear()


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
#: Applications whose folder is marked to go when the driver ends.
_marked: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """The application's folder among the intermediate tables; it goes with the driver."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/quire/{app}"
    if app not in _marked:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        _marked.add(app)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path for an intermediate table, noted in the open ``Scratch``."""
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (scratch := _scratch.get()) is not None:
        scratch.paths.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage the way a reliable checkpoint does, with column pruning and
    compression, and lets later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (scratch := _scratch.get()) is not None:
        index = table._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
        scratch._read_by.append(spark._jvm.java.lang.ref.WeakReference(index))
    return table


def counted(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written out and counted; marked for broadcast only if it has at most ``rows`` rows."""
    table = materialise(df, label)
    return F.broadcast(table) if table.count() <= rows else table


def number_rows(papers: DataFrame, name: str = "_n") -> DataFrame:
    """1-based numbers in order of ``_pos``.

    Numbers come from counts per range of ``_pos`` plus the place in the range,
    so no task sees more than one range.
    """
    ranged = papers.repartitionByRange("_pos").sortWithinPartitions("_pos").withColumn("_part", F.spark_partition_id())
    placed = materialise(ranged, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row a range partition
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_pos"))
    return placed.withColumn(name, within).join(F.broadcast(bases), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def running_total(rows: DataFrame, amount: str, name: str) -> DataFrame:
    """The sum of ``amount`` over the rows up to each, itself included, in order of ``_pos``; by ranges, as in ``number_rows``."""
    placed = materialise(rows.repartitionByRange("_pos").withColumn("_part", F.spark_partition_id()), "totals")
    sizes = placed.groupBy("_part").agg(F.sum(amount).alias("_size"))
    # one row a range partition
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, within).join(F.broadcast(bases), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")
