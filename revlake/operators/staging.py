"""Tables that are computed once and kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of the warehouse in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: cheap to use again, and the same rows for all that read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: as ``cut``, but compressed, without the shuffle files it was
    made from, and for ``drop`` to delete; what is left is deleted when the process ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _KEPT[(spark.sparkContext.applicationId, "table", folder)] = folder
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``put`` that nothing reads any more."""
    for df in tables:
        if folder := getattr(df, "_folder", None):
            _delete(df.sparkSession, folder)
            _KEPT.pop((df.sparkSession.sparkContext.applicationId, "table", folder), None)


#: Rows of a few names and numbers each that may be broadcast: some MB.
FEW = 1 << 17


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """Narrow rows that were written already, marked for broadcasting if they are at most ``rows``; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_KEPT: dict[tuple[str, str, str], str] = {}


def checksum(df: DataFrame) -> str:
    """Tells tables with different rows apart, in whatever order they are read."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1]}"


def kept(spark: SparkSession, kind: str, mark: str, write: Callable[[str], object]) -> str:
    """The folder of an index that the first caller writes and later ones only read; ``mark`` is the checksum of what it is
    made from, so a changed table gets an index of its own.  Deleted when the process ends."""
    key = (spark.sparkContext.applicationId, kind, mark)
    if key not in _KEPT:
        folder = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        write(folder)
        _KEPT[key] = folder
    return _KEPT[key]


@atexit.register
def release() -> None:
    """Delete the kept folders of this process, as long as its session lives."""
    spark = SparkSession.getActiveSession() if _KEPT else None
    for folder in _KEPT.values() if spark else ():
        try:
            _delete(spark, folder)
        except Exception:  # the session is gone; the folder is then the cluster's to clean
            return
    _KEPT.clear()


def with_sum_before(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each, in an order without ties.

    The sum runs per range partition and is completed with the sums of the ranges before it.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_all")).select("_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))  # a row per partition
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = dealt.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return j.drop("_part", "_before")
