"""Helpers shared by the operators: shared-folder staging, Arrow mapping, ids and labelled samples."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a default only in local mode, else an error where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder is then the cluster's to clean
        pass


@atexit.register
def release() -> None:
    """Delete every staged table of this process."""
    while _STAGED:
        _drop(*_STAGED.pop())


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/revlake-{uuid.uuid4().hex}-{label}"
    _STAGED.append((spark, path))
    schema = df.schema
    # what the written table was made from is not run again, so its shuffle files can go with the execution
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in dfs:
        if path := getattr(df, "_staged", None):
            _drop(df.sparkSession, path)


#: Rows of a few numbers each that may be broadcast: some MB.
FEW = 1 << 19


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A staged table of narrow rows, marked for broadcasting if it has at most ``rows``; beyond, joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this process has freed to the system; the C library else keeps the pages of past training data."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that what a task holds of decoded text stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with ``f(batch) -> dict of columns``; empty batches pass without a call."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        for batch in arrow_rows(batches):
            if batch.num_rows:
                cols = f(batch)
                yield pa.RecordBatch.from_arrays([_column(cols[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, fields)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x if x is not None else b"" for x in col.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts hold about ``limit`` bytes together; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def residue(doc_id: str, modulus: int):
    """crc32 of the decimal id, mod ``modulus``: the fold a document belongs to."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, fold, limit: int) -> Iterator[tuple[int, bytes, object]]:
    """At most ``limit`` training rows ``(id, text, label)``, the same ones at every run, in order of nothing.

    ``labels`` is ``doc_id, label``.  The bound is the documented sample parameter of the classifiers; ordering by a hash of
    the id makes the sample uniform and independent of partitioning.  The ids are found by a top-k without the texts;
    as there are at most ``limit`` of them they are broadcast, so no text is shuffled.  The sample is staged and
    read a partition at a time: the driver never holds all its texts.
    """
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    usable = labels.where(F.col("label").isNotNull()).join(there, "doc_id", "left_semi").where(fold)
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = stage(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "label")), "doc_id"), "sample")
    parts = max(1, limit // 1000)
    for r in sample.repartition(parts).toLocalIterator():
        yield r["doc_id"], r["text"].encode(), r["label"]
    discard(sample)
