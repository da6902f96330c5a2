"""The trigram index and blob registry: building, merging, candidate lookup.

A posting list is a bitmap for each chunk of ``CHUNK`` consecutive blob keys, so lists are united, intersected and counted
by Spark's bitmap aggregates, a row for each trigram and chunk.  Keys are dense (``intern``), so chunks fill up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlake.functions import content as K
from revlake.functions import patterns as R
from revlake.operators.staging import cut


#: Blob keys of a chunk; fixed by the bitmap functions.
CHUNK = 32_768


def _place(key: str = "blob_key") -> tuple[Column, Column]:
    """The chunk of a key and its bit there; keys count from 0, the bitmap functions from 1."""
    return F.bitmap_bucket_number(F.col(key) + 1), F.bitmap_bit_position(F.col(key) + 1)


def intern(known: DataFrame, facts: DataFrame) -> DataFrame:
    """``oid, blob_key`` of known and new oids: keys stay, new ones follow densely in order of first position.

    ``facts`` is ``oid, pos``.  The numbering of new oids is by rank inside hash buckets plus the buckets' offsets, so
    no single task orders all of them.
    """
    new = facts.groupBy("oid").agg(F.min("pos").alias("pos")).join(known.select("oid"), "oid", "left_anti")
    start = known.agg(F.coalesce(F.max("blob_key"), F.lit(-1)).alias("top"))
    # numbered once: the ranges and their numbers must be the same wherever the table is read
    parts = cut(new.repartitionByRange("pos", "oid").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("pos", "oid")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    numbered = parts.withColumn("k", F.row_number().over(own)).join(F.broadcast(before.select("part", "before")), "part").crossJoin(F.broadcast(start))
    return known.select("oid", "blob_key").unionByName(numbered.select("oid", (F.col("top") + F.col("before") + F.col("k")).alias("blob_key")))


def registry(blobs: DataFrame, limit: int = K.MAX_SEARCHABLE) -> DataFrame:
    """Blobs with ``content_class`` and ``indexed``: text is indexed, everything else is only classified."""
    kind = K.classify("content", limit)
    return blobs.withColumn("content_class", kind).withColumn("indexed", F.coalesce(F.col("content_class").isin("TEXT", "INVALID_UTF8"), F.lit(False)))


def totals(blobs: DataFrame) -> DataFrame:
    """One row: ``blobs, key_bytes, next_key`` of a registry."""
    return blobs.agg(F.count("*").alias("blobs"), F.sum(F.octet_length("oid")).alias("key_bytes"), (F.coalesce(F.max("blob_key"), F.lit(-1)) + 1).alias("next_key"))


def postings(blobs: DataFrame) -> DataFrame:
    """``trigram, chunk, bits`` of the indexed blobs.

    The (trigram, blob) pairs are dealt by trigram and chunk before they are aggregated, so what is shuffled is narrow and a
    group has at most ``CHUNK`` rows, however common a trigram is.
    """
    chunk, bit = _place()
    rows = R.trigram_rows(blobs.where("indexed")).select("trigram", chunk.alias("chunk"), bit.alias("bit"))
    return rows.repartition("trigram", "chunk").groupBy("trigram", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def posting_rows(postings_: DataFrame) -> DataFrame:
    """``trigram, blob_key`` of bitmaps, for reports that need single keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for trigram, chunk, bits in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (chunk - 1) * CHUNK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), trigram, np.int32)), pa.array(keys.astype(np.int64))], names=["trigram", "blob_key"])

    return postings_.select("trigram", "chunk", "bits").mapInArrow(run, "trigram int, blob_key long")


def first_key() -> Column:
    """The least blob key of ``chunk, bits``."""
    zeros = F.length(F.regexp_extract(F.hex("bits"), "^(?:00)*", 0)) / 2
    byte = F.conv(F.hex(F.substring("bits", (zeros + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    low = F.log2(byte.bitwiseAND(-byte).cast("double"))
    return ((F.col("chunk") - 1) * CHUNK + zeros * 8 + low).cast("long")


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two batches of postings."""
    both = old.select("trigram", "chunk", "bits").union(new.select("trigram", "chunk", "bits"))
    return both.groupBy("trigram", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def holds(members: DataFrame, found: DataFrame) -> DataFrame:
    """``blob_key`` of the members whose bit is set in ``chunk, bits`` (a row for each chunk)."""
    chunk, bit = _place()
    placed = members.select("blob_key", chunk.alias("chunk"), bit.cast("int").alias("bit")).distinct()
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return placed.join(found.select("chunk", "bits"), "chunk").where(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0).select("blob_key")


def ingest_report(known: DataFrame, batch: DataFrame) -> DataFrame:
    """``content_class, blobs, bytes`` of the blobs of a batch that were not known, and how many were."""
    b = batch.join(known.select("oid", F.lit(True).alias("known")), "oid", "left")
    return b.groupBy(F.when(F.col("known"), "already_known").otherwise(F.col("content_class")).alias("content_class")).agg(
        F.count("*").alias("blobs"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("size"))).cast("long").alias("bytes")
    )


def candidates(postings_: DataFrame, literals: list[str] | None, members: DataFrame, fold: bool = False) -> DataFrame:
    """``blob_key`` of members that may match: for any literal, all its trigrams in any case.

    The trigrams asked for are few (bounded by the pattern's length), so they are a filter on the postings scan.  The cases
    of a trigram are united, the trigrams of a literal intersected and the literals united chunk by chunk.
    Without literals every member is a candidate.
    """
    if literals is None:
        return members.select("blob_key").distinct()
    wanted = [(t, v, i, len(R.trigrams(text))) for i, text in enumerate(literals) for t in R.trigrams(text) for v in (R.case_variants(t) if fold else [t])]
    if not wanted:
        return members.select("blob_key").limit(0)
    spark = postings_.sparkSession
    asked = spark.createDataFrame(wanted, "need int, trigram int, alternative int, n int")
    hits = postings_.where(F.col("trigram").isin(sorted({w[1] for w in wanted}))).join(F.broadcast(asked), "trigram")
    needs = hits.groupBy("alternative", "n", "need", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
    full = needs.groupBy("alternative", "n", "chunk").agg(F.count("*").alias("found"), F.bitmap_and_agg("bits").alias("bits")).where("found = n")
    return holds(members, full.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits")))


def write_index(folder: str, postings_: DataFrame, blobs: DataFrame, manifest: DataFrame, commit: str) -> DataFrame:
    """Write a build of an index so that a reader never sees a blob as indexed before its postings are there: postings
    first, then blobs, then the snapshot's manifest, and last the row that makes it READY.  A build has folders of its
    own, so one that is written again replaces itself.  Returns the snapshot table."""
    spark = postings_.sparkSession

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/build={commit}")

    put(cut(postings_).repartitionByRange("trigram", "chunk").sortWithinPartitions("trigram", "chunk"), "postings")
    put(blobs.drop("content"), "blobs")
    put(manifest.repartitionByRange("path").sortWithinPartitions("path"), "manifest")
    facts = manifest.agg(F.count("*").alias("path_count"), F.sum(F.xxhash64("path", "blob_key").cast("decimal(38,0)")).cast("string").alias("checksum"))
    put(facts.select(F.lit(commit).alias("commit"), F.lit("READY").alias("state"), F.lit(1).alias("format_version"), "path_count", "checksum"), "snapshots")
    return spark.read.parquet(f"{folder}/snapshots").drop("build")


def read_index(spark: SparkSession, folder: str, commit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(manifest, blobs, postings)`` of a READY snapshot; blobs and postings are those of all READY builds.

    Postings are sorted by trigram within their files, so the trigrams of a query prune the scan.
    """
    ready = [r["commit"] for r in spark.read.parquet(f"{folder}/snapshots").where("state = 'READY'").select("commit").collect()]  # a row per build
    if commit not in ready:
        raise ValueError(f"snapshot {commit} is not READY")
    built = F.col("build").cast("string").isin(ready)
    blobs = spark.read.parquet(f"{folder}/blobs").where(built).drop("build").dropDuplicates(["blob_key"]) if len(ready) > 1 else spark.read.parquet(f"{folder}/blobs/build={commit}")
    return spark.read.parquet(f"{folder}/manifest/build={commit}"), blobs, spark.read.parquet(f"{folder}/postings").where(built).drop("build")


def incremental(manifest: DataFrame, known: DataFrame, changes: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manifest, new blobs)`` of a snapshot from its parent's: only blobs that no snapshot had before are classified.

    ``manifest`` is ``path, oid, mode``, ``changes`` a delta, ``known`` the registry's ``oid``, ``contents`` is ``oid, content, size``.
    """
    from revlake.operators.tree import apply_delta

    new = changes.where("action = 'upserted'").select("oid").distinct().join(known.select("oid"), "oid", "left_anti")
    return apply_delta(manifest, changes), registry(contents.dropDuplicates(["oid"]).join(new, "oid", "left_semi"))


def generation(batches: DataFrame) -> DataFrame:
    """``batch, generation``: the counter moves only with batches that added postings (``batch, added``)."""
    from pyspark.sql import Window

    moved = F.sum((F.col("added") > 0).cast("long")).over(Window.orderBy("batch"))  # a row per batch
    return batches.select("batch", moved.alias("generation"))
