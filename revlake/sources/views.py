"""Relations of a repository derived from the benchmark tables, so that every operator runs on whole tables.

``files`` are the documents as blobs at paths; ``snapshots`` are four revisions of them; ``commits`` is the history that
conversations describe; ``refs``, ``overlay``, ``ref_events`` and ``lease_events`` follow from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions import content as K
from revlake.functions import paths as P

REGULAR, EXECUTABLE, SYMLINK, GITLINK, DIRECTORY = 0o100644, 0o100755, 0o120000, 0o160000, 0o40000
#: The namespace that no listing shows.
RESERVED = "refs/internal/"
#: The directory that the overlay deletes as a whole.
EMPTIED = "src5/de"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table with their sizes and times: what changes when the table is written again; no row is read."""
    m = F.col("_metadata")
    return table(spark, sf_dir, name).select(m.file_path.alias("file"), m.file_size.alias("size"), m.file_modification_time.alias("at")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, content, size, oid, mode``: one regular file per document."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt"))).alias("path"),
        text.alias("content"),
        F.octet_length(text).cast("long").alias("size"),
        K.blob_oid(text).alias("oid"),
        F.lit(REGULAR).alias("mode"),
    )


def snapshot(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Revision ``k`` (0 to 3) of the files: some dropped, some with a line more, some executable."""
    f = files(spark, sf_dir).where(F.col("doc_id") % 7 != k)
    text = F.when(F.col("doc_id") % 11 == k, F.concat("content", F.lit(f"\nrev {k}"))).otherwise(F.col("content"))
    f = f.withColumn("content", text)
    return f.select(
        F.lit(f"rev-{k}").alias("commit"),
        "doc_id",
        "path",
        "content",
        F.octet_length("content").cast("long").alias("size"),
        K.blob_oid("content").alias("oid"),
        F.when(F.col("doc_id") % 17 == k, EXECUTABLE).otherwise(REGULAR).alias("mode"),
    )


def manifest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return snapshot(spark, sf_dir, k).select("commit", "path", "mode", "oid", "size", F.col("doc_id").alias("blob_key"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit, conv_id, turn, parents, message, author_*, committer_*``: a commit for each conversation turn.

    A turn's parent is the turn before it; a first turn continues the last turn of the conversation before, and each
    fifth conversation merges the one before that too.
    """
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("message"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    one = last.select((F.col("conv_id") + 1).alias("conv_id"), F.concat_ws("-", F.lit("c"), "conv_id", "last").alias("p1"))
    two = last.select((F.col("conv_id") + 2).alias("conv_id"), F.concat_ws("-", F.lit("c"), "conv_id", "last").alias("p2"))
    j = c.join(one, "conv_id", "left").join(two, "conv_id", "left")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    j = j.join(first, "conv_id")
    merge = F.when(F.col("conv_id") % 5 == 0, F.col("p2"))
    parents = F.when(F.col("turn") > F.col("first"), F.array(F.concat_ws("-", F.lit("c"), "conv_id", F.col("turn") - 1))).otherwise(F.array_compact(F.array("p1", merge)))
    secs = F.lit(1_600_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60
    name = F.concat_ws("-", F.lit("c"), "conv_id", "turn")
    fields = [x for w in ("author", "committer") for x in (F.col("role").alias(f"{w}_name"), F.concat("role", F.lit("@example.org")).alias(f"{w}_email"), secs.alias(f"{w}_secs"), ((F.col("conv_id") % 25 - 12) * 60).cast("int").alias(f"{w}_tz"))]
    return j.select(name.alias("commit"), F.concat(F.lit("sha1:"), F.sha1(name)).alias("oid"), F.concat(F.lit("sha1:"), F.sha1(F.concat(F.lit("tree "), name))).alias("tree"), "conv_id", "turn", parents.alias("parents"), "message", *fields)


def edges(commits_: DataFrame) -> DataFrame:
    """``commit, parent, pos``: first parents have position 0."""
    return commits_.select("commit", F.posexplode("parents").alias("pos", "parent"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_name, target``: a branch per conversation, tags and reserved anchors for some."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    target = F.concat_ws("-", F.lit("c"), "conv_id", "last")
    kinds = F.array_compact(
        F.array(
            F.concat(F.lit("refs/heads/conv-"), F.col("conv_id")),
            F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit("refs/tags/v-"), F.col("conv_id"))),
            F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit(RESERVED + "mounts/m-"), F.col("conv_id"))),
        )
    )
    return last.select(F.explode(kinds).alias("ref_name"), target.alias("target"), "conv_id")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag, target``: tag objects of some conversations' last commits, some of them tagged again, and some of trees."""
    k = F.col("conv_id")
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    own = F.concat(F.lit("t-"), k)
    target = F.when(k % 3 == 0, F.concat(F.lit("tree-"), k)).otherwise(F.concat_ws("-", F.lit("c"), k, "last"))
    made = F.array_compact(F.array(F.struct(own.alias("tag"), target.alias("target")), F.when(k % 4 == 0, F.struct(F.concat(F.lit("t-t-"), k).alias("tag"), own.alias("target")))))
    return last.where(k % 2 == 0).select(F.explode(made).alias("t")).select("t.*")


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, present, kind, opaque, oid, mode, size, renamed_from, base_oid, base_mode`` over revision 3.

    ``EMPTIED`` is a deleted directory without rows below it; of the other deleted one some files were written again.
    """
    base = snapshot(spark, sf_dir, 3).where(~F.startswith("path", F.lit(EMPTIED + "/")))
    k = F.col("doc_id") % 13
    edited = F.concat("content", F.lit("\nlocal"))
    rows = base.where(k.isin(1, 2, 3, 4)).select(
        F.when(k == 3, F.concat(F.lit("moved/doc-"), F.col("doc_id"), F.lit(".txt"))).otherwise(F.col("path")).alias("path"),
        (k != 1).alias("present"),
        F.lit("file").alias("kind"),
        F.lit(False).alias("opaque"),
        F.when(k == 2, K.blob_oid(edited)).when(k != 1, F.col("oid")).alias("oid"),
        F.when(k == 4, F.lit(EXECUTABLE + REGULAR) - F.col("mode")).when(k != 1, F.col("mode")).cast("int").alias("mode"),
        F.when(k == 2, F.octet_length(edited)).when(k != 1, F.col("size")).cast("long").alias("size"),
        F.when(k == 3, F.col("path")).alias("renamed_from"),
        F.when(k != 3, F.col("oid")).alias("base_oid"),
        F.when(k != 3, F.col("mode")).alias("base_mode"),
    )
    sources = base.where(k == 3).select("path")
    gone = sources.select("path", F.lit(False).alias("present"), F.lit("file").alias("kind"), F.lit(False).alias("opaque"), *_none("oid string", "mode int", "size long", "renamed_from string", "base_oid string", "base_mode int"))
    new = table(spark, sf_dir, "documents").where("doc_id % 29 = 0").select(F.concat(F.lit("new/doc-"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    new = new.select("path", F.lit(True).alias("present"), F.lit("file").alias("kind"), F.lit(False).alias("opaque"), K.blob_oid("content").alias("oid"), F.lit(REGULAR).alias("mode"), F.octet_length("content").cast("long").alias("size"), *_none("renamed_from string", "base_oid string", "base_mode int"))
    dirs = spark.createDataFrame([("src7/en", True, "directory", True), ("src3/fr", False, "directory", False), (EMPTIED, False, "directory", False)], "path string, present boolean, kind string, opaque boolean")
    dirs = dirs.select("*", *_none("oid string", "mode int", "size long", "renamed_from string", "base_oid string", "base_mode int"))
    return rows.unionByName(gone).unionByName(new).unionByName(dirs)


def overlay_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of the files that are present in ``overlay``."""
    base, k = snapshot(spark, sf_dir, 3).where(~F.startswith("path", F.lit(EMPTIED + "/"))), F.col("doc_id") % 13
    held = base.where(k.isin(2, 3, 4)).select(
        F.when(k == 3, F.concat(F.lit("moved/doc-"), F.col("doc_id"), F.lit(".txt"))).otherwise(F.col("path")).alias("path"),
        F.when(k == 2, F.concat("content", F.lit("\nlocal"))).otherwise(F.col("content")).alias("content"),
    )
    new = table(spark, sf_dir, "documents").where("doc_id % 29 = 0")
    return held.union(new.select(F.concat(F.lit("new/doc-"), F.col("doc_id"), F.lit(".txt")), F.coalesce("text", F.lit(""))))


def _none(*fields: str):
    return [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in fields)]


def ref_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, ref_name, new_oid``: what was seen of each ref, in order; no oid where it was gone."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("refs/heads/u-"), F.col("user_id")).alias("ref_name"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("new_oid"))


def directories(paths: DataFrame) -> DataFrame:
    """Every proper ancestor of the paths, once."""
    return paths.select(F.explode(P.ancestors_of("path")).alias("path")).distinct()
