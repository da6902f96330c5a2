"""Export of a workspace's changes as a bundle: patch sections, change records and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(changes: DataFrame, patches: DataFrame) -> DataFrame:
    """``path, record, patch_sha256``: a JSON record of each change and the checksum of its patch section."""
    j = changes.join(patches, "path", "left")
    return j.select("path", F.to_json(F.struct(*[F.col(c) for c in changes.columns])).alias("record"), F.sha2(F.coalesce("patch", F.lit("")), 256).alias("patch_sha256"))


def write_bundle(folder: str, changes: DataFrame, patches: DataFrame) -> None:
    """Patch sections and records as files, and last the manifest of checksums: a bundle without it is not complete."""
    patches.orderBy("path").select("path", "patch").write.mode("overwrite").json(f"{folder}/patch")
    done = records(changes, patches)
    done.select("record").write.mode("overwrite").text(f"{folder}/changes")
    done.select("path", "patch_sha256").write.mode("overwrite").parquet(f"{folder}/manifest")


def show_pairs(edges: DataFrame, commits: DataFrame, parent: int | None = 1, every: bool = False) -> DataFrame:
    """``commit, parent``: what a commit is compared with: its first parent, its n-th, or each; null is the empty tree."""
    j = commits.select("commit").join(edges, "commit", "left")
    keep = F.lit(True) if every else F.col("pos").isNull() | (F.col("pos") == (parent or 1) - 1)
    return j.where(keep).select("commit", "parent")
