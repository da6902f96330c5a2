"""Training-text pipeline over ``documents``: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of their input, whatever they are called.

Null and empty texts are scored by the classifiers' biases, stay alone in the near-duplicate stage, have no passages and are
packed as the end id.  Repeated rows (same id and text) fare alike: they are kept or dropped together, except that passages of
a repeated row are passages that stand elsewhere.  An id is taken to name one text in the near-duplicate stage.  Very long
texts go through whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm import ftrl, near_dedup, packing, quality, suffix_dedup, toxicity
from revlake.llm.common import discard, few, fresh, residue, stage, table
from revlake.llm.queries import tokenizer_file

#: Repeated passages: bytes that repeated strings of so many bytes cover, cut where they hold so many whole words.  In prose
#: 51 words take more than 200 bytes; words of under 3 letters on average would escape.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def _judged(docs: DataFrame, model: ftrl.Model, keep) -> DataFrame:
    """Documents whose score satisfies ``keep``; scored in place, so nothing is joined or shuffled."""
    name = fresh(docs, "_score")
    return ftrl.score_column(docs, model, name=name).where(keep(F.col(name))).drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), residue("doc_id", 5) != 0)
    return _judged(docs, model, lambda s: s >= quality.THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the toxicity classifier marks."""
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), residue("doc_id", 3) != 1)
    return _judged(docs, model, lambda s: s < toxicity.THRESHOLD)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: five-word shingles, similarity 0.8 or more."""
    gone = stage(near_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"), "gone")
    return docs.join(few(gone), "doc_id", "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of more than 50 words that also stand elsewhere, all copies of them."""
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES, words=PASSAGE_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: Classifiers and packing have no SQL form; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table; a stage's rows are in the shared folder until the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        done = stage(apply(spark, docs, sf_dir), f"pipeline-{i}")
        discard(docs)
        docs = done
    return docs
