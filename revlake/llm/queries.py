"""The thin queries over ``documents`` and ``embeddings``: one per operator, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlake.llm import byte_bpe, ftrl, importance, language_id, media_gif, near_dedup, oracles, packing, quality, spelling, suffix_dedup, token_counts, toxicity, tree_bpe, vp_search
from revlake.llm.common import residue, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_media_gif(spark, sf_dir):
    return media_gif.described(media_gif.stored(table(spark, sf_dir, "documents")))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = language_id.predicted(docs, language_id.fit(docs, residue("doc_id", 3) != 1))
    return out.select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op6_vp_search(spark, sf_dir):
    out = vp_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _judged(spark, sf_dir, fit, held_out: int, modulus: int, threshold: float):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), residue("doc_id", modulus) != held_out)
    out = ftrl.scored(docs, model)
    return out.select("doc_id", (residue("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir):
    return _judged(spark, sf_dir, toxicity.toxicity_model, 1, 3, toxicity.THRESHOLD)


def op8_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_quality(spark, sf_dir):
    return _judged(spark, sf_dir, quality.quality_model, 0, 5, quality.THRESHOLD)


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed_report(table(spark, sf_dir, "documents"))


def op11_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), least=6, often=5, ratio=5, drop=199)


def op12_importance(spark, sf_dir):
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op13_tree_bpe(spark, sf_dir):
    import public_tokenizers

    return tree_bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_near_dedup, op3_media_gif, op4_language_id, op5_byte_bpe, op6_vp_search, op7_toxicity, op8_packing, op9_quality, op10_suffix_dedup, op11_spelling, op12_importance, op13_tree_bpe)}

#: What SQL can express; every other operator learns, hashes, codes or iterates, and is tested against brute force, exact
#: round trips or held-out rows in tests/llm.
ORACLE_SQL = {
    "op11_spelling": oracles.SPELLING,
    "op12_importance": oracles.IMPORTANCE,
    "op6_vp_search": """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
""",
}
