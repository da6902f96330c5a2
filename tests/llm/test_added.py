"""Operators 11 to 13 against SQL, brute force and the public tokenizer library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from revlake.llm import hashing, importance, language_id, packing, queries, spelling, suffix_dedup, tree_bpe, vp_search
from tests.llm.test_llm import SCHEMA, SMALL, empty, odd, removed  # noqa: F401  (fixtures)


def same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert got.columns == rel.columns
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(rel.fetchall(), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    return want


# importance resampling


def test_op12_equals_sql(spark):
    rows = same_as_sql(spark, "op12_importance")
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, sum(r[4] is not None for r in rows) + 1))


def grams(text, n, buckets):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(hashing.LOWER))
    return len(w), sorted(zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("piece", [1 << 22, 8, 60])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_of_pieces(monkeypatch, piece, n):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(n)
    texts = [b"", b"Hello hello  world", b"a " * 5, bytes(rng.randrange(256) for _ in range(3000)), b"x" * 500 + b" y", "Ünï cödé 12".encode(), b"...", b" lone"]
    stream, at, words = importance.features(texts, n, 1000)
    for i, t in enumerate(texts):
        assert (words[i], sorted(stream[at[i] : at[i + 1]].tolist())) == grams(t, n, 1000)


def test_crc32_of_spans():
    rng = random.Random(3)
    buf = np.frombuffer(bytes(rng.randrange(256) for _ in range(2000)), np.uint8)
    start = np.array([rng.randrange(1000) for _ in range(300)])
    end = start + np.array([rng.choice((0, 1, 5, 63, 64, 65, 66, 700)) for _ in range(300)])
    before = np.array([rng.randrange(1 << 32) for _ in range(300)], np.uint32)
    want = [zlib.crc32(buf[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before)]
    assert hashing.crc32_spans(buf, start, end, before).tolist() == want
    assert hashing.crc32_spans(buf, start, end).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(start, end)]


def test_resampling_edge_cases(spark, odd, empty):  # noqa: F811
    out = importance.resampled(odd, odd.limit(3), n=2, percent=50, least_words=2).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert by[0]["n_features"] == by[1]["n_features"] == by[2]["n_features"] == 0 and by[0]["weight"] == 0 and by[0]["rank"] is None
    assert by[3]["weight"] == by[4]["weight"] == by[5]["weight"] and by[3]["n_features"] == 3
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    fit = [r for r in out if len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (dict(odd.select("doc_id", "text").collect())[r["doc_id"]] or "").lower())) >= 2]
    want = sorted(fit, key=lambda r: (-r["score"], r["doc_id"]))[: len(fit) // 2]
    assert [r["doc_id"] for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == [r["doc_id"] for r in want]
    assert importance.resampled(empty, odd).collect() == []
    assert len(importance.resampled(odd, empty).collect()) == len(out)
    nameless = importance.resampled(odd.withColumn("doc_id", F.lit(None).cast("long")), odd, percent=100).collect()
    assert len(nameless) == len(out) and all(r["score"] is None and r["rank"] is None for r in nameless)


# BPE by tree concatenation


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tree_bpe.TreeBpe(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)


def unsplit(rng):
    yield from ("", "Hello world's  test\n\n  x", "<|endoftext|> a <|endoftext|><|endoftext|>b", "日本語🙂" * 50, "\x1c\x85\xa0 a\u0558b\u088f 1\U000323b0!", "é" * 777 + "\u0301" * 300)
    for unit in ("x", "ab", "aab", "the", "-", "=-", " ", "0123456789", "é", "abcab"):
        yield (unit * 3000)[: rng.randrange(900, 3000)]
    for letters in ("the", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
        yield "".join(rng.choice(letters) for _ in range(4000))
    for _ in range(60):
        yield "".join(rng.choice([*"abcdet h  \n'.,1290-é日\U0001f642", "ing", "tion", " the", "'s"]) for _ in range(rng.randrange(400)))
        yield "".join(rng.choice("etaoin") for _ in range(rng.randrange(200, 900)))


@pytest.mark.parametrize(("leaf", "window"), [(256, 4), (8, 1), (3, 1), (1, 2)])
def test_tree_concatenation_equals_the_library(bpe, monkeypatch, leaf, window):
    model, library = bpe
    monkeypatch.setattr(tree_bpe, "LEAF", leaf)
    monkeypatch.setattr(tree_bpe, "WINDOW", window)
    monkeypatch.setattr(model, "known", {})
    texts = list(unsplit(random.Random(leaf)))
    for text, parts in zip(texts, model.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert [i for p in parts for i in p[1]] == ids
        assert model.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_joins_agree_on_both_sides(bpe, monkeypatch):
    """Whatever the halves, joining their encodings is encoding the whole."""
    model, _ = bpe
    monkeypatch.setattr(tree_bpe, "WINDOW", 1)
    rng = random.Random(11)
    halves = [tuple("".join(rng.choice(rng.choice(("ab", "the", "x", "éa"))) for _ in range(rng.randrange(1, 40))).encode() for _ in range(2)) for _ in range(400)]
    pairs = [tuple(model.side_by_side(list(h))) for h in halves]
    whole = model.side_by_side([a + b for a, b in halves])
    assert all(np.array_equal(x, y) for x, y in zip(model._joined(pairs), whole, strict=True))


def test_remembered_matches_when_full(bpe, monkeypatch):
    model, library = bpe
    monkeypatch.setattr(tree_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(model, "known", {})
    for text in ("one two three four five", "one six <|endoftext|>"):
        assert [i for p in model.encode([text])[0] for i in p[1]] == library.encode(text, add_special_tokens=False).ids
    assert len(model.known) <= 3


def test_op13_equals_the_library(spark, bpe, odd, empty):  # noqa: F811
    library = bpe[1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(99, "a<|endoftext|>b", "en", "s", 1, 1, "n", "s", "c", "d", "l")], SCHEMA)
    for docs, got in ((odd.union(extra), tree_bpe.encoded(odd.union(extra), path, public_tokenizers.PATTERN)), (spark.read.parquet(f"{SMALL}/documents.parquet"), queries.op13_tree_bpe(spark, SMALL))):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            want.append((r["doc_id"], len(ids), *digest))
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert tree_bpe.encoded(empty, path, public_tokenizers.PATTERN).collect() == []


def test_ids_decode_to_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, [15496, 995]), (2, None), (3, []), (4, [50256])], "doc_id long, ids array<int>")
    got = dict(tree_bpe.decoded(rows, path, public_tokenizers.PATTERN).collect())
    assert got == {1: "Hello world", 2: None, 3: "", 4: "<|endoftext|>"}


# spelling variants


def apart(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def formed(count, ratio):
    """``word: (form, root, n, n_near, form_n)`` by comparing every two words."""
    out = {}
    for w, n in count.items():
        near = [x for x in count if apart(w, x)]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        out[w] = (best, count[best], len(near)) if best and count[best] >= ratio * n else (None, None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), count[w], k, n) for w, (f, n, k) in out.items()}


def test_op11_equals_sql(spark):
    rows = same_as_sql(spark, "op11_spelling")
    assert any(r[1] for r in rows)


@pytest.mark.parametrize("most", [1 << 17, 8, 1])
def test_variants_against_all_pairs(spark, monkeypatch, most):
    """Shards of any size give the same pairs, equal letters side by side and long words included."""
    monkeypatch.setattr(spelling, "PACK", 16)
    rng = random.Random(most)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef" * 60]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ×") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]))

    words = [w for w in base for _ in range(rng.choice((1, 2, 40)))] + [changed(w) for w in base for _ in range(6)]
    rng.shuffle(words)
    docs = spark.createDataFrame([(i, " ".join(words[i::7]).title()) for i in range(7)], "doc_id long, text string")
    lowered = Counter(w for (t,) in docs.select("text").collect() for w in (x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall("[A-Za-zÀ-ÿ]+", t)) if len(w) >= 6)
    count = {w: n for w, n in lowered.items() if n >= 1}
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(docs, often=1, ratio=2, most=most).collect()}
    assert got == formed(count, 2) and sum(v[3] for v in got.values()) > 100


def test_shards_stay_bounded(spark):
    """Words that agree on their first half are dealt by what else they share."""
    words = spark.range(3000).selectExpr("concat('constant', translate(lpad(cast(id as string), 6, '0'), '0123456789', 'abcdefghij')) as word", "1L as n")
    sizes = [r["count"] for r in spelling._dealt(words, 6, 200).groupBy("shard").count().collect()]
    assert max(sizes) <= 200


def test_wavelet_tree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 64, 100):
        x = rng.permutation(n)
        tree = spelling.WaveletTree(x)
        a, b, lo, hi = (rng.integers(0, n + 1, 200) for _ in range(4))
        which, value = tree.report(a, b, lo, hi)
        got = sorted(zip(which.tolist(), value.tolist()))
        assert got == sorted((i, int(v)) for i in range(200) for v in x[a[i] : b[i]] if lo[i] <= v < hi[i])


@pytest.mark.parametrize("piece", [1 << 22, 16])
def test_words_of_texts(spark, odd, empty, monkeypatch, piece):  # noqa: F811
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "COUNTED", 5)
    for drop in (0, 3):
        want = Counter()
        for i, t in odd.select("doc_id", "text").collect():
            for w in re.findall("[A-Za-z\u00c0-\u00ff]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
                h = zlib.crc32(f"{i}:{w}".encode())
                w = w[: h % len(w)] + w[h % len(w) + 1 :] if drop and h % drop == 0 else w
                want[w] += len(w) >= 4
        assert dict(spelling.word_counts(odd, 4, drop).collect()) == {w: n for w, n in want.items() if n}
    assert spelling.variants(empty).collect() == []
    assert spelling.word_counts(odd.withColumn("doc_id", F.lit(None).cast("long")), 4, 3).count()


# contracts of earlier operators


def nearest_by_rule(rows, query, k):
    def product(a, b):
        s = 0.0
        for p, q in zip(a, b, strict=True):
            s += p * q
        return s

    own = dict(rows)[query]
    return [(i, -s) for s, i in sorted((-product(v, own), i) for i, v in rows if i != query)[:k]]


def searched(spark, rows, k=20, **more):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in vp_search.nearest(d, F.col("id") % 20 == 0, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [60, 16384])
def test_ties_of_different_vectors(spark, shard, monkeypatch):
    """One-hot and sign vectors: very many candidates are equally near, and the smallest ids are wanted."""
    monkeypatch.setattr(vp_search, "RANKED", 500)
    rng = np.random.default_rng(4)
    hot = [(1000 + i, [float(i == j) for j in range(64)]) for i in range(64)]
    ids = rng.permutation(400)
    signs = [(int(i), rng.choice([-1.0, 1.0], 16).tolist()) for i in ids]
    for rows in (hot, signs, hot[::-1]):
        got = searched(spark, rows, factor=1.0, shard_rows=shard)
        assert got == {i: nearest_by_rule(rows, i, 20) for i, _ in rows if i % 20 == 0}
    assert searched(spark, signs) == {i: nearest_by_rule(signs, i, 20) for i, _ in signs if i % 20 == 0}


def test_rows_with_one_id(spark):
    rows = [(0, [1.0, 0.0])] * 50 + [(1, [1.0, 0.0])] * 50 + [(2, [3.0, 0.0]), (2, [0.5, 0.0]), (3, [0.9, 0.0])]
    assert searched(spark, rows, factor=1.0) == {0: [(1, 1.0), (3, 0.9), (2, 0.5)]}


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(["½ ² ⅷ", "1 2 ½a", "", None, "①②", "日", "le un la"] * 3)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs, model).collect()}
    assert [got[i] for i in range(7)] == ["und", "fr", "und", "und", "und", "fr", "fr"]


def test_equal_texts_score_equally_in_any_company(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"].encode() for r in docs.where("text is not null").limit(128).collect()]
    model = language_id.fit(docs, F.lit(True))
    names, together = model.predict(texts)
    for i, t in enumerate(texts):
        name, alone = model.predict([t])
        assert name[0] == names[i] and alone[0] == together[i]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "<|ENDOFTEXT|> <|EndOfText|>", "one<|endoftext|>two's", "<|endoftext|", "é<|startoftext|>\u0301 e\u0301", "<|endoftext|>"])
def test_special_tokens_in_a_text(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.token_ids([b"first one", text.encode(), b""], path)[1] == want


@pytest.mark.parametrize("common", [1, 2, 64])
def test_contexts_that_many_rows_hold(spark, monkeypatch, common):
    """Broadcast or shuffled, what repeats is the same."""
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(120))
    texts = [" ".join(word() for _ in range(rng.randrange(30))) + passage[rng.choice((0, 0, 40)) :] + " ".join(word() for _ in range(rng.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, suffix_dedup.removed_report(docs).drop("n_kept").collect()))
    want = removed([(i, t.encode()) for i, t in enumerate(texts)], 400)
    assert got == want and sum(n for _, _, n, _, _ in want) > 10_000


@pytest.mark.parametrize("words", [3, 60, 150])
def test_op10_goes_by_bytes_not_words(spark, tmp_path, words):
    """A passage in two documents stays at 399 bytes, however many words it has, and goes whole from 400 on."""
    rng = random.Random(words)
    texts, want = [], {}
    for size in (399, 400, 401):
        cuts = sorted(rng.sample(range(1, size // 2), words - 1))  # every word takes one byte or more
        sizes = [b - a for a, b in zip([0, *cuts], [*cuts, size - words + 1], strict=True)]
        passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(n)) for n in sizes)
        assert len(passage) == size and len(passage.split()) == words
        for before, behind in (("one. ", " Two"), ("Three! ", " four")):  # no byte beside the passage is the same
            want[len(texts)] = (size if size >= 400 else 0, int(size >= 400))
            texts.append(before[:-1] + str(len(texts)) + passage + str(len(texts) + 1) + behind)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == want
