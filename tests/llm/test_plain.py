"""Scores and predictions, row by row, against plain Python."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from sluice.llm import language, quality, queries
from sluice.llm.shared import crc_fold, ranked
from tests.llm.common import DIR, awkward, frame

M = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M
    return x ^ x >> 31


def word_hash(w):
    seed = 0x2545F4914F6CDD1D
    out = mixed(mixed(len(w) + seed & M) ^ int.from_bytes(w[:8], "little"))
    for k in range(8, len(w), 8):
        if k == 256:
            return mixed(out ^ xxhash.xxh3_64_intdigest(w[k:], seed))
        out = mixed(out ^ int.from_bytes(w[k : k + 8], "little"))
    return out


def plain_features(text):
    data = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not w:
        return [0.0] * (len(quality.SHAPES) + quality.HASHED)
    size, n = len(data), len(w)

    def of(chars):
        return sum(c in chars for c in data)

    lower, upper, digits = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    is_mark = [0x21 <= c <= 0x7E and c not in lower + upper + digits for c in range(256)]
    letters = [sum(c in lower or c in upper or c >= 0xC0 for c in x) for x in w]
    uppers, marks = [sum(c in upper for c in x) for x in w], [sum(is_mark[c] for c in x) for x in w]
    same = [i > 0 and w[i] == w[i - 1] for i in range(n)]
    shout = [u == k and k > 1 for u, k in zip(uppers, letters)]
    usual = [k > 0 and not s and m <= 1 and not e for k, s, m, e in zip(letters, shout, marks, same)]
    near = [usual[max(min(i + 32, n) - 32, 0) : min(i + 32, n)] for i in range(n)]
    out = [
        sum(letters) / size, of(upper) / size, of(digits) / size, sum(is_mark[c] for c in data) / size, of(b"#$%&*@^~=+<>{}[]\\/_|`") / size,
        sum(a == b and is_mark[a] for a, b in zip(data, data[1:])) / size, of(b"|") / n, of(b"\n") / n, of(b".!?") / n, of(b",") / n,
        sum(map(len, w)) / n / 10, sum(len(x) > 12 for x in w) / n, sum(len(x) < 4 for x in w) / n, sum(shout) / n, sum(m > 1 for m in marks) / n,
        sum(same) / n, (n - len(set(w))) / n, math.log1p(n) / 10, sum(k == 0 and m > 0 for k, m in zip(letters, marks)) / n, sum(x[0] in lower for x in w) / n,
        1 - min(sum(x) / len(x) for x in near), sum(usual) / n,
    ]
    shares = [0.0] * quality.HASHED
    for x in w:
        shares[word_hash(x) % quality.HASHED] += 1 / n
    return out + shares


def test_quality_row_by_row(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: np.array(plain_features(t)) for i, t in texts.items()}
    for r in quality.with_features(docs).collect():
        assert np.allclose(r["features"], x[r["doc_id"]], atol=1e-9)
    labels = {}
    for r in spark.read.parquet(f"{DIR}/labels.parquet").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["quality"] is not None:
            labels[r["doc_id"]] = max(r["quality"], labels.get(r["doc_id"], 0))
    known = sorted(i for i in labels if i in texts)
    z = np.array([x[i] for i in known])
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-9
    good, bad = ([(x[i] - mean) / spread for i in known if labels[i] == k] for k in (1, 0))
    train = spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int")
    model = quality.fitted(docs, train)
    # The loss is convex: the weights are right where its slope is none.
    w, n = model["weights"], max(len(good), len(bad))
    slope, pairs = -np.array([0.001] * len(quality.SHAPES) + [0.03] * quality.HASHED) * w, n * quality.PAIRS
    for r in range(pairs):
        d = good[r % len(good)] - bad[(r * 7919 + r // n) % len(bad)]
        slope = slope + d / pairs / (1 + math.exp(min(max(float(d @ w), -30), 30)))
    assert np.abs(slope).max() < 1e-6
    strength = {i: float((v - mean) / spread @ w) for i, v in x.items()}
    order = sorted(strength[i] for i in known)
    k = len(bad)
    cut = (order[k - 1] + order[k]) / 2
    rows = queries.QUERIES["op3_quality_ranking"](spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score = 1 / (1 + math.exp(min(max(cut - strength[r["doc_id"]], -30), 30)))
        assert abs(r["score"] - score) < 1e-6 and (r["predicted"] == int(score >= 0.5) or abs(score - 0.5) < 1e-6)


def test_quality_columns_with_clashing_names(spark):
    docs = frame(spark).withColumn("score", F.lit("x")).withColumn("features", F.lit(1)).withColumn("strength", F.lit(2))
    model = quality.learn(docs, spark.createDataFrame([(1, 1), (8, 0), (6, 1), (13, 0)], "doc_id long, quality int"))
    got = quality.score(docs, model, ("score", "strength", "n_words"))
    assert got.columns == ["doc_id", "given_score", "given_strength", "n_words", "score", "predicted"]
    assert {r["given_score"] for r in got.collect()} == {"x"} and got.count() == len(awkward())
    assert quality.with_features(docs, ("features",)).columns == ["doc_id", "given_features", "features"]
    long = spark.createDataFrame([(1, "Good words, really. " * 200_000)], "doc_id long, text string")
    assert abs(quality.with_features(long).first()["features"][8] - 1 / 3) < 1e-9


def test_ranked(spark):
    rows = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 1, 1, 2, -7.5, 1e9, 1e-9, 3]], "x double").repartition(3)
    order = sorted(r["x"] for r in rows.collect())
    for k, v in enumerate(order):
        assert ranked(rows, "x", k) == v and ranked(rows, "x", k, held=1) == v


def plain_language(text, model):
    if not text or not model or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = " ".join(re.sub(r"[\x00-\x60\x7b-\x7f]", " ", text.lower()).split(" ")).encode()
    data = b" ".join(data.split())
    n = max(1, -(-len(data) // 65536))
    sizes = {}
    for lang, content in model.items():
        how = zstandard.ZstdCompressionParameters(window_log=19, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, search_log=4, chain_log=19, hash_log=17)
        of = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        of.precompute_compress(compression_params=how)
        sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=of, compression_params=how).compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n))
    first, second = sorted(sizes.values())[:2] if len(sizes) > 1 else (0, 1)
    return next(x for x in model if sizes[x] == first), min(1.0, 0.5 + 2 * (second - first) / second)


def test_language_row_by_row(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.learn(docs.where(F.coalesce(crc_fold(F.col("doc_id"), 4), F.lit(0)) != 2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.QUERIES["op8_language_id"](spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = plain_language(texts[r["doc_id"]], model)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12


@pytest.mark.parametrize("held", [1, 2, 64])
def test_any_number_of_languages(spark, held):
    """Compressors that take turns give what all of them at once give."""
    model = {lang: b" ".join(w.lower().encode() for t in [a, b] for w in t.split()) for lang, a, b in (("one", "alpha beta gamma", "delta epsilon"), ("two", "uno dos tres", "cuatro cinco"), ("six", "ein zwei drei", "vier"))}
    texts = ["alpha gamma delta", "tres cuatro uno dos", None, "", "12", "zwei vier drei ein zwei", "zzz"]
    got = language.Judge(model, held=held).many(texts)
    assert got == [language.Judge(model).one(t) for t in texts]
    assert [x[0] for x in got[:2]] == ["one", "two"]
    many = spark.createDataFrame([(i, f"l{i}x word{i} text{i}", f"lang{i % 230}") for i in range(460)], "doc_id long, text string, lang string")
    assert len(language.learn(many)) == 230


def test_language_sample_of_long_texts(spark):
    """A long text gives pieces of all of it, and no more than its part."""
    rows = [(1, "aa " * 100_000 + "bb " * 100_000 + "cc " * 100_000, "x"), (2, "dd " * 10, "x")]
    content = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=3200)["x"]
    assert len(content) < 300 and all(w in content for w in (b"aa", b"bb", b"cc", b"dd"))


def test_language_columns_with_clashing_names(spark):
    docs = frame(spark).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    got = language.predict(docs, language.learn(docs), extra=("lang_pred", "score", "lang"))
    assert got.columns == ["doc_id", "given_lang_pred", "given_score", "lang", "lang_pred", "score", "rejected"]
    assert {(r["given_lang_pred"], r["given_score"]) for r in got.collect()} == {("x", 9)}
