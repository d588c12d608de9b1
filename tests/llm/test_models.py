import zlib

import numpy as np

from sluice.llm import language, mixture, quality, queries
from tests.llm.common import DIR, awkward, frame, words


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op8_language_id"](spark, DIR).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held if truth[r["doc_id"]]]) > 0.95


def test_language_awkward(spark):
    docs = frame(spark)
    model = language.learn(docs)
    assert set(model) == {"de", "en", "fr"}
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for i in (4, 5, 10, 12):
        assert tuple(got[i])[1:] == ("und", 0.0, True)
    assert got[1]["lang_pred"] == "en" and got[3]["lang_pred"] == "en"
    assert got[8]["rejected"]  # one letter over and over: every dictionary does equally well
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (4, 5, 10, 12)").count() == 0
    assert language.learn(frame(spark, [])) == {}
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def tongues():
    """For each of two made-up languages a function that gives a text of n bytes of its words."""
    rng = np.random.default_rng(5)
    out = {}
    for lang, letters in (("aa", "aeioklmnprst"), ("bb", "bdfghjuvwxyz")):
        vocabulary = np.array(["".join(rng.choice(list(letters), rng.integers(3, 10))) for _ in range(3000)])
        out[lang] = lambda n, v=vocabulary: " ".join(v[rng.integers(0, len(v), n // 4)])[:n]
    return out


def test_language_of_clean_long_text(spark):
    text = tongues()
    docs = spark.createDataFrame([(i, text[x](2000), x) for i, x in enumerate(["aa", "bb"] * 150)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    long = spark.createDataFrame([(1000 + n, text[x](n), x) for x in text for n in (60_000, 1_000_000, 5_000_000)], docs.schema)
    got = {(r["lang"], r["doc_id"]): r for r in language.predict(long, model, extra=("lang",)).collect()}
    assert len(got) == 6 and all(r["lang_pred"] == x and not r["rejected"] for (x, _), r in got.items())
    assert language.keep_identified(long, model).count() == 6
    for x in text:  # the margin doesn't shrink with the length
        assert got[x, 5_001_000]["score"] - 0.5 > 0.8 * (got[x, 61_000]["score"] - 0.5)


def test_language_of_whole_text_not_its_opening():
    text = tongues()
    judge = language.Judge({x: text[x](language.DICT_BYTES).encode() for x in text})
    for opening, rest in (("aa", "bb"), ("bb", "aa")):
        for n in (50_000, 150_000):
            assert judge.one(text[opening](n) + " " + text[rest](2_500_000))[::2] == (rest, False)


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = queries.QUERIES["op3_quality_ranking"](spark, DIR).collect()
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_bradley_terry_orders():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    good = x @ np.array([2.0, -1.0, 0.0]) > 0
    s = quality.strengths(quality.fit(x, good), x)
    assert np.mean(s[good][:, None] > s[~good]) > 0.99


def test_quality_awkward(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (6, 1), (13, 0), (None, 1), (2, None), (77, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 10)}) == 1
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(frame(spark, []), model).collect() == []


def shares(sizes):
    """Targets by filling up, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in open_}}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full


def test_mixing(spark):
    rows = awkward() + [(1000 + i, "w " * (i % 37), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(900)]
    docs = frame(spark, rows)
    for each in (50_000, 40):  # the second cuts the key ranges small
        got = mixture.mix(docs, range_rows=each).collect()
        sizes = {}
        for _, text, _, source in rows:
            sizes[source] = sizes.get(source, 0) + len(words(text))
        target = shares(sizes)
        taken = {}
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s, n in taken.items():
            most = max(len(words(t)) for _, t, _, o in rows if o == s)
            assert abs(n - target[s]) <= most
    again = mixture.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixture.mix(docs).collect()))
    made = mixture.sample(docs)
    assert made.columns == docs.columns
    assert made.count() == sum(r["taken"] // r["size"] for r in again if r["size"])
    assert mixture.mix(frame(spark, [])).collect() == [] and mixture.sample(frame(spark, [])).collect() == []
