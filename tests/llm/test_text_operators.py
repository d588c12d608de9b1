import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sluice.llm import decontaminate, minhash, repeats
from tests.llm.common import DIR, LOWER, SCHEMA, awkward, bag, frame, words


def removed(rows):
    """Substring dedup by definition: rows are (id, words), ids distinct."""
    seen, out = set(), []
    for _, w in sorted(rows):
        goes = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                goes[i : i + 20] = [True] * 20
            seen.add(key)
        out.append((len(w), sum(goes), " ".join(x for x, g in zip(w, goes) if not g)))
    return out


def test_substring_dedup_by_definition(spark):
    import random

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for k in range(60):
        w = [rng.choice("a b c d e the of".split()) for _ in range(rng.randrange(80))]
        if k % 2:
            i = rng.randrange(20)
            w[rng.randrange(len(w) + 1) :] = passage[i : i + rng.randrange(15, 45)]
        rows.append((k, " ".join(w) if k % 5 else " ".join(w + w + w)))
    rows += [(100, "x " * 200), (101, "x " * 25), (102, None), (103, "")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    expected = removed([(i, words(t)) for i, t in rows])
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == expected


def test_substring_dedup_awkward(spark):
    got = repeats.remove_repeats(frame(spark)).collect()
    assert len(got) == len(awkward())
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[(1, 180)]["n_removed"] == 0 and by[(2, 180)]["n_removed"] == 180 and by[(None, 180)]["kept"] == ""
    assert by[(5, 0)]["kept"] == "" and by[(6, 2)]["kept"] == "one two"
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    import random

    rng = random.Random(9)
    rows, k = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            rows.append((k := k + 1, " ".join(w).upper() if k % 3 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "two one")]
    for block in (256, 3):  # the second deals every bucket into blocks
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_at_another_overlap(spark):
    """What keep_one() leaves at 0.8, by brute force over the documents; it is less than at 0.85."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = words(r["text"].translate(LOWER)) if r["text"] else []
        sets[r["doc_id"]] = {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()
    close = {n: [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= n * len(sets[i] | sets[j])] for n in (80, 85)}
    assert len(close[80]) > len(close[85])
    left = {}
    for n, pairs in close.items():
        component = {i: i for i in sets}
        while any(component[i] != component[j] for i, j in pairs):
            for i, j in pairs:
                component[i] = component[j] = min(component[i], component[j])
        left[n] = {i for i, c in component.items() if i == c}
        assert {r["doc_id"] for r in minhash.keep_one(docs, ratio=(n, 100)).collect()} == left[n]
    assert left[80] < left[85]
    assert minhash.min_agree((85, 100)) == 50 and minhash.min_agree((80, 100)) <= 45


def test_near_duplicates_awkward(spark):
    docs = frame(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(awkward())
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "8", "9", "10", "11", "12", "13", "None"])
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def hits(text, items, ngram=13):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = [False] * len(w), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(ngram, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit[k : k + n] = [True] * n
                found.add(str(i))
    return len(w), sum(hit), ",".join(sorted(found))


def test_decontamination_by_definition(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "short item"), (3, None), (10, "Short, ITEM"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1], r[2], r[3]) for r in awkward()] + [(50, "a short item! " + " ".join(f"Q{i}" for i in range(3, 18)) + " end" * 300, "en", "a"), (51, " ".join(f"q{i}" for i in range(12)), "en", "a"), (52, "short-item", "en", "a")]
    docs = frame(spark, rows)
    expected = Counter((i, *hits(t, items)) for i, t, _, _ in rows)
    for most in (500_000, 3):  # the second deals the windows into slices
        got = decontaminate.find(docs, bench, max_windows=most)
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got.collect()) == expected
        kept = decontaminate.remove(docs, bench, max_windows=most)
        assert kept.columns == docs.columns
        assert bag(kept.select("doc_id").collect()) == Counter((i,) for i, t, _, _ in rows if not (h := hits(t, items))[1] or 20 * h[1] < h[0])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench, whole=False).where("doc_id >= 50").collect()}
    assert cut[52] == "" and cut[50].startswith("a  ") and cut[50].endswith("end end")
    assert decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
    assert SCHEMA.startswith("doc_id")
