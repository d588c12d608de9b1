"""Words that cancel out in polynomials modulo a power of two, in every operator that hashes words."""

import zlib

import numpy as np
import pyarrow as pa

from sluice.llm import attribution, codes, minhash, repeats
from sluice.llm import words as W
from sluice.llm.tokens import Encoder, vocabulary
from tests.llm.common import words
from tests.llm.test_formats import expected_attribution, library  # noqa: F401
from tests.llm.test_text_operators import components, removed


def thue_morse(n, letters="ab"):
    """n letters, and the same with the letters exchanged."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_hashes_of_words_differ():
    rows = [x for n in (1, 2, 8, 64, 512, 1024, 2048, 4096) for x in thue_morse(n)]
    rows += ["a" * n for n in range(1, 600)] + ["a" * n + "\0" for n in (5, 7, 8, 15, 300)]
    for second in (False, True):
        b = next(iter(W.blocks(pa.array([" ".join(rows)]), W.NOT_SPACE)))
        h = b.hashes(second)
        same = {w: i for i, w in enumerate(rows)}
        assert len(set(h.tolist())) == len(same)
        moved = next(iter(W.blocks(pa.array(["é " + " ".join(rows)]), W.NOT_SPACE))).hashes(second)
        assert (moved[1:] == h).all()  # wherever the word stands


def test_grams_tell_order_and_length():
    h = np.random.default_rng(1).integers(0, 1 << 63, 3, dtype=np.int64).astype(W.U)
    sequence = h[np.random.default_rng(2).integers(0, 3, 4000)]
    for second in (False, True):
        for n in (1, 2, 3, 5, 8, 13, 20, 4000):
            g = W.grams(sequence, n, second)
            assert len(g) == 4000 - n + 1
            known = {}
            for i, x in enumerate(g.tolist()):
                assert known.setdefault(x, sequence[i : i + n].tolist()) == sequence[i : i + n].tolist()
            assert len({tuple(sequence[i : i + n].tolist()) for i in range(len(g))}) == len(known)
    assert len(W.grams(h, 4)) == 0


def test_encoder_with_such_words(spark, library):  # noqa: F811
    texts = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    rows = [(i, t) for i, t in enumerate([*texts, " ".join(texts), *(f"x {t} y" for t in texts)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 0] for _, t in rows]
    assert [r["ids_crc32"] for r in codes.token_files(docs).orderBy("doc_id").collect()] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    got = sorted(tuple(r) for r in attribution.attribute(docs).collect())
    assert got == [(i, *x) for i, t in rows for x in expected_attribution(library, t)]


def test_encoder_when_hashes_collide(library):  # noqa: F811
    """Pieces with one hash for all: the bytes decide."""

    class Poor(Encoder):
        def _hashes(self, data, starts, ends):
            return ((ends - starts) // 4).astype(W.U)

    rows = ["one two three four", "fore five six  seven\n", "", "one two", "ab abcdefgh"]
    for b in W.blocks(pa.array(rows), W.NOT_SPACE):
        poor = Poor(vocabulary())
        for _ in range(2):
            ids, counts = poor.encode(b)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_encoder_with_another_pattern(tmp_path):
    """A vocabulary that splits texts in another way goes to the library whole."""
    import json

    from tokenizers import Tokenizer

    own = json.loads(Tokenizer.from_file(vocabulary()).to_str())
    own["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "v.json").write_text(json.dumps(own))
    encoder = Encoder(str(tmp_path / "v.json"))
    rows = ["the end of the", "a b", ""]
    ids, counts = encoder.encode(next(iter(W.blocks(pa.array(rows), W.NOT_SPACE))))
    plain = Tokenizer.from_file(str(tmp_path / "v.json"))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in plain.encode_batch(rows, add_special_tokens=False)]


def test_encoder_on_long_mixed_texts(library):  # noqa: F811
    """The cuts hold for this vocabulary in long texts of many scripts, marks and kinds of white space."""
    import random

    rng = random.Random(11)
    marks = ["the", "über", "naïve", "漢字仮名", "привет", "ελλάδα", "مرحبا", "🙂🙃", "don't", "WE'LL", "x'", "'", "''s", "3.14", "1,000", "a--b", "_x_", "<b>", "...", "\t", "\n", "\n\n", "\r\n", "  ", "   ", " ", " ", " ", " ", " ", " ", "　", "é", "́"]
    texts = ["".join(rng.choice(marks) for _ in range(20_000)) for _ in range(4)]
    texts += ["".join(rng.choice([m for m in marks if m not in (" ", "　")]) for _ in range(20_000)) for _ in range(4)]
    encoder, got = Encoder(vocabulary()), []
    for b in W.blocks(pa.array(texts), W.NOT_SPACE):
        ids, counts = encoder.encode(b)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_substring_dedup_with_such_words(spark):
    a, b = thue_morse(1024)
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{a} {same}"), (4, f"{same} {b} {same}"), (5, f"{same} {a}")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed([(i, words(t)) for i, t in rows])
    assert got[1]["n_removed"] == 0 and got[4]["n_removed"] == 20


def test_near_duplicates_with_such_words(spark):
    a, b = thue_morse(1024)
    rows = [(1, f"one two three four {a}"), (2, f"one two three four {b}"), (3, a), (4, b), (5, f"{a} {b}"), (6, f"{b} {a}")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == components(rows)
    assert all(r["kept"] for r in got)
