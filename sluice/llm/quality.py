"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text. Preference pairs, a document labelled good
over one labelled bad, give the weights: the logistic loss on the difference of the pair's features, with a
ridge, is minimised by Newton's method. The strengths of all labelled rows are then cut at a quantile: the share of
labels 0 among them. Around the cut, strengths are mapped to scores from 0 to 1 with 0.5 at the cut.

The weights are fitted on a bounded sample: of each label the SAMPLE rows with the lowest hash of doc_id, with PAIRS
pairs for each row of the larger side. Labels, languages, sources and ids are no features.

The features of a text are the shares of its words in each of HASHED buckets that words are hashed to, counts of kinds
of bytes and of word shapes in relation to its length, and how much its words repeat; see SHAPES. All are computed on
whole texts.

Defined cases. Null and empty texts have all features 0 and are scored like any other. A doc_id with several labels
counts as good if any is good. Ties in the hash are broken by doc_id. With no labels of one kind every score is the
share of good labels (0.5 without any). Repeated rows are scored alike; for the cut a doc_id counts once. A very long
text is worked on whole, in about 100 bytes of memory for each of its bytes. Other columns are not looked at; a column in
`keep` with the name of one that an operator makes comes out as `given_` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.shared import crc_fold, drop_folder, given, hash_below, ranked, stored, table

#: Rows of each label that are learned from, and pairs that each row of the larger side is in.
SAMPLE, PAIRS = 4000, 8
#: The ridge on the weights of SHAPES and of words; the second was chosen by folds of the training rows.
RIDGE, WORD_RIDGE = 1e-3, 0.03

#: Buckets of words.
HASHED = 256
SHAPES = (
    "letters", "upper", "digits", "marks", "odd marks", "doubled marks", "bars", "lines", "sentence ends", "commas",
    "word length", "long words", "short words", "upper words", "marked words", "repeated neighbours", "repeated words",
    "log words", "lone marks", "lower starts", "worst neighbourhood", "plain words",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_LOWER, _UPPER = _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WIDE = (np.arange(256) >= 0x80).astype(np.uint8)
_LEAD = (np.arange(256) >= 0xC0).astype(np.uint8)
_DIGIT, _END, _COMMA, _LINE = _table("0123456789"), _table(".!?"), _table(","), _table("\n")
_BAR = _table("|")
_ODD = _table("#$%&*@^~=+<>{}[]\\/_|`")
_MARK = ((np.arange(256) > 0x20) & (np.arange(256) < 0x7F)).astype(np.uint8) * (1 - _LOWER - _UPPER - _DIGIT)
#: Words of a neighbourhood, of which the share of distinct or plain words is looked at.
NEAR = 32


def features(b: W.Block) -> np.ndarray:
    """A row for each text of a block."""
    n = len(b)
    out = np.zeros((n, len(SHAPES) + HASHED))
    if not len(b.starts):
        return out
    data, some = b.data, b.counts > 0
    size = np.maximum(np.diff(b.offsets), 1).astype(float)
    words = np.maximum(b.counts, 1).astype(float)

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind, dtype=np.int64)])
        return total[b.offsets[1:]] - total[b.offsets[:-1]]

    def words_of(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind, dtype=np.float64)])
        return total[b.first[1:]] - total[b.first[:-1]]

    mark = _MARK[data]
    upper = _UPPER[data]
    letter = _LOWER[data] + upper + _LEAD[data]
    double = np.zeros(len(data), np.uint8)
    double[1:] = (data[1:] == data[:-1]) & (mark[1:] > 0)
    double[b.offsets[:-1][b.offsets[:-1] < len(data)]] = 0
    s, e = b.starts, b.ends
    length = (e - s).astype(float)
    in_word = lambda kind: np.add.reduceat(np.append(kind, 0).astype(np.int32), np.column_stack([s, e]).ravel())[::2]
    marks, uppers, letters = in_word(mark), in_word(upper), in_word(letter)
    h = b.hashes()
    text = np.repeat(np.arange(n), b.counts)
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((h, text))
    again = np.zeros(len(s), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    shout = (uppers == letters) & (letters > 1)
    marked = marks > 1
    lone = (letters == 0) & (marks > 0)
    plain = (letters > 0) & ~shout & ~marked & ~same
    # The least share of plain words in any neighbourhood: junk that fills but a part of a text shows in it.
    total = np.concatenate([[0], np.cumsum(plain)])
    at = np.arange(len(s))
    till = np.minimum(at + NEAR, b.first[1:][text])
    begin = np.maximum(till - NEAR, b.first[:-1][text])
    near = (total[till] - total[begin]) / np.maximum(till - begin, 1)
    out[:, 0] = bytes_of(letter) / size
    out[:, 1] = bytes_of(upper) / size
    out[:, 2] = bytes_of(_DIGIT[data]) / size
    out[:, 3] = bytes_of(mark) / size
    out[:, 4] = bytes_of(_ODD[data]) / size
    out[:, 5] = bytes_of(double) / size
    out[:, 6] = bytes_of(_BAR[data]) / words
    out[:, 7] = bytes_of(_LINE[data]) / words
    out[:, 8] = bytes_of(_END[data]) / words
    out[:, 9] = bytes_of(_COMMA[data]) / words
    out[:, 10] = words_of(length) / words / 10
    out[:, 11] = words_of(length > 12) / words
    out[:, 12] = words_of(length < 4) / words
    out[:, 13] = words_of(shout) / words
    out[:, 14] = words_of(marked) / words
    out[:, 15] = words_of(same) / words
    out[:, 16] = words_of(again) / words
    out[:, 17] = np.log1p(b.counts) / 10
    out[:, 18] = words_of(lone) / words
    out[:, 19] = words_of(_LOWER[data[s]] > 0) / words
    least = np.ones(n)
    least[some] = np.minimum.reduceat(near, b.first[:-1][some])
    out[:, 20] = 1 - least
    out[:, 21] = words_of(plain) / words
    out[:, 22:] = np.bincount(text * HASHED + (h % W.U(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / words[:, None]
    out[~some] = 0
    return out


def with_features(docs: DataFrame, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns in keep, features (array of double)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *given(keep, ("doc_id", "features")), text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(SHAPES) + HASHED)), *(features(b) for b in W.blocks(batch.column(batch.num_columns - 1), W.NOT_SPACE))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "features"])

    return rows.mapInArrow(each, f"{kinds}, features array<double>")


def ridges(n: int) -> np.ndarray:
    """The ridge on the weight of each of n features; the first ones are SHAPES."""
    return np.where(np.arange(n) < len(SHAPES), RIDGE, WORD_RIDGE)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> dict:
    """Weights of a Bradley-Terry model from rows that are good or bad, on scaled features."""
    ridge = ridges(x.shape[1])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / spread
    a, b = z[good], z[~good]
    n = max(len(a), len(b))
    rows = np.arange(n * pairs)
    # Every row of the larger side meets `pairs` of the other, dealt evenly.
    left, right = rows % len(a), (rows * 7919 + rows // n) % len(b)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        grad, hess = -ridge * w, np.diag(ridge)
        for k in range(0, len(rows), 4096):
            d = a[left[k : k + 4096]] - b[right[k : k + 4096]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad += d.T @ (1 - p) / len(rows)
            hess += (d * (p * (1 - p))[:, None]).T @ d / len(rows)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "weights": w}


def strengths(model: dict, x: np.ndarray) -> np.ndarray:
    return (x - model["mean"]) / model["spread"] @ model["weights"]


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights from labelled documents (labels: doc_id, quality), without a cut."""
    marks = _marks(labels)
    share = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(share.values())
    good_share = share.get(1, 0) / n if n else 0.5
    if not share.get(0) or not share.get(1):
        return {"constant": good_share}
    key = F.xxhash64("doc_id")
    near = F.lit(False)
    for label, rows in share.items():
        near = near | ((F.col("quality") == label) & (key <= hash_below(rows, sample)))
    by = Window.partitionBy("quality").orderBy(key, "doc_id")
    chosen = marks.where(near).withColumn("n", F.row_number().over(by)).where(F.col("n") <= sample).select("doc_id", "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    texts = texts.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = with_features(texts, ("quality",)).orderBy("doc_id").collect()
    if len({r["quality"] for r in rows}) < 2:
        return {"constant": good_share}
    return fit(np.array([r["features"] for r in rows]), np.array([r["quality"] == 1 for r in rows]))


def cut_at(rated: DataFrame, labels: DataFrame) -> float:
    """The strength below which as many labelled rows of rated (doc_id, strength) lie as have label 0."""
    rows = stored(rated.groupBy("doc_id").agg(F.max("strength").alias("strength")).join(_marks(labels), "doc_id"), "labelled")
    bad, n = rows.agg(F.count_if(F.col("quality") != 1), F.count(F.lit(1))).first()
    at = [ranked(rows, "strength", min(max(k, 0), n - 1)) for k in (bad - 1, bad)]
    drop_folder(rows.sparkSession, rows.stored_at)
    return sum(at) / 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from labelled documents (labels: doc_id, quality)."""
    model = fitted(docs, labels, sample)
    if "constant" not in model:
        model["cut"] = cut_at(rate(docs, model), labels)
    return model


def rate(docs: DataFrame, model: dict, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the columns in keep, strength (null with a model of one kind of label)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), *given(keep, MADE), text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            blocks = W.blocks(batch.column(batch.num_columns - 1), W.NOT_SPACE)
            s = pa.nulls(batch.num_rows, pa.float64()) if "constant" in model else pa.array(np.concatenate([np.zeros(0), *(strengths(model, features(b)) for b in blocks)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], s], [*batch.schema.names[:-1], "strength"])

    return rows.mapInArrow(each, f"{kinds}, strength double")


def scored(rated: DataFrame, model: dict) -> DataFrame:
    """rated with score and predicted in place of strength."""
    if "constant" in model:
        score = F.lit(float(model["constant"]))
    else:
        score = 1 / (1 + F.exp(F.least(F.greatest(F.lit(float(model["cut"])) - F.col("strength"), F.lit(-30.0)), F.lit(30.0))))
    return rated.withColumn("score", score).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop("strength")


MADE = ("doc_id", "strength", "score", "predicted")


def score(docs: DataFrame, model: dict, keep: tuple = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the columns in keep, score (0 to 1, higher is better), predicted (1 from 0.5 on)."""
    return scored(rate(docs, model, keep, id_col, text_col), model)


FOLDS, HELD_OUT = 3, 1


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.coalesce(crc_fold(F.col("doc_id"), FOLDS), F.lit(0))
    learned = labels.where(fold != HELD_OUT)
    model = fitted(docs, learned)
    rated = stored(rate(docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out")), model, ("held_out",)), "strengths")
    if "constant" not in model:
        model["cut"] = cut_at(rated, learned)
    return scored(rated, model)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_quality_ranking": op3_quality_ranking}
