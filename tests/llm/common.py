"""Plain versions of what the operators compute, and awkward rows."""

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward():
    """doc_id, text, lang, source rows: nulls, empty and long texts, copies, shared ids, odd white space."""
    base = " ".join(f"word{i} the of" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, "", "en", "b"), (5, None, None, None), (6, "one two", "de", "b"), (6, "one two", "de", "b"), (7, "ONE two", "de", "b"),
        (8, "x " * 30000, "fr", "c"), (None, base, None, "c"), (9, "a b c　 d\x1c e\u0085f", "fr", "c"), (10, " \n\t ", "fr", ""), (11, "é" * 500 + " ü\r\n\nß", "de", "d"), (12, "🙂 " * 40, None, "d"),
        (13, "<|endoftext|> it's 'll WE'LL 3.14 a--b\n\n\n  c", "en", "d"), (6, "another text of six", "en", "a"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None):
    """With a column whose name is that of one the operators make."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("size", F.lit(-1)).repartition(3)


def bag(rows):
    return Counter(tuple(r) for r in rows)
