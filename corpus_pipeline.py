"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir); its result is written to the shared folder and read back as the next one's
docs. All but the last return the columns of documents.

Defined cases. A null or empty text, and one without a letter, has no language and goes in the first stage; so do all
texts where no row has both a text and a lang. Rows without a doc_id stay in near_dedup, each of them; of repeated rows,
and of rows that share a doc_id, one stays there. A null source is a source of its own in mixing. A very long text is
worked on whole in every stage. Empty tables give empty results; without benchmark items no document is contaminated,
and without labels all weigh alike. Other columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import codes, decontaminate, language, minhash, mixture
from sluice.llm.shared import drop_folder, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language is unknown or in doubt; the languages are learned from docs' own labels."""
    return language.keep_identified(docs, language.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the benchmark's windows contaminate."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixture.sample(docs, mixture.label_weights(table(spark, sf_dir, "labels")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in token files, read back: doc_id, start, n_tokens, ids_crc32 for each row."""
    return codes.token_files(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: Compression, signatures and tokens have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes as soon as the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before:
            drop_folder(spark, before)
        before = docs.stored_at
    out = STAGES[-1][1](spark, docs, sf_dir)
    if not any(f.startswith(before) for f in out.inputFiles()):  # the token files hold all that it read
        drop_folder(spark, before)
    return out
