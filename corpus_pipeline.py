"""A corpus pipeline of five stages over ``documents``; each takes what its predecessor kept.

Toxic documents go; of each near-duplicate group one document stays; words of passages that recur across documents go;
documents with a benchmark item go; what is left is packed into sequences of token ids. All stages but the last return
the columns of documents. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquill.llm import decontamination, minhash, packing, substring_dedup, toxicity
from vecquill.llm.shared import durable, mark, read, release

#: Shingles of the near-duplicate and benchmark stages: five words, similarity 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), keep=True)
    return scored.where("__predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each near-duplicate group."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), k=SHINGLE_WORDS, percent=PERCENT)
    gone = groups.where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a document of smaller id has too; n_chars follows the text."""
    kept = substring_dedup.remove_repeats(docs)
    text = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return kept.select(*(text[c].alias(c) if c in text else F.col(f"__row.`{c}`") for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is like a benchmark item."""
    leaks = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"), k=SHINGLE_WORDS, percent=PERCENT)
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows, since = read(spark, sf_dir, "documents"), mark()
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = durable(rows)
            release(spark, since, mark() - 1)  # what the stage has written and read, but for its result
            since = mark() - 1
    return rows
