"""Tokenizer and vocabulary operators that need no model: pieces, spaces, vocabularies, n-grams, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space in a piece


def normalize_spaces(text: Column) -> Column:
    """Trim, one mark for each run of spaces, and a mark in front; empty stays empty."""
    t = F.regexp_replace(F.trim(text), " +", MARK)
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.lit(MARK), t))


def word_pieces(text: Column) -> Column:
    """Pieces that each begin with a mark."""
    return F.transform(F.filter(F.split(F.trim(text), " +"), lambda w: w != ""), lambda w: F.concat(F.lit(MARK), w))


def decode_pieces(pieces: Column) -> Column:
    """A leading mark of a piece becomes a space, but for the first piece's, which goes; others stay."""
    return F.ltrim(F.array_join(F.transform(pieces, lambda p: F.when(F.substring(p, 1, 1) == MARK, F.concat(F.lit(" "), F.substring(p, 2, 1 << 30))).otherwise(p)), ""))


def word_vocabulary(texts: DataFrame, size: int) -> DataFrame:
    """(piece, freq, score): the most frequent words, ties in order of the word; score is ln f - ln of the sum."""
    words = texts.select(F.explode(F.split("text", " ")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("freq"))
    total = words.agg(F.sum("freq").alias("total"))
    return words.orderBy(F.desc("freq"), "piece").limit(size).crossJoin(F.broadcast(total)).select("piece", "freq", F.round(F.ln("freq") - F.ln("total"), 6).alias("score"))


def char_counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("freq"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(left, right, freq) of adjacent characters within words: the counts of the first merge of pair training."""
    words = texts.select(F.explode(F.split("text", " ")).alias("w")).where("length(w) > 1").groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select("n", "w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")).select(F.expr("substring(w, i, 1)").alias("a"), F.expr("substring(w, i + 1, 1)").alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("freq"))


def next_words(texts: DataFrame, n: int = 2) -> DataFrame:
    """(gram, next, freq): which word follows each n-gram."""
    w = texts.select(F.split("text", " ").alias("w")).where(F.size("w") > n)
    rows = w.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - n - 1)).alias("i"))
    return rows.select(F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("gram"), F.get("w", F.col("i") + n).alias("next")).groupBy("gram", "next").agg(F.count("*").alias("freq"))


def token_windows(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, window, start, n): windows of ``size`` tokens that overlap by size // 8; each start below the count opens one. rows: (doc_id, n_tokens)."""
    stride = size - size // 8
    opened = rows.where("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(stride))).alias("window", "start"))
    return opened.select("doc_id", "window", "start", F.least(F.lit(size), F.col("n_tokens") - F.col("start")).alias("n"))


def char_coverage(counts: DataFrame, share: float) -> DataFrame:
    """The most frequent characters until they make up the share of all."""
    parts = counts.groupBy("freq").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each distinct frequency
    cut = parts.withColumn("before", F.coalesce(F.sum(F.col("freq") * F.col("k")).over(w), F.lit(0)))
    total = counts.agg(F.sum("freq").alias("total"))
    return counts.join(cut.crossJoin(F.broadcast(total)), "freq").where(F.col("before") < F.col("total") * share).select("c", "freq")
