"""Training of unigram pieces, and what a vocabulary's training needs: sentences with their counts, valid pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.operators.piecemodel import CONTROL, NORMAL, UNIGRAM, UNKNOWN, PieceModel
from vecquill.operators.text import MARK

#: Characters of the longest piece.
LONGEST = 16
_SCRIPTS = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in ("Latin", "Greek", "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")]


def digamma(x: float) -> float:
    out = 0.0
    while x < 7:
        out -= 1 / x
        x += 1
    x -= 0.5
    y = 1 / (x * x)
    return out + math.log(x) + y * (1 / 24 - y * (7 / 960 - y * (31 / 8064 - y * 127 / 30720)))


def script_of(c: str) -> str:
    if c.isdigit():
        return "digit"
    name = next((n for n, p in _SCRIPTS if p.match(c)), "common")
    return "Han" if name in ("Hiragana", "Katakana") or c == "ー" else name


def valid_piece(piece: str, split_digits: bool = False, by_script: bool = True, by_number: bool = True) -> bool:
    """No longer than LONGEST, a mark only in front, characters of one script, digits not beside other characters."""
    if not piece or len(piece) > LONGEST:
        return False
    rest = piece[1:] if piece[0] == MARK else piece
    if MARK in rest or " " in rest or "\0" in rest:
        return False
    if split_digits and len(rest) > 1 and any(c.isdigit() for c in rest):
        return False
    kinds = {script_of(c) for c in rest} - ({"common"} if by_number else {"common", "digit"})
    return len(kinds) <= 1 or not by_script


def sentences(texts: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """(text, n): each distinct sentence with its count; with ``most``, a sample of so many by the order of a hash."""
    once = texts.where("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return once if most is None else once.orderBy(F.xxhash64("text", F.lit(seed)), "text").limit(most)


def word_table(texts: DataFrame) -> DataFrame:
    """(w, n): the distinct words with a mark in front, and their counts."""
    words = texts.select(F.explode(F.split(F.trim("text"), " +")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n")).select(F.concat(F.lit(MARK), "w").alias("w"), "n")


def seed_pieces(words: DataFrame, size: int) -> dict[str, int]:
    """Piece -> count: all characters, and the ``size`` substrings of words that save most characters and occur twice or more."""
    at = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    cut = at.select("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("w") - F.col("i") + 1))).alias("k"), "w", "i").select("n", F.substring("w", F.col("i"), F.col("k")).alias("piece"))
    counts = cut.groupBy("piece").agg(F.sum("n").alias("n"))
    chars = {r.piece: r.n for r in counts.where("length(piece) = 1").collect()}  # the alphabet
    longer = counts.where("length(piece) > 1 and n > 1").orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(size)
    return chars | {r.piece: r.n for r in longer.collect() if valid_piece(r.piece)}  # size rows at most


def _expected(words: DataFrame, model: PieceModel) -> tuple[dict[str, float], float]:
    """Expected counts of the pieces over all words, and their log likelihood; summed in each task, then by piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        like = 0.0
        for batch in batches:
            for w, n in zip(batch.w, batch.n):
                counts, one = model.expected_counts(w)
                like += n * one
                for p, c in counts.items():
                    total[p] += n * c
        yield pd.DataFrame([*total.items(), ("", like)], columns=["piece", "c"])

    rows = words.mapInPandas(run, "piece string, c double").groupBy("piece").agg(F.sum("c").alias("c")).collect()  # pieces of the model
    found = {r.piece: r.c for r in rows}
    return found, found.pop("", 0.0)


def _model(scores: dict[str, float]) -> PieceModel:
    special = (("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL))
    return PieceModel((*special, *((p, s, NORMAL) for p, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])))), UNIGRAM)


def train_unigram(texts: DataFrame, size: int, seed_size: int = 1_000_000, steps: int = 2, shrink: float = 0.75) -> PieceModel:
    """Pieces of a unigram model: expectation and maximisation over the word counts, then the pieces go whose loss is least,
    until ``size`` are left; single characters stay. The driver holds the pieces, never the words."""
    words = word_table(texts).persist()
    try:
        counts = seed_pieces(words, seed_size)
        if not counts:
            raise ValueError("no words to train on")
        total = sum(counts.values())
        scores = {p: math.log(n) - math.log(total) for p, n in counts.items()}
        alphabet = {p for p in scores if len(p) == 1}
        wanted = max(size - 3, len(alphabet))
        while True:
            for _ in range(steps):
                expected, _ = _expected(words, _model(scores))
                kept = {p: c for p, c in expected.items() if p in scores and (c >= 0.5 or p in alphabet)}
                norm = digamma(sum(kept.values()))
                scores = {p: digamma(max(c, 0.5)) - norm for p, c in kept.items()} | {p: digamma(0.5) - norm for p in alphabet - set(kept)}
            if len(scores) <= wanted * 1.1 or len(scores) == len(alphabet):
                break
            scores = _pruned(scores, expected, alphabet, max(int(len(scores) * shrink), int(wanted * 1.1)))
        best = sorted(scores, key=lambda p: (p not in alphabet, -scores[p], p))[:wanted]
        return _model({p: scores[p] for p in best})
    finally:
        words.unpersist()


def _pruned(scores: dict[str, float], expected: dict[str, float], alphabet: set[str], keep: int) -> dict[str, float]:
    """The pieces whose going would lose most likelihood: a piece's uses would be cut by its second best segmentation."""
    model = _model(scores)
    total = sum(expected.values())
    loss = {}
    for p in scores:
        if p in alphabet:
            continue
        other = [(s, cuts) for s, cuts in model._paths(p, 2) if len(cuts) > 1]
        if not other:
            loss[p] = math.inf
            continue
        n = expected.get(p, 0.0)
        loss[p] = n / total * (scores[p] - other[0][0])
    best = sorted(loss, key=lambda p: (-loss[p], p))[: max(0, keep - len(alphabet))]
    return {p: scores[p] for p in (*alphabet, *best)}


def coverage(texts: DataFrame, share: float = 0.9995) -> DataFrame:
    """(c, freq): the most frequent characters that make up the share; equal counts stay or go together."""
    from vecquill.operators.text import char_counts, char_coverage

    return char_coverage(char_counts(texts), share)
