"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one statistic of a whole text and votes 1 (good), 0 (bad) or abstains. The votes of all documents
are counted by pattern (a bounded table: there are 3**rules patterns at most), a two-class model with one accuracy
per rule and class is fitted to these counts by expectation-maximisation, and a document is kept if the posterior
probability of good quality is 0.5 or more and the base rules hold. Nothing is sampled.

Defined results: a null or empty text has no words, so the base rule fails and it is not kept; an empty table gives an
empty result; repeated rows each get the same answer; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.llm.shared import batches_of, bounded_batches, durable, first_of_groups
from vecquill.llm.textbytes import _SPACE, slices, span_hashes, text_buffer, window_hashes, word_spans

# The symbols and thresholds of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[33, 63, 46, 44, 58, 59]] = True
_STOP = np.zeros(256, bool)
_STOP[[46, 33, 63]] = True

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_digits", "n_bangs", "n_chars", "n_lines", "n_distinct_words", "n_stops"]


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def repeat_words(h: np.ndarray, first: np.ndarray, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each document, the words that lie in a window of k words which occurs twice or more in it."""
    n, rows = len(h), len(first) - 1
    w = window_hashes(h, k)
    doc = np.repeat(np.arange(rows), np.diff(first))
    if len(w) == 0:
        return np.zeros(rows, np.int64)
    inside = doc[: len(w)] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    key = w[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = first_of_groups(key[order])
    sizes = np.diff(np.concatenate([s, [len(order)]]))
    hot = at[order[np.repeat(sizes > 1, sizes)]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hot, 1)
    np.add.at(edge, hot + k, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, first)


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every document of a slice."""
    rows = len(offs) - 1
    starts, ends, first = word_spans(data, offs)
    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    space = _SPACE[data]
    out = {"n_words": np.diff(first), "word_chars": _sums(_LEAD[data] & ~space, offs), "n_symbols": _sums(_SYMBOL[data], offs), "n_chars": _sums(_LEAD[data], offs)}
    out |= {"n_upper": _sums(_UPPER[data], offs), "n_alpha": _sums(_ALPHA[data], offs), "n_digits": _sums(_DIGIT[data], offs), "n_bangs": _sums((data == 33) | (data == 63), offs), "n_stops": _sums(_STOP[data], offs)}
    out["n_repeat_words"] = repeat_words(h, first)
    ls, le, lf = word_spans(data, offs, _NEWLINE)  # runs between newlines; empty lines have no word anyway
    words_to = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    worded = words_to[le] > words_to[ls]
    lh = span_hashes(data, ls, le)
    ldoc = np.repeat(np.arange(rows), np.diff(lf))
    key = lh[worded] ^ (ldoc[worded].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    fresh = np.zeros(len(order), bool)
    fresh[first_of_groups(key[order])] = True
    out["n_dup_lines"] = np.bincount(ldoc[worded][order[~fresh]], minlength=rows).astype(np.int64)
    out["n_lines"] = np.bincount(ldoc[worded], minlength=rows).astype(np.int64)
    order = np.lexsort((h, doc))
    hd, dd = h[order], doc[order]
    new = np.ones(len(hd), bool)
    new[1:] = (hd[1:] != hd[:-1]) | (dd[1:] != dd[:-1])
    out["n_distinct_words"] = np.bincount(dd[new].astype(np.int64), minlength=rows).astype(np.int64)
    return {k: out[k] for k in STATISTICS}


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each rule: 1 good, 0 bad, -1 abstains."""
    n, w = np.maximum(s["n_words"], 1), s["n_words"]
    chars, lines = np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    mean = s["word_chars"] / n

    def rule(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1)).astype(np.int64)

    repeat, symbol, upper = s["n_repeat_words"] / n, s["n_symbols"] / n, s["n_upper"] / np.maximum(s["n_alpha"], 1)
    variety = s["n_distinct_words"] / n
    return np.stack([
        rule(repeat <= 0.05, repeat > 0.12),
        rule(symbol <= 0.02, symbol > 0.10),
        rule(upper <= 0.15, upper > 0.40),
        rule((mean >= 3.0) & (mean <= 9.0), (mean < 2.0) | (mean > 14.0)),
        rule(s["n_bangs"] / n <= 0.05, s["n_bangs"] / n > 0.25),
        rule(s["n_dup_lines"] / lines <= 0.10, s["n_dup_lines"] / lines > 0.35),
        rule((variety >= 0.35) | (w > 400), (variety < 0.20) & (w < 2000)),
        rule(s["n_stops"] / n >= 0.02, (s["n_stops"] == 0) & (w > 30)),
        rule(s["n_symbols"] / chars <= 0.005, s["n_symbols"] / chars > 0.04),
        rule(s["n_alpha"] / chars >= 0.74, s["n_alpha"] / chars < 0.66),
    ], axis=1)


N_RULES = 10


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int = N_RULES, rounds: int = 60) -> dict[str, np.ndarray]:
    """Two-class EM on counted vote patterns. Priors keep every rule better than chance and anchor the classes."""
    v = patterns[:, None] // 3 ** np.arange(rules) % 3 - 1
    good, bad = v == 1, v == 0
    # the start: the share of votes that are good, a bad vote weighing more, as most texts break no rule
    q = np.clip((good.sum(1) + 1) / (good.sum(1) + 3 * bad.sum(1) + 2), 0.02, 0.98)
    model = {}
    for _ in range(rounds):
        n1, n0 = counts * q, counts * (1 - q)
        prior = (n1.sum() + 8) / (counts.sum() + 10)
        a1 = ((n1[:, None] * good).sum(0) + 9) / ((n1[:, None] * (good | bad)).sum(0) + 10)
        a0 = ((n0[:, None] * bad).sum(0) + 6) / ((n0[:, None] * (good | bad)).sum(0) + 10)
        a1, a0 = np.clip(a1, 0.6, 0.999), np.clip(a0, 0.15, 0.999)
        model = {"prior": prior, "a1": a1, "a0": a0}
        q = posterior(v, model)
    return model


def posterior(v: np.ndarray, m: dict) -> np.ndarray:
    """The probability of good quality given the votes."""
    good, bad = v == 1, v == 0
    z = np.log(m["prior"] / (1 - m["prior"])) + (good * np.log(m["a1"] / (1 - m["a0"]))).sum(1) + (bad * np.log((1 - m["a1"]) / m["a0"])).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes' posterior and verdict of each row: id, the statistics, base_failed, quality, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = dict(docs.dtypes)[id_col]

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            data, offs = text_buffer(b.column(1))
            for lo, hi, d, o in slices(data, offs):
                s = statistics(d, o)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(s[k].astype(np.int64)) for k in STATISTICS), pa.array(pattern_of(votes(s)))], names=["id", *STATISTICS, "pattern"])

    measured = durable(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(measure, f"id {id_type}, {', '.join(f'{s} long' for s in STATISTICS)}, pattern long"))
    counted = measured.groupBy("pattern").count().toPandas()  # 3**rules rows at most
    known = {}
    if len(counted):
        pats = counted["pattern"].to_numpy(np.int64)
        model = fit(pats, counted["count"].to_numpy(np.float64))
        known = dict(zip(pats.tolist(), posterior(pats[:, None] // 3 ** np.arange(N_RULES) % 3 - 1, model).tolist()))
    lookup = spark.createDataFrame(sorted(known.items()) or [], "pattern long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.join(F.broadcast(lookup), "pattern", "left")
        .withColumn("base_failed", failed)
        .select(F.col("id").alias(id_col), *STATISTICS, "base_failed", "quality", (~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= 0.5)).alias("kept"))
    )
