"""Token distribution transforms on rows (step, token, logit), each a window expression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def step():
    """The window of all tokens of a step."""
    return Window.partitionBy("step")


def ranked():
    """The same, most likely first."""
    return step().orderBy(F.desc("logit"), "token")


def softmax(d: DataFrame) -> DataFrame:
    e = d.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(step())))
    return e.withColumn("p", F.col("e") / F.sum("e").over(step())).drop("e")


def temperature(d: DataFrame, t: float) -> DataFrame:
    """logit / t; t of 0 or less keeps the first greatest."""
    if t <= 0:
        return d.withColumn("r", F.row_number().over(ranked())).where("r = 1").drop("r")
    return d.withColumn("logit", F.col("logit") / t)


def top_k(d: DataFrame, k: int) -> DataFrame:
    return d if k <= 0 else d.withColumn("r", F.row_number().over(ranked())).where(F.col("r") <= k).drop("r")


def top_p(d: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """The shortest prefix, most likely first, whose probabilities reach p."""
    if p >= 1:
        return d
    s = softmax(d)
    s = s.withColumn("before", F.sum("p").over(ranked().rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")).withColumn("r", F.row_number().over(ranked()))
    return s.where((F.round("before", 12) < p) | (F.col("r") <= min_keep)).select(*d.columns)


def min_p(d: DataFrame, p: float) -> DataFrame:
    return d if p <= 0 else d.withColumn("m", F.max("logit").over(step())).where(F.col("logit") >= F.col("m") + F.log(F.lit(p))).drop("m")


def typical(d: DataFrame, p: float) -> DataFrame:
    """Tokens nearest to the entropy, until their probabilities exceed p."""
    s = softmax(d).withColumn("h", F.sum(-F.col("p") * F.ln("p")).over(step()))
    s = s.withColumn("off", F.round(F.abs(-F.ln("p") - F.col("h")), 9))
    w = step().orderBy("off", "token")
    s = s.withColumn("before", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p"))
    return s.where(F.round("before", 9) <= p).select(*d.columns)


def top_n_sigma(d: DataFrame, n: float) -> DataFrame:
    if n <= 0:
        return d
    return d.withColumn("cut", F.max("logit").over(step()) - n * F.stddev_pop("logit").over(step())).where(F.round("logit", 9) >= F.round("cut", 9)).drop("cut")


def penalties(d: DataFrame, counts: DataFrame, repeat: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> DataFrame:
    """counts: (step, token, n), how often a token is among the last ones."""
    j = d.join(counts, ["step", "token"], "left")
    hit = F.when(F.col("logit") > 0, F.col("logit") / repeat).otherwise(F.col("logit") * repeat) - F.col("n") * frequency - presence
    return j.withColumn("logit", F.when(F.col("n") > 0, hit).otherwise(F.col("logit"))).drop("n")


def xtc(d: DataFrame, threshold: float) -> DataFrame:
    """Drop all tokens at or above the threshold but the least likely of them, if there are two or more."""
    s = softmax(d).withColumn("above", F.sum((F.col("p") >= threshold).cast("int")).over(step())).withColumn("r", F.row_number().over(ranked()))
    return s.where((F.col("above") < 2) | (F.col("r") >= F.col("above"))).select(*d.columns)


def draw(d: DataFrame, u: float) -> DataFrame:
    """The token at which the running probability, most likely first, reaches u."""
    s = softmax(d).withColumn("c", F.sum("p").over(ranked().rowsBetween(Window.unboundedPreceding, 0)))
    return s.where(F.col("c") >= u).groupBy("step").agg(F.min_by("token", F.struct("c", "token")).alias("token"))


def logit_bias(d: DataFrame, bias: dict[int, float]) -> DataFrame:
    """Adds a fixed amount to the logits of the tokens named."""
    if not bias:
        return d
    known = F.create_map(*(F.lit(x) for pair in bias.items() for x in (int(pair[0]), float(pair[1]))))
    return d.withColumn("logit", F.col("logit") + F.coalesce(F.try_element_at(known, F.col("token").cast("int")), F.lit(0.0)))


def dynamic_temperature(d: DataFrame, t: float, delta: float, exponent: float = 1.0) -> DataFrame:
    """logit / (low + (high - low) * relative entropy ** exponent) with low and high t -+ delta; one token stays."""
    if delta <= 0:
        return temperature(d, t)
    low, high = max(0.0, t - delta), t + delta
    s = softmax(d).withColumn("n", F.count("*").over(step()))
    s = s.withColumn("h", F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).over(step()))
    warm = low + (high - low) * F.pow(F.col("h") / F.ln(F.nullif(F.col("n"), F.lit(1))), F.lit(float(exponent)))
    s = s.withColumn("warm", warm).withColumn("r", F.row_number().over(ranked()))
    s = s.where((F.col("n") == 1) | (F.col("warm") > 0) | (F.col("r") == 1))
    return s.withColumn("logit", F.when((F.col("n") > 1) & (F.col("warm") > 0), F.col("logit") / F.nullif(F.col("warm"), F.lit(0.0))).otherwise(F.col("logit"))).select(*d.columns)


def mirostat(d: DataFrame, mu: float, vocabulary: int, m: int = 100) -> DataFrame:
    """First version: the exponent of the m likeliest tokens' decay gives the k whose surprise is mu."""
    s = softmax(d).withColumn("r", F.row_number().over(ranked())).withColumn("next", F.lead("p").over(ranked()))
    near = (F.col("r") < m) & F.col("next").isNotNull()
    t, b = F.ln((F.col("r") + 1) / F.col("r")), F.ln(F.col("p") / F.col("next"))
    s = s.withColumn("s", F.sum(F.when(near, t * b)).over(step()) / F.sum(F.when(near, t * t)).over(step()))
    e = F.col("s") - 1
    k = F.pow(e * F.pow(F.lit(2.0), F.lit(float(mu))) / F.nullif(1 - F.pow(F.lit(float(vocabulary)), -e), F.lit(0.0)), 1 / F.nullif(F.col("s"), F.lit(0.0)))
    return s.withColumn("k", F.greatest(F.coalesce(F.floor(k), F.lit(1)), F.lit(1))).where(F.col("r") <= F.col("k")).select(*d.columns)


def mirostat_v2(d: DataFrame, mu: float) -> DataFrame:
    """Tokens whose surprise in bits is at most mu; the likeliest always."""
    s = softmax(d).withColumn("r", F.row_number().over(ranked()))
    return s.where((F.round(-F.log2("p"), 9) <= mu) | (F.col("r") == 1)).select(*d.columns)


def mirostat_update(mu: float, p: float, tau: float, eta: float) -> float:
    """mu for the next step, after a token of probability p among the kept ones was drawn."""
    return mu - eta * (-math.log2(p) - tau)


def repeat_lengths(history: list[int], breakers: list[list[int]]) -> dict[int, int]:
    """For each token, how long a suffix of the history it followed earlier; no suffix reaches over a breaker."""
    n, limit = len(history), len(history)
    for back in range(n):  # the last breaker, the longest that begins there
        begin = n - 1 - back
        fits = [len(b) - 1 for b in breakers if b and history[begin : begin + len(b)] == b]
        if fits:
            limit = back - max(fits)
            break
    h, found = np.asarray(history[::-1]), {}
    for shift in range(1, n):
        same = h[: n - shift] == h[shift:]
        length = min(int(len(same) if same.all() else same.argmin()), limit)
        if length:
            token = history[n - shift]
            found[token] = max(found.get(token, 0), length)
    for b in breakers:
        if len(b) == 1:
            found.pop(b[0], None)
    return found


def dry(d: DataFrame, histories: DataFrame, multiplier: float = 1.0, base: float = 1.75, allowed: int = 2, last_n: int = 64, breakers: list[list[int]] | None = None) -> DataFrame:
    """Lowers tokens that would continue a repetition by multiplier * base ** (length - allowed).

    histories: (step, history), the tokens before the step; the last ``last_n`` count. Only their lengths are found in
    Python, over Arrow batches, in time last_n squared a step.
    """
    if multiplier == 0 or base < 1 or last_n == 0:
        return d
    stops = breakers or []

    @F.pandas_udf("array<struct<token: long, length: int>>")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda h: [] if h is None or len(h) <= allowed else [{"token": t, "length": n} for t, n in repeat_lengths([int(x) for x in h], stops).items() if n >= allowed])

    kept = histories.select("step", F.slice("history", F.greatest(F.size("history") - last_n + 1, F.lit(1)), last_n).alias("h"))
    hits = kept.select("step", F.explode(lengths("h")).alias("x")).select("step", "x.token", "x.length")
    j = d.join(hits, ["step", "token"], "left")
    return j.withColumn("logit", F.col("logit") - F.coalesce(multiplier * F.pow(F.lit(float(base)), F.col("length") - allowed), F.lit(0.0))).select(*d.columns)


# Bytes of one cached element of each type; other names count as two bytes.
CACHE_BYTES = {"f32": 4.0, "f16": 2.0, "bf16": 2.0, "q8_0": 1.125, "q4_0": 0.55, "q4_1": 0.55, "iq4_nl": 0.55, "q5_0": 0.65, "q5_1": 0.65}


def context_size(memory: Column, layers: Column, width: Column, heads: Column, kv_heads: Column, k_type: str = "f16", v_type: str = "f16", slack: float = 0.0, reserve: int = 0) -> Column:
    """Tokens whose cached keys and values fit into the memory; 0 if none do or a size is not positive."""
    each = F.floor(layers * (kv_heads * F.floor(width / F.nullif(heads, F.lit(0))) * (CACHE_BYTES.get(k_type, 2.0) + CACHE_BYTES.get(v_type, 2.0))))
    budget = F.floor(memory * (1.0 - slack)) if 0 < slack < 1 else memory
    budget = F.when(budget > reserve, budget - reserve).otherwise(budget)
    good = (layers > 0) & (width > 0) & (heads > 0) & (kv_heads > 0)
    return F.when(good & (each > 0), F.least(F.floor(budget / F.nullif(each, F.lit(0))), F.lit((1 << 32) - 1))).otherwise(F.lit(0)).cast("long")


def context_shift(position: Column, keep: Column, size: Column) -> Column:
    """How many tokens behind the kept ones go when the context is full: half of them, else none."""
    full = position + 1 >= size
    return F.when(full & (position > keep), F.floor((position - keep) / 2)).otherwise(F.lit(0)).cast("long")
