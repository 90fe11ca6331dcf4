"""Generation over a model behind an interface: the sampler chain, the stop rule, the context shift and the loop.

``sample`` applies the chain to one step's logits in numpy, where state between steps is needed; ``chain`` is the same
chain over a table of steps (sampling), for batches of logits that a model has written.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquill.operators import sampling

# What stands in for a missing system message, the marks of a control piece that ends a turn, and the
# pieces that break a repetition.
SYSTEM = "You are a helpful AI assistant"
STOP_MARKS = ("assistant", "end")
BREAKERS = ("\n", ":", '"', "*")


class GenerationProvider(Protocol):
    """What a model offers. end: ids that end a generation; control: ids that are never printed."""

    n_ctx: int
    end: frozenset[int]
    control: frozenset[int]

    def tokenize(self, text: str) -> list[int]: ...

    def logits(self, ids: list[int]) -> np.ndarray: ...

    def piece(self, id_: int) -> str: ...


@dataclass(frozen=True)
class PredictOptions:
    max_tokens: int = 12800
    temp: float = 0.8
    top_p: float = 0.95
    top_k: int = 40
    repeat_penalty: float = 1.1
    repeat_last_n: int = 64
    min_p: float = 0.01
    dry_multiplier: float = 1.0
    dry_base: float = 1.75
    dry_allowed: int = 2
    top_n_sigma: float = 0.0
    typical: float = 1.0
    xtc_probability: float = 0.0
    xtc_threshold: float = 1.0
    seed: int = 0
    template: str = "chatml"
    add_assistant: bool = True
    mask: Callable[[list[int]], np.ndarray] | None = field(default=None, compare=False)  # of a grammar: which tokens may follow


def _repeats(history: list[int], breakers: set[int], base: float, allowed: int, multiplier: float) -> dict[int, float]:
    """The penalty of each token that would lengthen a repetition of the history's end."""
    lengths = sampling.repeat_lengths(history, [[b] for b in breakers])
    return {t: multiplier * base ** (n - allowed) for t, n in lengths.items() if n >= allowed}


def candidates(logits: np.ndarray, history: list[int], options: PredictOptions, breakers: set[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, probabilities) that the chain leaves, the likeliest first: penalties, repetitions, sigma, top-k, typical,
    top-p, min-p, exclusion of the top, temperature."""
    x = np.array(logits, float)
    recent = Counter(history[-options.repeat_last_n :] if options.repeat_last_n else [])
    for t in recent:
        x[t] = x[t] / options.repeat_penalty if x[t] > 0 else x[t] * options.repeat_penalty
    if options.dry_multiplier > 0:
        for t, p in _repeats(history, breakers, options.dry_base, options.dry_allowed, options.dry_multiplier).items():
            x[t] -= p
    if options.mask is not None:
        x = np.where(options.mask(history), x, -np.inf)
    if options.top_n_sigma > 0:
        x = np.where(x >= x.max() - options.top_n_sigma * x[np.isfinite(x)].std(), x, -np.inf)
    order = np.lexsort((np.arange(len(x)), -x))
    order = order[np.isfinite(x[order])]
    if options.top_k > 0:
        order = order[: options.top_k]

    def soft(own: np.ndarray) -> np.ndarray:
        e = np.exp(x[own] - x[own].max())
        return e / e.sum()

    if options.typical < 1:
        p = soft(order)
        h = -(p * np.log(p)).sum()
        by = np.argsort(np.abs(-np.log(p) - h), kind="stable")
        n = int(np.searchsorted(np.cumsum(p[by]), options.typical, side="right")) + 1
        order = order[np.sort(by[:n])]
    if options.top_p < 1:
        total = np.cumsum(soft(order))
        order = order[: int(np.searchsorted(np.round(total, 12), options.top_p)) + 1]
    if options.min_p > 0:
        order = order[x[order] >= x[order].max() + np.log(options.min_p)]
    if options.xtc_probability > 0 and rng.random() < options.xtc_probability:
        above = int((soft(order) >= options.xtc_threshold).sum())
        order = order[max(0, above - 1) :]
    if options.temp <= 0:
        return order[:1], np.ones(1)
    x = x / options.temp
    return order, soft(order)


def stops(id_: int, piece: str, generated: int, options: PredictOptions, end: frozenset[int], control: frozenset[int]) -> bool:
    """A token of the end, the cap reached, or a control piece that names a turn's end. generated counts this token."""
    return id_ in end or generated >= options.max_tokens or (id_ in control and any(m in piece for m in STOP_MARKS))


def generate(provider: GenerationProvider, prompt: str, options: PredictOptions = PredictOptions()) -> Iterator[str]:
    """The pieces of an answer, one by one; a full context loses half of what follows the prompt."""
    ids, rng = list(provider.tokenize(prompt)), np.random.default_rng(options.seed)
    keep, history, generated = len(ids), list(ids), 0
    breakers = {i for b in BREAKERS for i in provider.tokenize(b)[:1]}
    while True:
        if len(ids) + 1 >= provider.n_ctx:
            gone = (len(ids) - keep) // 2
            if gone <= 0:
                return
            del ids[keep : keep + gone]
        tokens, p = candidates(provider.logits(ids), history, options, breakers, rng)
        if not len(tokens):
            return
        at = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))
        id_ = int(tokens[min(at, len(tokens) - 1)])
        generated += 1
        piece = provider.piece(id_)
        if stops(id_, piece, generated, options, provider.end, provider.control):
            return
        if id_ not in provider.control:
            yield piece
        ids.append(id_)
        history.append(id_)


def predict(prompts: DataFrame, provider: GenerationProvider, options: PredictOptions = PredictOptions(), id_col: str = "conv_id", pieces: bool = False) -> DataFrame:
    """(id, answer, n_pieces) of rows (id, prompt); with ``pieces`` a row for each piece: (id, n, piece), in order.

    The seed of a row is drawn from the options' seed and the prompt, so an answer does not depend on the partitioning.
    """
    from dataclasses import replace

    def seeded(prompt: str) -> PredictOptions:
        digest = np.frombuffer(prompt.encode(), np.uint8).astype(np.int64)
        return replace(options, seed=int((options.seed * 1000003 + int((digest * (np.arange(len(digest)) % 251 + 1)).sum())) % (1 << 63)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in range(b.num_rows):
                prompt = b.column(1)[row].as_py()
                said = list(generate(provider, prompt, seeded(prompt))) if prompt is not None else None
                one = b.column(0).slice(row, 1)
                if not pieces:
                    yield pa.RecordBatch.from_arrays([one, pa.array([None if said is None else "".join(said)], pa.string()), pa.array([None if said is None else len(said)], pa.int32())], names=[id_col, "answer", "n_pieces"])
                elif said:
                    yield pa.RecordBatch.from_arrays([one.take(pa.array([0] * len(said))), pa.array(np.arange(len(said), dtype=np.int32)), pa.array(said, pa.string())], names=[id_col, "n", "piece"])

    id_type = dict(prompts.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, n int, piece string" if pieces else f"`{id_col}` {id_type}, answer string, n_pieces int"
    return prompts.select(F.col(f"`{id_col}`"), F.col("prompt").cast("string")).mapInArrow(run, schema)


def messages_of(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text): rows (id, prompt) as a system message and the user's."""
    both = F.array(F.struct(F.lit(0).alias("turn"), F.lit("system").alias("role"), F.coalesce(F.lit(SYSTEM), F.lit("")).alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("user").alias("role"), F.coalesce(F.col("prompt"), F.lit("")).alias("text")))
    return rows.select(id_col, F.explode(both).alias("m")).select(id_col, "m.*")


def chain(logits: DataFrame, counts: DataFrame, options: PredictOptions = PredictOptions()) -> DataFrame:
    """(step, token, logit, p) that the chain leaves of tables of logits, given the recent counts (step, token, n)."""
    x = sampling.penalties(logits, counts, options.repeat_penalty, 0.0, 0.0)
    if options.top_n_sigma > 0:
        x = sampling.top_n_sigma(x, options.top_n_sigma)
    x = sampling.top_k(x, options.top_k) if options.top_k > 0 else x
    x = sampling.typical(x, options.typical) if options.typical < 1 else x
    x = sampling.top_p(x, options.top_p) if options.top_p < 1 else x
    x = sampling.min_p(x, options.min_p) if options.min_p > 0 else x
    x = sampling.xtc(x, options.xtc_threshold) if options.xtc_probability >= 1 else x
    return sampling.softmax(sampling.temperature(x.select("step", "token", "logit"), options.temp))


def stopped(tokens: DataFrame, end: list[int], control: list[int], max_tokens: int) -> DataFrame:
    """(step, pos, token, piece) of generations, up to the token that stops each; the stopping token goes, and control
    tokens are not printed. tokens: (step, pos, token, piece)."""
    from pyspark.sql import Window

    order = Window.partitionBy("step").orderBy("pos")
    marks = F.lit(False)
    for m in STOP_MARKS:
        marks = marks | F.contains(F.col("piece"), F.lit(m))
    is_control = F.col("token").isin(*control)
    stop = F.col("token").isin(*end) | (F.row_number().over(order) >= max_tokens) | (is_control & marks)
    before = F.sum(F.col("stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("stop", stop).withColumn("stops", before).where((F.col("stops") == 0) & ~is_control).select("step", "pos", "token", "piece")


class LetterProvider:
    """A small model without weights, for tests and dry runs: tokens are letters; the likeliest next one is the next letter,
    then the one after it; a control piece follows j."""

    pieces = [chr(97 + i) for i in range(26)] + ["<end>", "<|assistant|>", "\n"]
    n_ctx, end, control = 40, frozenset({26}), frozenset({26, 27})

    def tokenize(self, text: str) -> list[int]:
        return [self.pieces.index(c) for c in text if c in self.pieces]

    def logits(self, ids: list[int]) -> np.ndarray:
        x = np.full(len(self.pieces), -20.0)
        last = ids[-1] if ids else 25
        x[(last + 1) % 26], x[(last + 2) % 26] = 10.0, 5.0
        if last == 9:
            x[27] = 12.0
        return x

    def piece(self, id_: int) -> str:
        return self.pieces[id_]
