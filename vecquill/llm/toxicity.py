"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the vectors of its hash and of the hashes of its first four and five bytes; filters of
width 1, 2 and 3 run over the words of the whole text, each filter keeps its maximum, and a logistic layer joins these
maxima. The vectors' first components start from the class log odds of their bucket in the training rows. Thresholds
are calibrated for each language on a part of the training rows that the gradient steps do not see, and a score is
shifted so that 0.5 is the threshold of the text's language. The language is told from function words in the text
itself, never from a column.

Training reads ``per_class`` rows of each class at most (a documented bound); every row is scored on its whole text.

Defined results: a null or empty text has no words and gets the score of an all-padding text; a null id is in the
held-out fold; with no labelled rows, or rows of one class only, every score is 0.0 or 1.0 for that class (0.0 for
none); of rows that repeat an id, training takes the least text, and
all are scored; of repeated labels the greater one holds; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquill.llm.samples import fold, labelled_sample
from vecquill.llm.shared import batches_of, bounded_batches
from vecquill.llm.textbytes import lowered, slices, span_hashes, text_buffer, word_spans

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BUCKETS = (1 << 15, 1 << 13, 1 << 14)  # of words, first four bytes, first five bytes
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
PAD = sum(BUCKETS)  # the row of the vector table that stays zero
# Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with it on are be this from or an by not",
    "fr": "le les et des une du est dans pour que qui sur pas au par plus ne se sont avec",
    "de": "der die und das ist den von zu mit dem nicht ein eine auf im sich auch es an wie",
    "es": "el los las y por con del una para su al lo como más pero sus no se mi así",
}
LANGUAGES = list(FUNCTION_WORDS)


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = [(w.encode(), i) for i, k in enumerate(LANGUAGES) for w in FUNCTION_WORDS[k].split()]
    data = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
    ends = np.cumsum([len(w) for w, _ in words])
    h = span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    order = np.argsort(h, kind="stable")
    return h[order], np.array([i for _, i in words])[order]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Vector rows of each word (three arrays, with two padding words after each text), first words, languages."""
    d = lowered(data)
    starts, ends, first = word_spans(d, offs, _BREAK)
    rows, per = len(offs) - 1, np.diff(first)
    h = span_hashes(d, starts, ends)
    hashes = [h, span_hashes(d, starts, np.minimum(ends, starts + 4)), span_hashes(d, starts, np.minimum(ends, starts + 5))]
    doc = np.repeat(np.arange(rows), per)
    known, lang = _FUNCTION
    j = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[j] == h
    votes = np.zeros((rows, len(LANGUAGES)), np.int64)
    np.add.at(votes, (doc[hit], lang[j[hit]]), 1)
    place = np.arange(len(h)) + 2 * doc
    out, base = [], 0
    for x, size in zip(hashes, BUCKETS):
        wide = np.full(len(h) + 2 * rows, PAD, np.int64)
        wide[place] = base + (x % np.uint64(size)).astype(np.int64)
        out.append(wide)
        base += size
    return out, first[:-1] + 2 * np.arange(rows), np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES)) if rows else np.zeros(0, np.int64)


_FUNCTION = _function_hashes()


class Network:
    """Vectors, filters and the logistic layer, with their training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(0, 0.02, (PAD + 1, DIM))).astype(np.float32)
        self.table[PAD] = 0
        self.filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, :3, : FILTERS // 2] += 0.5  # half of the filters begin as sums of the log odds
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32) + np.tile(np.repeat([0.3, 0.0], FILTERS // 2), len(WIDTHS)).astype(np.float32)
        self.shift = np.float32(-1.0)
        self.threshold = np.zeros(len(LANGUAGES) + 1)
        self.constant: float | None = None

    def pooled(self, words: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = self.table[words[0]]
        for w in words[1:]:
            x = x + self.table[w]
        maxima, maps = [], []
        for f, b in zip(self.filters, self.bias):
            y = x @ f[0]
            for j in range(1, len(f)):
                y[:-j] += x[j:] @ f[j]  # padding keeps a text's windows apart from the next one's but for its last
            y = np.maximum(y + b, 0)
            for j in range(1, len(f)):
                y[np.concatenate([first[1:], [len(x)]]) - j] = 0
            maps.append(y)
            maxima.append(np.maximum.reduceat(y, first, axis=0))
        return np.concatenate(maxima, axis=1), maps, x

    def logits(self, words: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        return self.pooled(words, first)[0] @ self.out + self.shift

    def start_from_log_odds(self, texts: list[tuple], y: np.ndarray) -> None:
        counts = np.zeros((2, PAD + 1))
        for (words, _, _), label in zip(texts, y):
            for w in words:
                counts[label, np.unique(w)] += 1
        n = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        odds[counts.sum(0) < 4] = 0
        odds[PAD] = 0
        base = 0
        for k, size in enumerate(BUCKETS):
            self.table[base : base + size, k] = 0.4 * np.clip(odds[base : base + size], -1, 5)
            base += size

    def train(self, texts: list[tuple], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        dense = [*self.filters, *self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-6), 0.5 / max((y == 0).mean(), 1e-6)).astype(np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                words = [np.concatenate([texts[i][0][k] for i in own]) for k in range(3)]
                first = np.concatenate([[0], np.cumsum([len(texts[i][0][0]) for i in own])])[:-1]
                p, maps, x = self.pooled(words, first)
                z = p @ self.out + self.shift
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)).astype(np.float32)
                grad_out, gp = p.T @ g, g[:, None] * self.out[None, :]
                grads, gb, gx = [], [], {}
                sizes = np.diff(np.concatenate([first, [len(x)]]))
                for k, (f, y_map) in enumerate(zip(self.filters, maps)):
                    top = p[:, k * FILTERS : (k + 1) * FILTERS]
                    gf, gbias = np.zeros_like(f), np.zeros(FILTERS, np.float32)
                    at = np.flatnonzero(y_map.ravel() == np.repeat(top, sizes, axis=0).ravel())
                    pos, fil = at // FILTERS, at % FILTERS
                    doc = np.searchsorted(first, pos, side="right") - 1
                    live = top[doc, fil] > 0
                    pos, fil, doc = pos[live], fil[live], doc[live]
                    _, one = np.unique(doc * FILTERS + fil, return_index=True)
                    pos, fil, doc = pos[one], fil[one], doc[one]
                    gv = gp[doc, k * FILTERS + fil]
                    np.add.at(gbias, fil, gv)
                    for j in range(len(f)):
                        for q in range(FILTERS):
                            sel = fil == q
                            gf[j, :, q] = gv[sel] @ x[pos[sel] + j]
                        gx.setdefault("pos", []).append(pos + j)
                        gx.setdefault("val", []).append(gv[:, None] * f[j, :, fil])
                    grads.append(gf)
                    gb.append(gbias)
                step += 1
                for prm, gr, (m, v) in zip(dense, [*grads, *gb, grad_out], moments):
                    m += 0.1 * (gr - m)
                    v += 0.01 * (gr * gr - v)
                    prm -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                self.shift -= np.float32(0.2 * g.sum())
                pos, val = np.concatenate(gx["pos"]), np.concatenate(gx["val"])
                for w in words:
                    rows = w[pos]
                    ok = rows != PAD
                    np.add.at(self.table, rows[ok], -2.0 * val[ok])

    def calibrate(self, z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
        """A threshold for each language: the logit that errs least on both classes, drawn towards the one of all."""

        def least(z: np.ndarray, y: np.ndarray) -> float:
            s = np.sort(z)
            cuts = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
            bad = np.array([((z >= c) & (y == 0)).mean() + ((z < c) & (y == 1)).mean() for c in cuts])
            best = cuts[bad <= bad.min() + 1e-12]
            return float((best[0] + best[-1]) / 2)

        if len(np.unique(y)) < 2:
            return
        self.threshold[:] = least(z, y)
        for k in range(len(LANGUAGES)):
            own = lang == k
            n1, n0 = (y[own] == 1).sum(), (y[own] == 0).sum()
            if min(n1, n0) >= 5:
                trust = min(n1, n0) / (min(n1, n0) + 10)
                self.threshold[k] = trust * least(z[own], y[own]) + (1 - trust) * self.threshold[-1]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        words, first, lang = features(data, offs)
        z = self.logits(words, first) - self.threshold[lang]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: pa.Array, y: np.ndarray) -> Network:
    net = Network()
    if len(np.unique(y)) < 2:
        net.constant = float(y[0]) if len(y) else 0.0
        return net
    data, offs = text_buffer(texts)
    items = []
    for i in range(len(y)):
        items.append(features(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]])))
    aside = np.arange(len(y)) % 4 == 3 if len(y) >= 400 else np.zeros(len(y), bool)
    own = np.flatnonzero(~aside)
    net.start_from_log_odds([items[i] for i in own], y[own])
    net.train([items[i] for i in own], y[own], epochs=int(np.clip(24000 // max(len(own), 1), 3, 30)))
    judged = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    z = np.array([net.logits(items[i][0], items[i][1])[0] for i in judged])
    net.calibrate(z, y[judged], np.array([items[i][2][0] for i in judged]))
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; with ``keep``, all columns of docs, score and predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, y = labelled_sample(docs, labels, "toxic", fold(id_col, 5) != 0, per_class, id_col, text_col)
    net = train(texts, y)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            data, offs = text_buffer(b.column("__text"))
            s = np.concatenate([net.scores(d, o) for _, _, d, o in slices(data, offs)])
            rest = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(s)], names=[*rest, "__score"])

    base = docs.select(F.struct("*").alias("__row") if keep else F.col(f"`{id_col}`").alias("__id"), (fold(id_col, 5) == 0).alias("__held"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*(f for f in base.schema.fields if f.name != "__text"), T.StructField("__score", T.DoubleType())])
    scored = base.mapInArrow(score, schema)
    predicted = (F.col("__score") >= 0.5).cast("int")
    if keep:
        return scored.select("__row", "__score", predicted.alias("__predicted"))
    return scored.select(F.col("__id").alias(id_col), F.col("__held").alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"))

