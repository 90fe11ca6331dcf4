"""Encoders, merges, repetition and range operators against literal facts and brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquill.functions import vectors as V
from vecquill.operators import pieces, sampling, search

MERGES = {"er": 3.0, "in": 2.5, "th": 2.0, "the": 1.5, "ing": 1.0, "ther": 0.5}


def test_pair_merger_facts():
    encode = pieces.pair_merger(MERGES)
    for given, want in (("", []), ("the", ["the"]), ("THE", ["T", "H", "E"]), ("other", ["o", "ther"]), ("theer", ["the", "er"]), ("thing", ["th", "ing"]), ("inine", ["in", "in", "e"])):
        assert encode(given) == want


def test_pair_merger_is_the_plain_rule():
    def plain(text):
        parts = list(text)
        while True:
            found = [(-MERGES[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in MERGES]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(1)
    for _ in range(300):
        t = "".join(draw.choices("thering", k=draw.randint(0, 14)))
        assert pieces.pair_merger(MERGES)(t) == plain(t)


def test_best_path_is_the_best_of_all():
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -2.9, "aba": -2.4, "c": -3.0}
    encode = pieces.best_path(scores)
    draw = random.Random(2)
    for _ in range(100):
        t = "".join(draw.choices("abc", k=draw.randint(1, 9)))
        ways = ([t[i:j] for i, j in zip((0, *cut), (*cut, len(t)))] for n in range(len(t)) for cut in itertools.combinations(range(1, len(t)), n))
        best = max(sum(scores[p] for p in w) for w in ways if all(p in scores for p in w))
        assert math.isclose(sum(scores[p] for p in encode(t)), best)
    assert encode("axyb") == ["a", "xy", "b"] and encode("") == []


def test_word_parts_and_chunks(spark):
    encode = pieces.word_parts({"▁he", "llo", "▁", "wor", "ld", "▁!"})
    assert encode("Héllo,  world!") == ["▁he", "llo", "[UNK]", "▁", "wor", "ld", "▁!"]
    assert encode(" \n") == [] and encode("x") == ["[UNK]"]
    cut = pieces.chunks("\n", 4)
    assert cut("ab\ncd\nef\ngh") == ["ab\ncd\nef\ngh"] and cut("ab\ncd\nefgh\ni") == ["ab\ncd\n", "efgh\ni"] and cut("ab") == ["ab"] and cut("") == []
    with pytest.raises(ValueError):
        pieces.chunks("", 1)
    rows = spark.createDataFrame([(1, "thin"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.p for r in rows.select("doc_id", pieces.over_batches(pieces.pair_merger(MERGES))("text").alias("p")).collect()}
    assert got == {1: ["th", "in"], 2: None, 3: []}


def test_train_merges_is_the_plain_rule(spark):
    texts = ["low lower lowest", "new newer  newest", "", "wide low", None]
    words = Counter(w for t in texts for w in (t or "").split() if len(w) > 1)
    state, want = {w: list(w) for w in words}, {}
    for rank in range(6):
        pairs = Counter()
        for w, n in words.items():
            for pair in zip(state[w], state[w][1:]):
                pairs[pair] += n
        a, b = min(pairs, key=lambda p: (-pairs[p], len(p[0] + p[1]), p[0] + p[1], p[0]))
        want[a + b] = -float(rank)
        for w, parts in state.items():
            i = 0
            while i + 1 < len(parts):
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert pieces.train_merges(rows, 6) == want
    assert pieces.train_merges(rows.where("false"), 6) == {}


def test_dry_facts(spark):
    """What follows earlier occurrences of the history's end loses multiplier * base ** (length - allowed)."""

    def after(n, history, multiplier, allowed, breakers=None):
        d = spark.createDataFrame([(0, i, 0.0) for i in range(n)], "step long, token long, logit double")
        h = spark.createDataFrame([(0, history)], "step long, history array<int>")
        return {r.token: round(-r.logit, 6) for r in sampling.dry(d, h, multiplier, 1.5, allowed, 64, breakers).collect() if r.logit}

    assert after(4, [3, 1], 1.0, 2) == {}
    assert after(6, [4, 5, 2, 0, 4, 5, 2], 0.7, 2) == {0: round(0.7 * 1.5, 6)}
    assert after(6, [4, 5, 2, 0, 4, 5, 2], 0.7, 4) == {}
    assert after(6, [4, 5, 1, 3, 4, 5], 1.0, 1, [[4]]) == {1: 1.0}
    assert after(6, [4, 5, 1, 3, 4, 5], 1.0, 2, [[4]]) == {}
    assert after(6, [2, 2, 2, 2], 1.0, 2) == {2: 1.5}


def test_capped_ranges_and_scores(spark):
    pairs = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 2, 2, 3, 5])], "query_id long, id long, distance double")
    ids = lambda most, larger=False: sorted(r.id for r in search.capped_range(pairs, most, larger).collect())
    assert ids(2) == [0] and ids(3) == [0, 1, 2] and ids(9) == [0, 1, 2, 3, 4] and ids(1, True) == [4]
    assert tuple(search.range_scores(pairs, pairs.where("id < 2")).first()) == (1.0, 0.4)
    none = pairs.where("false")
    assert tuple(search.range_scores(none, none).first()) == (1.0, 1.0) and tuple(search.range_scores(none, pairs).first()) == (0.0, 0.0)


def test_packing_of_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, None)], "id long, v array<float>")
    got = rows.select("id", V.unpacker(True)(V.packer(True)("v")).alias("v")).orderBy("id").collect()
    assert got[0].v == [1.0, -2.5] and got[1].v is None
    with pytest.raises(Exception, match="components"):
        rows.select(V.unpacker()(F.lit(b"abc")).alias("v")).collect()
    assert np.allclose(rows.where("id = 1").select(V.scaled(V.doubles("v"), 3).alias("x")).first().x, np.array([1, -2.5]) / (1 + 2.5**3) ** (1 / 3))
