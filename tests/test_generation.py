"""Embedding and generation over small models of known behaviour; grammars; the stop rule."""

import json
import math

import numpy as np
import pytest

from vecquill.operators import embedding, generation, grammar


Cycle = generation.LetterProvider
GREEDY = generation.PredictOptions(temp=0, repeat_penalty=1.0, dry_multiplier=0.0, max_tokens=12)


def test_predict(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "kl"), (3, None), (4, "")], "conv_id long, prompt string").repartition(3)
    got = {r.conv_id: (r.answer, r.n_pieces) for r in generation.predict(prompts, Cycle(), GREEDY).collect()}
    assert got == {1: ("bcdefghij", 9), 2: ("mnopqrstuvw", 11), 3: (None, None), 4: ("abcdefghij", 10)}  # a control piece ends 1 and 4, the cap 2
    rows = generation.predict(prompts, Cycle(), GREEDY, pieces=True).where("conv_id = 1").orderBy("n").collect()
    assert "".join(r.piece for r in rows) == "bcdefghij" and [r.n for r in rows] == list(range(9))
    one = {r.conv_id: r.answer for r in generation.predict(prompts, Cycle(), generation.PredictOptions(seed=5, max_tokens=30)).collect()}
    again = {r.conv_id: r.answer for r in generation.predict(prompts.repartition(1), Cycle(), generation.PredictOptions(seed=5, max_tokens=30)).collect()}
    assert one == again and len(one[2]) > 3


def test_context_shift():
    class Far(Cycle):
        n_ctx, control, end = 12, frozenset(), frozenset()

        def __init__(self):
            self.seen = []

        def logits(self, ids):
            self.seen.append(len(ids))
            x = np.full(29, -20.0)
            x[(ids[-1] + 1) % 26] = 1
            return x

    model = Far()
    text = "".join(generation.generate(model, "abc", generation.PredictOptions(temp=0, repeat_penalty=1.0, dry_multiplier=0.0, max_tokens=30)))
    assert text == "".join(chr(97 + (3 + i) % 26) for i in range(29)) and max(model.seen) == 10 and model.seen.count(7) > 2
    assert list(generation.generate(model, "abcdefghijkl", generation.PredictOptions(temp=0))) == []


def test_candidates():
    rng = np.random.default_rng(0)
    p = np.array([0.4, 0.3, 0.2, 0.06, 0.04])
    x = np.log(p)
    plain = generation.PredictOptions(temp=1, top_p=1, top_k=0, min_p=0, repeat_penalty=1.0, dry_multiplier=0)
    pick = lambda **o: generation.candidates(x, [], generation.PredictOptions(**{**plain.__dict__, **o}), set(), rng)
    tokens, q = pick()
    assert tokens.tolist() == [0, 1, 2, 3, 4] and np.allclose(q, p)
    assert pick(top_k=2)[0].tolist() == [0, 1] and pick(top_p=0.65)[0].tolist() == [0, 1] and pick(min_p=0.3)[0].tolist() == [0, 1, 2]
    assert pick(temp=0)[0].tolist() == [0] and np.allclose(pick(temp=0.5)[1], p**2 / (p**2).sum())
    assert pick(xtc_probability=1.0, xtc_threshold=0.25)[0].tolist() == [1, 2, 3, 4]
    assert pick(mask=lambda h: np.array([False, True, False, True, False]))[0].tolist() == [1, 3]
    low = generation.candidates(np.array([2.0, 1.0, -1.0]), [0, 2], generation.PredictOptions(**{**plain.__dict__, "repeat_penalty": 2.0}), set(), rng)
    assert np.allclose(low[1], np.exp([1.0, 1.0, -2.0]) / np.exp([1.0, 1.0, -2.0]).sum())


def test_generation_under_a_grammar():
    rules = grammar.Grammar('root ::= [b-d]+ "k" "."?')
    model = Cycle()
    mask = grammar.token_mask(rules, model.pieces, 1, {26})
    text = "".join(generation.generate(model, "a", generation.PredictOptions(temp=0, repeat_penalty=1.0, dry_multiplier=0.0, max_tokens=9, mask=mask)))
    assert text.startswith("bcd") and rules.follow(text)


@pytest.mark.parametrize("text, good, bad", [
    ('root ::= "a" ("b" | "c")* "d"? # end', ["a", "abcbd", "ad"], ["", "b", "add"]),
    ("root ::= num (op num)*\nop ::= [+*-]\nnum ::= [1-9] [0-9]{0,2} | \"(\" root \")\"", ["1", "12*(3+4)", "100-(1)"], ["0", "1000", "1+", "(1"]),
    ('root ::= [^"\\\\]{2,3} "\\n" "\\x41"', ["ab\nA", "é漢x\nA"], ['a"\nA', "abcd\nA", "ab\nB"]),
    ("root ::= a\na ::= \"x\" a \"y\" | \"\"", ["", "xy", "xxyy"], ["x", "xxy", "yx"]),
])
def test_grammars(text, good, bad):
    rules = grammar.Grammar(text)
    assert all(map(rules.accepts, good)) and not any(map(rules.accepts, bad))


def test_grammar_errors():
    for wrong in ("", "root ::= a", "a ::= \"x\"", 'root ::= root "x"', 'root ::= ("x"', 'root ::= "x', "root := x", 'root ::= "\\q"', 'root ::= "a"\nroot ::= "b"', 'root ::= e root\ne ::= ""'):
        with pytest.raises(ValueError):
            grammar.Grammar(wrong)
    with pytest.raises(ValueError):
        grammar.schema_grammar({"type": "date"})


def test_schemas():
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string", "maxLength": 3}, "tags": {"type": "array", "items": {"enum": ["x", 1, None]}, "minItems": 1, "maxItems": 2}, "more": {"$ref": "#/$defs/node"}}, "required": ["id", "tags"], "$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}}}}}
    rules = grammar.Grammar(grammar.schema_grammar(schema))
    good = [{"id": 1, "tags": ["x"]}, {"id": -20, "tags": [1, None], "name": "abc"}, {"id": 0, "tags": ["x"], "more": {"next": {"next": {}}}}, {"id": 0, "tags": ["x"], "name": "", "more": {}}]
    bad = [{}, {"id": 1}, {"id": 1, "tags": []}, {"id": 1, "tags": ["x", "x", "x"]}, {"id": "1", "tags": ["x"]}, {"id": 1, "tags": ["y"]}, {"id": 1, "tags": ["x"], "name": "abcd"}, {"id": 1, "tags": ["x"], "other": 1}]
    for compact in ((",", ":"), None):
        assert all(rules.accepts(json.dumps(g, separators=compact)) for g in good)
        assert not any(rules.accepts(json.dumps(b, separators=compact)) for b in bad)
    anything = grammar.Grammar(grammar.schema_grammar({}))
    assert anything.accepts('{"a": [1, 2.5e3, {"b": null}], "c": "\\u00e9"}') and not anything.accepts("{")
    either = grammar.Grammar(grammar.schema_grammar({"anyOf": [{"type": ["boolean", "null"]}, {"const": "yes"}, {"prefixItems": [{"type": "integer"}, {"type": "string"}], "type": "array"}]}))
    assert all(map(either.accepts, ["true", "null", '"yes"', '[1, "a"]'])) and not either.accepts('"no"') and not either.accepts("[1]")


def test_embedding(spark):
    texts = [(1, "one two three"), (2, ""), (3, None), (4, "   "), (5, " ".join(f"w{i}" for i in range(23)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, vecs string").repartition(2)
    model = embedding.WordProvider(3)
    for pooling in embedding.POOLINGS:
        options = embedding.EmbedOptions(n_ctx=16, n_ubatch=8, pooling=pooling)
        got = {r.doc_id: r for r in embedding.embed(docs, model, options).collect()}
        assert all(got[i].vecs == [] and got[i].avg_vec is None for i in (2, 3, 4))
        assert len(got[1].vecs) == 1 and got[1].avg_vec == got[1].vecs[0]
        assert len(got[5].vecs) == 4  # starts 0, 7, 14, 21
        for r in (got[1], got[5]):
            assert all(math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5) for v in [*r.vecs, r.avg_vec])
        mean = np.mean(got[5].vecs, axis=0)
        assert np.allclose(got[5].avg_vec, mean / np.linalg.norm(mean), atol=1e-5)
    half = embedding.embed(docs, model, half=True).where("doc_id = 1").first()
    assert half.avg_vec == [float(np.float16(x)) for x in half.avg_vec]
    assert embedding.windows(16, embedding.EmbedOptions(n_ctx=16)) == [(0, 16), (14, 16)]
    for wrong in ({"pooling": "max"}, {"n_ctx": 0}, {"embeddings": False}):
        with pytest.raises(ValueError):
            embedding.EmbedOptions(**wrong)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "aa bb cc\nddddd eeeee\nzz"), (2, None), (3, "yyyyyyyy")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "aa bb cc")], "id long, text string")
    got = embedding.retrieve(docs, asked, embedding.WordProvider(4), 2, size=4).orderBy("rank").collect()
    assert (got[0].query_id, got[0].id, got[0].chunk, got[0].text) == (7, 1, 0, "aa bb cc\n") and got[0].distance > 0.9 and len(got) == 2
