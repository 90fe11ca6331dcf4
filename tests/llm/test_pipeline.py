"""Each stage of the pipeline, on its own input, against a brute-force version on a small fixture."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vecquill.llm import toxicity

WORDS = [f"w{i}" for i in range(900)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    item, passage, near = prose(30), prose(60), prose(120).split()
    texts = {i: prose(int(rng.integers(30, 90))) for i in range(80)}
    texts |= {100 + i: " ".join([*prose(20).split(), "vile", "filth", *prose(20).split(), "scum"]) for i in range(80)}
    texts |= {200 + i: f"{prose(25)} {passage}\n{prose(10)}" for i in range(4)}
    texts |= {300 + i: " ".join([*near[: 40 * i], f"e{i}", *near[40 * i + 1 :]]) for i in range(3)}
    texts |= {400: f"{prose(20)} {item} {prose(20)}", 500: None, 501: "", 502: prose(3000), 503: texts[7]}
    where = str(tmp_path_factory.mktemp("tables"))
    row = lambda i, t: (i, t, "en", "s", len(t) if t is not None else None)
    spark.createDataFrame([row(*x) for x in texts.items()], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(180) if i < 80 or i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words(t.lower() if t else t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def without_near_copies(docs):
    sets, group = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    moved = True
    while moved:
        moved = False
        for a in docs:
            for b in docs:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[b] < group[a]:
                    group[a], moved = group[b], True
    return {i: t for i, t in docs.items() if group[i] == i}


def kept_words(docs, n=13):
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "substring_dedup", "decontamination", "packing"]
    run = dict(corpus_pipeline.STAGES)

    clean = run["toxicity"](spark, docs, folder)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert clean.columns == docs.columns
    assert set(rows(clean)) == {r.doc_id for r in scored if r.predicted == 0}
    assert sum(i in rows(clean) for i in range(100, 180)) <= 8 and sum(i in rows(clean) for i in range(80)) >= 76

    before = rows(docs)
    apart = run["minhash"](spark, docs, folder)
    assert apart.columns == docs.columns and rows(apart) == without_near_copies(before)
    assert {300, 7} <= set(rows(apart)) and not {301, 302, 503} & set(rows(apart))

    cut = run["substring_dedup"](spark, docs, folder)
    assert cut.columns == docs.columns and {i: words(t) for i, t in rows(cut).items()} == kept_words(before)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut.collect())

    fair = run["decontamination"](spark, docs, folder)
    assert fair.columns == docs.columns and rows(fair) == {i: t for i, t in before.items() if i != 400}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = run["packing"](spark, docs, folder).toPandas()
    lengths = packed.groupby("doc_id")["length"].sum().to_dict()
    assert lengths == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in before.items()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run_is_the_stages_in_turn(spark, folder):
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert {7, 200, 300, 502} <= got and not {301, 302, 400, 503} & got
