"""Toxicity, quality and language models."""

import random

import numpy as np
import pytest

from riskmart.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


ODD = [(1, None, "p"), (1, None, "p"), (2, "", "q"), (None, "plain words here", "r"), (3, "x" * 200_000, "s"), (4, "a " * 100_000, None)]


def odd_rows(spark, extra):
    return spark.createDataFrame(ODD, f"doc_id long, text string, `{extra}` string")


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    n, p = 400, 6
    dense = rng.random((n, p)) < 0.4
    weight = np.array([2.0, 1.0, 0.0, 0.0, -1.0, 3.0])
    grades = np.digitize(dense @ weight + rng.logistic(size=n), [1.0, 3.0])
    rows, columns = np.nonzero(dense)
    w, cuts = toxicity.fit_cumulative_link(rows, columns, grades, np.ones(n), p, penalty=1e-4)
    assert cuts[0] < cuts[1] and w[5] > w[1] > w[4] and abs(w[2]) < 1
    flat, top = toxicity.fit_cumulative_link(rows, columns, np.zeros(n, int), np.ones(n), p)
    assert not flat.any() and len(top) == 1


def test_toxicity_finds_marked_words(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, 6) if bad else 0):
            text[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo", "vileish"])
        docs.append((i, " ".join(text)))
        if i < 400:
            labels.append((i, int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels + [(None, 1), (0, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all((got[i]["p_toxic"] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert all(0 <= r["severity"] <= 2 and (r["grade"] == 0) == (r["p_toxic"] < 0.5) for r in got.values())
    assert np.mean([got[i]["severity"] for i in range(0, 600, 5)]) > 1


def test_toxicity_edge_cases(spark, tables):
    model = toxicity.fit(*tables)
    got = toxicity.score_toxicity(odd_rows(spark, "grade"), model)
    assert got.columns == ["doc_id", "text", "p_toxic", "grade", "severity"]
    assert [r["grade"] for r in got.collect()] == [0] * len(ODD)
    none = toxicity.fit(tables[0], tables[1].where("false"))
    assert toxicity.score_toxicity(tables[0], none).where("p_toxic > 0.5").count() == 0
    assert toxicity.score_toxicity(tables[0].where("false"), model).count() == 0


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    trees = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    scored = quality.score_quality(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in scored]) > 0.93
    odd = quality.score_quality(odd_rows(spark, "score"), trees).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd) and odd[0] == odd[1]
    none = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_flat_trees_walk_like_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.grow(x, y, np.ones(500))
    total = np.full(500, trees.base)
    for features, cuts, values in zip(trees.features, trees.cuts, trees.values):
        for i, row in enumerate(x):
            node = 0
            while node < len(features):
                node = 2 * node + 1 + int(row[features[node]] > cuts[node])
            total[i] += values[node - len(features)]
    assert np.allclose(1 / (1 + np.exp(-total)), trees.probability(x))
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_language_on_held_out_texts(spark, tables):
    docs = tables[0]
    model = language.fit(docs.where("doc_id % 4 <> 0"))
    got = language.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    rows = [(1, None), (1, None), (2, ""), (3, "123 ... !"), (4, "x" * 100_000)]
    odd = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in odd[:4]] == ["und"] * 4 and [r["score"] for r in odd[:4]] == [0.0] * 4
    assert odd[4]["lang_pred"] in model[0] and 0 < odd[4]["score"] <= 1
    none = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_ngrams_stay_inside_texts(spark):
    alphabet = language.Alphabet()
    whole = {n: set(b.tolist()) for n, (_, b) in enumerate(language.grams(*alphabet.texts(["ab"])), 1)}
    apart = {n: len(b) for n, (_, b) in enumerate(language.grams(*alphabet.texts(["ab", "c", "", "Ab"])), 1)}
    assert apart == {1: 5, 2: 2, 3: 0}
    again = {n: set(b.tolist()) for n, (_, b) in enumerate(language.grams(*alphabet.texts(["AB"])), 1)}
    assert whole == again
