import random

import numpy as np
import pytest

from refloom.llm.language_id import fit, grams, identify, query, train

SAMPLE = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("the dog and the cat", "en"), ("die katze ist da", "de"), ("кошка и собака", "ru"), ("собака дома", "ru"), ("猫が好きです", "ja"), ("犬も好き", "ja")]


def present(text):
    """The n-grams of a text as a Python set."""
    s = "\1" + "".join(c if c.isalpha() else "\1" for c in text.lower()) + "\1"
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def kernel(a, b):
    return len(present(a) & present(b)) / (len(present(a)) * len(present(b))) ** 0.5


def test_grams_are_the_sets():
    for text in ("", "a", "the cat!", "aaaa", "Ünï-çödé x", "中文 字"):
        assert len(grams(text)) == len(present(text)), text
        assert (np.diff(grams(text)[-len({x for x in present(text) if len(x) == 3}) or len(grams(text)) :]) > 0).all()


def test_scores_equal_a_kernel_computed_from_sets():
    r = random.Random(4)
    words = {"en": "the cat dog and sat on mat with".split(), "de": "der hund die katze und mit auf".split(), "ru": "кошка и собака дома на".split()}
    rows = [(" ".join(r.choices(words[lang], k=r.randint(2, 12))), lang) for lang in words for _ in range(9)]
    r.shuffle(rows)
    model = fit(rows, landmarks=12, ridge=1e-2)
    chosen, languages = [], sorted(words)
    for depth in range(4):
        chosen += [[t for t, x in rows if x == lang][depth] for lang in languages]
    k = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    phi = np.array([[kernel(t, b) for b in chosen] for t, _ in rows]) @ root
    y = np.array([[1.0 if lang == x else -1.0 for lang in languages] for _, x in rows])
    w = np.full(len(rows), 1 / 9)
    beta = np.linalg.solve(phi.T @ (phi * w[:, None]) + 1e-2 * np.eye(len(chosen)), phi.T @ (y * w[:, None]))
    texts = ["the dog", "katze und hund", "дома собака", "xyz", "中文", "the кошка"]
    want = np.array([[kernel(t, b) for b in chosen] for t in texts]) @ root @ beta
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = query(spark, sf_dir).alias("g").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 200
    assert sum(x.lang == x.lang_pred for x in got) / len(got) >= 0.97
    assert all(0 <= x.score <= 1 for x in got)


def test_edge_cases(spark):
    model = fit(SAMPLE)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the mat"), (None, "die hunde"), (4, "the mat"), (5, "猫も好き"), (6, "the " * 500_000), (7, "дом")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'fr' as lang_pred", "9 as score")
    got = identify(docs, model).collect()
    assert [x.lang_pred for x in got if x.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(x.lang_pred == "en" for x in got if x.doc_id in (4, 6)) and [x.lang_pred for x in got if x.doc_id is None] == ["de"]
    assert [x.lang_pred for x in got if x.doc_id in (5, 7)] == ["ja", "ru"]
    empty = docs.limit(0).selectExpr("doc_id", "text", "'x' as lang")
    nothing = train(empty)
    assert nothing.languages == [] and {x.lang_pred for x in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).collect() == []
    with pytest.raises(ValueError, match="lang_pred"):
        identify(docs, model, ("lang_pred",))


def test_copies_count_once_in_the_sample(spark):
    rows = [(f"the cat number {i} sat on the mat", "en") for i in range(2000)] + [("der hund und die katze", "de")] * 6000
    labelled = spark.createDataFrame(rows, "text string, lang string")
    model = train(labelled, rows=100)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "der hund"), (2, "the cat")], "doc_id long, text string")
    assert [x.lang_pred for x in identify(docs, model).orderBy("doc_id").collect()] == ["de", "en"]
