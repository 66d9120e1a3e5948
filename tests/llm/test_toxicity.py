"""Toxicity: held-out accuracy, labels that are never learned, and the risk itself."""

import random
import zlib

import numpy as np
import pytest

from sievegrid.llm import toxicity as T

BAD = ["vilex", "grommit", "snarf", "blergh", "zoxx", "quib"]


def corpus(prose, n=900):
    rows, toxic = [], {}
    for i in range(n):
        r = random.Random(i)
        text = prose(r.randint(20, 80), 5000 + i)
        toxic[i] = int(r.random() < 0.2)
        if toxic[i]:
            words = text.split()
            for _ in range(4):
                words.insert(r.randint(0, len(words)), r.choice(BAD))
            text = " ".join(words)
        rows.append((i, text, "en", "a"))
    return rows, toxic


@pytest.fixture
def learned(spark, make_docs, prose):
    rows, toxic = corpus(prose)
    known = [(i, toxic[i], "x") for i in toxic if i % 3]
    docs = make_docs(rows)
    return docs, known, toxic, lambda labels: T.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))


def test_held_out_accuracy(learned):
    docs, known, toxic, fit = learned
    got = {r.doc_id: r.score for r in fit(known).score(docs).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == bool(toxic[i]) for i in held])
    assert right > 0.95


def test_held_out_labels_are_never_learned(learned):
    docs, known, _, fit = learned
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, "x") for i, y, _ in known]
    a = {r.doc_id: r.score for r in fit(known).score(docs).collect()}
    b = {r.doc_id: r.score for r in fit(turned).score(docs).collect()}
    assert a == b


def test_risk_is_kept_from_negative():
    """All features tell positives from unlabelled rows apart; half of those are positive all the same."""
    rng = np.random.default_rng(0)
    positive = np.arange(400) < 100
    truth = positive | (rng.random(400) < 0.3)
    feature = np.where(truth, rng.random(400) < 0.9, rng.random(400) < 0.05)
    rows = np.flatnonzero(feature)
    weights, bias = T.train(rows, np.zeros(len(rows), np.int64), positive, 1, 0.3)
    assert bias < 0 < bias + weights[0]


def test_awkward_rows(spark, make_docs, awkward, prose):
    rows, toxic = corpus(prose, 300)
    docs = make_docs(awkward + [(i + 100, t, x, s) for i, t, x, s in rows])
    labels = spark.createDataFrame([(i + 100, y) for i, y in toxic.items()] + [(None, 1), (101, None), (101, 0), (5, 1)], "doc_id long, toxic int")
    got = T.learn(docs, labels).score(docs).collect()
    assert len(got) == len(awkward) + 300
    assert all(0 <= r.score <= 1 for r in got)
    none = T.learn(docs, labels.limit(0)).score(docs)
    assert none.filter("score >= 0.5").count() == 0 and none.count() == len(got)
    assert T.learn(docs.limit(0), labels).score(docs.limit(0)).count() == 0


def test_long_words_and_pairs():
    assert len(T.word_features("a" * 500)) == 1
    assert len(T.word_features("中国人民")) == 3
