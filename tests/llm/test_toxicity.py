"""Toxicity: held-out accuracy, the corrected risk, and awkward rows."""

from __future__ import annotations

import random

import numpy as np
from docs import awkward, prose
from docs import table as documents

from barsift.llm import toxicity
from barsift.llm.queries import QUERIES

BAD = "vermin stooge cretin".split()


def corpus(n=600):
    rng = random.Random(3)
    rows, toxic = [], {}
    for i in range(n):
        words = prose(("en", "de", "fr")[i % 3], 15 + rng.randrange(60), i).split()
        if i % 5 == 0:
            toxic[i] = 1
            for _ in range(1 + rng.randrange(3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        else:
            toxic[i] = 0
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    return rows, toxic


def labels(spark, toxic):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic], "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart_without_clean_labels(spark):
    rows, toxic = corpus()
    held = {i for i in toxic if i % 4 == 1}
    docs = documents(spark, rows, extra=True)
    # Half of the toxic ones are known; the rest of them lie among the unlabelled.
    known = [(i, t) for i, t in toxic.items() if i not in held and (t == 0 or i % 10 == 0)]
    model = toxicity.fit(docs.filter("doc_id % 4 <> 1"), labels(spark, known), prior=0.2)
    out = toxicity.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    right = np.mean([got[i].predicted == toxic[i] for i in held])
    assert right > 0.97
    assert min(got[i].score for i in held if toxic[i]) > max(np.quantile([got[i].score for i in held if not toxic[i]], 0.95), 0.3)


def test_unlabelled_positives_do_not_hold_the_classifier_down():
    """All texts with feature 0 are toxic, and as many unlabelled ones as the prior says; the rest have feature 1."""
    rng = np.random.default_rng(1)
    positive = toxicity._Rows([np.array([0, 2 + i], np.int32) for i in range(40)])
    unlabelled = toxicity._Rows([np.array([0] if i < 800 else [1], np.int32) for i in rng.permutation(4000)])
    w, bias = toxicity.train(positive, unlabelled, np.ones(42), 0.2, 0)
    # Were unlabelled texts taken for clean ones, half of those with the feature would be, and the margin 0.
    assert w[0] + bias > 0.5 > 0 > w[1] + bias and w[0] > w[2:].max()


def test_awkward_rows(spark):
    rows, toxic = corpus(100)
    docs = documents(spark, rows + awkward(), extra=True)
    known = [*toxic.items(), (100, 1), (None, 1), (105, None), (0, 0), (0, 1)]
    model = toxicity.fit(docs, labels(spark, known))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(awkward())
    base = 1 / (1 + np.exp(-model.bias))
    assert all(abs(r.score - base) < 1e-12 and not r.predicted for r in got if r.doc_id in (100, 101, 102))
    assert len({r.score for r in got if r.doc_id == 105}) == 1
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_without_positives_every_text_scores_the_prior(spark):
    rows, _ = corpus(50)
    docs = documents(spark, rows)
    for known, prior in (([], 0.5), ([(1, 0), (2, 0), (3, 0)], 0.125)):
        model = toxicity.fit(docs, labels(spark, known))
        assert np.allclose([r.score for r in toxicity.score(docs, model).collect()], prior)
    assert len(toxicity.fit(documents(spark, []), labels(spark, [(1, 1)])).vocabulary) == 0


def test_query_on_the_given_tables(spark):
    out = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.score) for r in out.collect() if r.doc_id in truth and r.held_out]
    high, low = [s for t, s in got if t == 1], [s for t, s in got if t == 0]
    # Six toxic texts only are held out there; two are in languages with almost no labelled one.
    assert np.mean([a > b for a in high for b in low]) > 0.6
