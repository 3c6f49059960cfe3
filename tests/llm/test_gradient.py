"""The language model's gradient against the sum of its probabilities."""

from __future__ import annotations

import numpy as np
from docs import table

from barsift.llm import maxent


def test_gradient_is_exact_for_copied_texts(spark):
    text = b"the house and the water under the old house"
    rows = [(i, text.decode(), "en", "s", 0) for i in range(200)]
    docs = table(spark, rows).selectExpr("doc_id", "cast(text as binary) as text")
    rng = np.random.default_rng(4)
    weights = [rng.normal(0, 0.5, s).astype(np.float32) for s in maxent.SHAPES]
    words = maxent.Words()
    ids = np.array(words.numbers(text))
    words.settle()
    cell, classes, slots = maxent._rows(ids, ids, np.zeros(len(ids), int), words)
    want = [np.zeros(s) for s in maxent.SHAPES]
    for i, c in enumerate(cell):
        k, s = divmod(int(c), maxent.SLOTS)
        for table_, bias, of, own in ((1, weights[0], classes, k), (3, weights[2][k], slots, s)):
            z = np.exp(bias + sum(weights[table_][r[i]] for r in of))
            p = -z / z.sum()
            p[own] += 1
            for r in of:
                want[table_][r[i]] += 200 * p
    got = maxent._shaped(maxent._summed(docs, weights))
    assert np.allclose(got[1], want[1], atol=0.05) and np.allclose(got[3], want[3], atol=0.05)


def test_rows_are_added_and_powers_hold_beyond_floats():
    import numpy as np

    from barsift.llm import maxent

    total, values = np.zeros((4, maxent.CLASSES), np.float32), np.random.default_rng(1).random((3, maxent.CLASSES)).astype(np.float32)
    maxent._Adder().add(total, [np.array([2, 0, 2], np.int32)], values)
    assert np.allclose(total[2], values[0] + values[2]) and np.allclose(total[0], values[1]) and not total[1].any()
    z = np.array([[200, 199], [-200, -200], [1, 2]], np.float32)
    sums, top = maxent._exp(z.copy())
    assert np.allclose(top + np.log(sums), np.logaddexp(z[:, 0], z[:, 1]))
