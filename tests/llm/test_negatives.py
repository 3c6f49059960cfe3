"""Hard negatives against all pairs, and the bounds of a bucket."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barsift.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, norm string, v string"


def everything(rows, step=10):
    """All pairs, by the definition."""
    held, seen = [], set()
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x) or i in seen:
            continue
        seen.add(i)
        held.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = set()
    for i, x, label in held:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for j, y, other in held if j != i and len(x) == len(y)]
        for p, pos, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)
            out |= {(i, pos, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fits[:5])}
    return out


def vectors(n, seed, dim=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        x = (centres[k] + spread * rng.normal(size=dim)) * (1.0 + (i % 7 == 0) * rng.random())
        rows.append((i, [float(np.float32(c)) for c in x], int(rng.integers(3)) if i % 3 else k % 3))
    for i in range(n, n + 60):  # copies of one vector, which tie
        rows.append((i, rows[10][1], i % 3))
    rows += [(n + 60, [0.0] * dim, 1), (n + 70, [0.0] * dim, 2), (n + 80, None, 1), (n + 90, [1.0] * dim, None), (n + 100, [math.nan] * dim, 1),
             (n + 110, [None] * dim, 1), (n + 120, [], 1), (n + 121, [], 1), (n + 122, [], 2), (n + 130, [1.0, -0.5], 1), (n + 131, [1.0, 0.5], 1), (n + 132, [0.7, 0.5], 2),
             (n + 140, [math.inf] * dim, 2), (None, [1.0] * dim, 1), (n + 150, [-c for c in rows[20][1]], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("run_rows", "pilot"), [(32_768, 65_536), (7, 50)])
def test_results_are_those_of_all_pairs(spark, monkeypatch, run_rows, pilot):
    monkeypatch.setattr(negatives, "RUN_ROWS", run_rows)
    monkeypatch.setattr(negatives, "PILOT", pilot)
    rows = vectors(300, 5)
    got = negatives.mine(frame(spark, rows), lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == everything(rows) and len(got) > 300


def test_repeated_ids_and_empty_tables(spark):
    rows = vectors(60, 6)
    assert {tuple(r) for r in negatives.mine(frame(spark, rows + rows[:30]), lambda i: i % 10 == 0).collect()} == everything(rows)
    assert negatives.mine(frame(spark, []), lambda i: i % 10 == 0).collect() == []
    assert negatives.mine(frame(spark, rows), lambda i: i < 0).collect() == []


def test_bounds_lose_no_row_and_prune_some():
    rng = np.random.default_rng(8)
    for spread in (0.1, 1.0):
        x = np.floor(256 * (np.eye(16)[rng.integers(16, size=500)] + spread * rng.normal(size=(500, 16)) / 4))
        x[7] = 0
        norm = np.linalg.norm(x, axis=1)
        bucket = negatives.Bucket(np.arange(500), np.zeros(500, np.int64), x, norm)
        asked = negatives.Anchors(range(40), [0] * 40, norm[:40], [r.astype("<i2").tobytes() for r in x[:40]], 16)
        for share in (-0.5, 0.0, 0.3, 0.8, 1.0):
            least = share * asked.norm * norm.max()
            found = dict(bucket.candidates(asked.ways, asked.norm, least, asked.focus))
            for i in range(40):
                true = set(np.flatnonzero(x @ x[i] >= least[i]))
                rows = found.get(i, np.zeros(0, int))
                assert true <= set(range(500) if rows is None else rows.tolist())
        if spread == 0.1:
            assert sum(500 if found.get(i, ()) is None else len(found.get(i, ())) for i in range(40)) < 40 * 250


def test_large_components_are_scored_exactly():
    a = np.array([[2.0 ** 52, 3.0], [1.0, -1.0]])
    assert negatives.exact_scores(a, np.array([8.0, 1.0])).tolist() == [2 ** 55 + 3, 7]
    assert negatives.exact_scores(a, np.array([2.0 ** 40, 1.0])).tolist()[0] == 2 ** 63 - 1
