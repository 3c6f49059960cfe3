"""Forward labels against the definition, bar by bar, on random panels whose prices lie on a coarse lattice.

On a lattice the target, the floor and the entry are met exactly again and again, so every edge turns up by itself; the tests
assert that it did.
"""

from __future__ import annotations

import random

import pytest

from barsift.operators.outcomes import close_outcomes, forward_outcomes, realised_return

SCHEMA = "code string, date date, open double, high double, low double, close double, volume double"
STEP = 0.125


def lattice(spark, lengths: dict[str, int], seed: int):
    """Bars of each code, and the panel: a walk in whole steps of ``STEP``, dated by a Spark sequence of days."""
    rng, rows = random.Random(seed), {}
    for code, n in lengths.items():
        at, out = 64, []
        for i in range(n):
            at = max(24, at + rng.choice((-8, -4, -1, 0, 1, 4, 8)))
            open_ = max(16, at + rng.choice((-4, 0, 4)))
            out.append((open_ * STEP, (max(at, open_) + rng.choice((0, 2, 16))) * STEP, (min(at, open_) - rng.choice((0, 2, 8))) * STEP, at * STEP))
        rows[code] = out
    flat = [(code, i, *bar, float(100 + i % 7)) for code, bars in rows.items() for i, bar in enumerate(bars)]
    frame = spark.createDataFrame(flat, "code string, day int, open double, high double, low double, close double, volume double")
    return rows, frame.selectExpr("code", "date_add(date'2013-05-02', 2 * day) as date", "open", "high", "low", "close", "volume")


def by_code(df):
    out = {}
    for r in df.orderBy("code", "date").collect():
        out.setdefault(r.code, []).append(r)
    return out


@pytest.mark.parametrize(("horizon", "target", "floor"), [(9, 0.25, 0.75), (5, 0.5, 0.5), (80, 1.0, 0.875)])
def test_labels_follow_the_definition(spark, horizon, target, floor):
    rows, panel = lattice(spark, {"7A": 210, "7B": 160, "7C": horizon, "7D": 1}, horizon)
    got = by_code(forward_outcomes(panel, horizon, target_return=target, floor_ratio=floor))
    met = {"touched": 0, "hit": 0, "on_floor": 0, "under_after_hit": 0}
    for code, bars in rows.items():
        assert len(got[code]) == len(bars)
        for i, r in enumerate(got[code]):
            path = bars[i + 1:i + 1 + horizon]
            if path:
                entry = path[0][0]
                assert r.entry_open == entry
                assert abs(r.forward_max_return - (max(b[1] for b in path) / entry - 1)) < 1e-9
                assert abs(r.forward_min_return - (min(b[2] for b in path) / entry - 1)) < 1e-9
            if len(path) < horizon:
                assert not r.label_resolved and r.label_bull is None and r.label_strict_low is None and r.label_joint is None
                continue
            goal = entry * (1 + target)
            hit = next((j for j, b in enumerate(path) if b[1] > goal), None)
            until = path if hit is None else path[:hit + 1]
            low = min(b[2] for b in until)
            assert r.label_resolved and r.label_bull == (hit is not None) and r.label_strict_low == (low >= floor * entry)
            assert r.label_joint == (hit is not None and low >= floor * entry)
            assert r.bars_to_target == (None if hit is None else hit + 1)
            met["touched"] += hit is None and max(b[1] for b in path) == goal
            met["hit"] += hit is not None
            met["on_floor"] += low == floor * entry
            met["under_after_hit"] += hit is not None and min(b[2] for b in path) < floor * entry <= low
    assert met["hit"] and (horizon > 9 or all(met.values())), met


def test_returns_and_closing_labels(spark):
    horizon, target = 6, 0.25
    rows, panel = lattice(spark, {"8A": 90, "8B": 70}, 3)
    panel = panel.selectExpr("code", "date", "case when code = '8B' and volume = 103 then 0 else open end as open", "high", "low", "close", "volume")
    closing, held = by_code(close_outcomes(panel, horizon, target)), by_code(realised_return(panel, horizon))
    states = set()
    for code, bars in rows.items():
        for i, (c, h) in enumerate(zip(closing[code], held[code], strict=True)):
            path = bars[i + 1:i + 1 + horizon]
            states.add(c.entry_state)
            if not path:
                assert c.entry_state == "no_entry" and c.label_close is None
                continue
            entry = 0.0 if code == "8B" and (i + 1) % 7 == 3 else path[0][0]
            if entry == 0:
                assert c.entry_state == "bad_entry" and c.label_close is None
            elif len(path) == horizon:
                assert c.label_close == (max(b[3] for b in path) > entry * (1 + target))
                assert abs(h.return_h - (path[-1][3] / entry - 1)) < 1e-9
            else:
                assert c.label_close is None and h.return_h is None
    assert {"no_entry", "bad_entry"} < states


def test_long_horizons_make_no_row_per_pair_of_bars(spark):
    """First hits of a long horizon come without a join; blocks end before, at and after the horizon's end."""
    rows, panel = lattice(spark, {"7A": 400, "7B": 101, "7C": 100}, 3)
    for horizon in (65, 81, 100):
        df = forward_outcomes(panel, horizon, target_return=0.5, floor_ratio=0.75)
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        seen = 0
        for code, got in by_code(df).items():
            for i, r in enumerate(got):
                path = rows[code][i + 1:i + 1 + horizon]
                hit = next((j for j, b in enumerate(path) if b[1] > path[0][0] * 1.5), None)
                assert r.bars_to_target == (None if hit is None else hit + 1)
                if len(path) == horizon:
                    until = path if hit is None else path[:hit + 1]
                    assert r.label_strict_low == int(min(b[2] for b in until) >= 0.75 * path[0][0])
                    seen += hit is not None
        assert seen
