"""Table diffs and float distances against plain Python."""

import math
import struct
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from barsift.operators import tablediff as td


def number(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_places_are_bit_patterns(spark):
    rng = np.random.default_rng(5)
    edges = [0.0, -0.0, 5e-324, 1.5e-323, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, 1.0, 3.0]
    powers = [f(2.0 ** e) for e in range(-1073, 1024, 7) for f in (float, lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, math.inf))]
    drawn = (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist()
    xs = [s * x for x in (*edges, *powers, *drawn) for s in (1, -1)]
    df = td.with_places(spark.createDataFrame([(x,) for x in xs], "x double"), {"n": "x"})
    assert df.columns == ["x", "n"]
    assert all(r.n == number(r.x) for r in df.collect())
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.n for r in td.with_places(odd, {"n": "x"}).collect()] == [None] * 4


def test_classes(spark):
    nan, inf, up = float("nan"), float("inf"), math.nextafter
    cases = [(1.0, 1.0, "exact"), (0.0, -0.0, "exact"), (None, nan, "exact"), (inf, inf, "exact"), (None, 0.0, "one_unknown"), (2.0, nan, "one_unknown"),
             (1.0, up(1.0, 2), "rounding"), (1.0, 1.0 + 4 * 2.0 ** -52, "rounding"), (1.0, 1.0 + 5 * 2.0 ** -52, "real"), (5e-324, -5e-324, "rounding"),
             (inf, 1e308, "real"), (1.0, -1.0, "real")]
    rows = td.classified(spark.createDataFrame(cases, "a double, b double, want string"), "a", "b").collect()
    assert all(r["class"] == r.want for r in rows)
    narrow = spark.createDataFrame([(9.99, float(np.float32(9.99)), True), (9.99, float(np.float32(9.99)), False)], "a double, b double, n boolean")
    assert [r["class"] for r in td.classified(narrow, "a", "b", narrow="n").collect()] == ["rounding", "real"]
    got = td.tolerance_classes(narrow, {"w": (F.col("a"), F.col("b"), 64)}, {"w": F.lit(9.99)}).collect()
    assert [(r.check, r["class"], r["rows"], r.flips) for r in got] == [("w", "real", 2, 2 * int(float(np.float32(9.99)) > 9.99))]


def brute(left, right):
    def by_key(rows):
        out = defaultdict(list)
        for k, *v in rows:
            out[k].append(tuple(v))
        return out

    a, b, found = by_key(left), by_key(right), Counter()
    for k in {*a, *b}:
        if Counter(a[k]) == Counter(b[k]):
            continue
        if len(a[k]) > 1 or len(b[k]) > 1:
            found["(key)", "repeated"] += 1
        elif not a[k] or not b[k]:
            found["(key)", "only_right" if b[k] else "only_left"] += 1
        else:
            for c, x, y in zip("xy", a[k][0], b[k][0]):
                if x != y:
                    found[c, "one_unknown" if x is None or y is None else "rounding" if abs(number(x) - number(y)) <= 4 else "real"] += 1
    return found


def test_planted_edits_are_found_and_equal_parts_stay_shut(spark):
    rng = np.random.default_rng(9)
    left = [(k, float(rng.normal()), float(k)) for k in range(400)] + [(None, 1.0, 2.0), (7, 0.5, 0.5), (400, None, None)]
    right = [r for r in left if r[0] not in (11, 12)] + [(500, 1.0, None), (33, 1.0, 1.0)]
    right = [(k, math.nextafter(x, 9) if k in (50, 51) else x, None if k == 90 else y + 1 if k in (91, 92, 93) else y) for k, x, y in right]
    frames = [spark.createDataFrame(rows, "k long, x double, y double").repartition(3) for rows in (left, right)]
    got = {(r["column"], r.kind): r for r in td.table_diff(*frames, ["k"], ["x", "y"]).collect()}
    assert {k: r["rows"] for k, r in got.items()} == dict(brute(left, right))
    assert got["y", "one_unknown"].first_key == "90" and got["y", "one_unknown"].left_value == 90.0 and got["y", "one_unknown"].right_value is None
    assert td.unequal_buckets(*frames, ["k"], ["x", "y"]).count() <= 10
    assert td.table_diff(frames[0], frames[0].repartition(5), ["k"], ["x", "y"]).count() == 0


def test_doubled_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 1.0)], "k long, x double, y double")
    swapped = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 1.0)], "k long, x double, y double")
    twice = one.unionByName(one.filter("k = 1")).unionByName(one.filter("k = 1"))
    kinds = lambda a, b: sorted((r["column"], r.kind, r["rows"]) for r in td.table_diff(a, b, ["k"], ["x", "y"]).collect())
    assert kinds(one, twice) == [("(key)", "repeated", 1)]
    assert kinds(one, swapped) == [("x", "one_unknown", 1), ("y", "one_unknown", 1)]
    assert kinds(one, one.limit(0)) == [("(key)", "only_left", 2)]
    assert kinds(one.limit(0), one.limit(0)) == []
