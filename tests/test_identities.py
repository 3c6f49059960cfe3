"""Declared identities: those that hold stay silent; differing sums, lone keys, unknown sums and repeats are rows."""

from barsift.operators.identities import Identity, broken


def test_each_fault_is_one_row(spark):
    parts = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0), ("c", 1, 1.0), ("d", 1, None), ("e", 1, 1.0), ("e", 1, 1.0), (None, 1, 6.0)],
                                  "k string, fold int, n double")
    whole = spark.createDataFrame([("a", 5.0), ("b", 4.5), ("d", 0.0), ("e", 2.0), ("f", 1.0), (None, 6.0)], "k string, total double")
    rules = [Identity("sum", ("k",), "parts", "n", "total", "whole"), Identity("loose", ("k",), "parts", "n", "total", "whole", 0.6),
             Identity("single", ("k", "fold"), "parts", "1", "1")]
    got = {(r["identity"], r["key"]): (r["left_value"], r["right_value"]) for r in broken({"parts": parts, "whole": whole}, rules).collect()}
    lone = {"c": (1.0, None), "d": (None, 0.0), "f": (None, 1.0)}
    assert got == {("sum", "b"): (4.0, 4.5), ("single", "e|1"): (2.0, 1.0), **{(n, k): v for n in ("sum", "loose") for k, v in lone.items()}}
    assert broken({"parts": parts.limit(0), "whole": whole.limit(0)}, rules).count() == 0
