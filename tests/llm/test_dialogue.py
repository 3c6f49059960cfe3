"""Conversation repair against a search over all edits, and the awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

from barsift.llm import dialogue
from barsift.llm.queries import QUERIES

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def expected(rows):
    """The contract on the rows of one conversation, in order."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        kinds.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @lru_cache(None)
    def best(i, made, inserts):
        out = [(0, "", ())] if i == n and re.fullmatch("(s?(ua)+)?", made) else []
        # Only the end of what was made matters, so it is kept short.
        short = lambda m: re.sub("^(s?)(ua)+(?=ua)", r"\1", m)
        alive = lambda m: re.fullmatch("s?(ua)*u?", m)
        if i < n:
            c, e, w = best(i + 1, made, 0)
            out.append((c + 4, "D" + e, w))
            if kinds[i] not in ("b", "d"):
                extra = 3 if kinds[i] == "t" else 0
                for edit, cost, role in (("K", 0, rows[i][2]), ("R", 3, "user"), ("R", 3, "assistant")):
                    if role[:1] and alive(made + role[:1]):
                        c, e, w = best(i + 1, short(made + role[:1]), 0)
                        out.append((c + cost + extra, edit + e, (f"{role}:{rows[i][3]}", *w)))
        if inserts < 3:
            for role in ("user", "assistant"):
                if alive(made + role[0]):
                    c, e, w = best(i, short(made + role[0]), inserts + 1)
                    out.append((c + 3, "I" + e, (f"{role}:", *w)))
        return min(out, default=(10 ** 6, "", ()))

    cost, audit, kept = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def check(rows, found):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(found) == set(by)
    for conv, group in by.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        assert found[conv] == expected(group), (conv, group)


def collected(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def made(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "No!", "why", "", " \t", None, "One. Two", "End. \n", "naïve ☃?", f"t{turn}.", f"u{turn}"])
            out.append((conv, None if turn == 0 and rng.random() < 0.3 else 2 * turn + rng.randrange(2), rng.choice(roles), text))
    return out


def test_every_conversation_is_repaired_as_by_trying_all_edits(spark):
    rows = made(150, 4)
    clean = [tuple(" " if v is None and i > 1 else v for i, v in enumerate(r)) for r in rows]
    check(clean, collected(dialogue.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))))


def test_query_follows_the_contract_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_conversation_repair"](spark, folder)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = collected(df)
    left = list(damage(rows))
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert all(found.pop(c) == (0, 0, 0, 0, 0, 0, "", EMPTY) for c in gone)
    check(left, found)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, "user", "Hi."), (None, 3, "assistant", "Yes."), (1, None, None, None), (2, 5, "user", "a."), (2, 5, "user", "a."),
            (2, 9, "assistant", "b."), (3, 1, "system", "s."), (3, 2, "user", "q?"), (3, 2, "user", "q?"), (3, 3, "assistant", "long " * 50_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as h", "'x' as audit", "3 as part", "'y' as fault", "7 as cost")
    found = collected(dialogue.repair(df))
    assert found[None][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert found[1] == (0, 1, 0, 0, 0, 4, "D", EMPTY)
    assert found[2][:7] == (3, 0, 1, 0, 1, 4, "KDK")
    assert found[3][:7] == (0, 0, 1, 0, 1, 4, "KKDK")
    assert dialogue.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_runs_go_by_powers(spark):
    rows = [(1, i, "user", f"m{i}.") for i in range(3001)] + [(2, i, ("user", "assistant")[i % 2], f"m{i}.") for i in range(3000)]
    found = collected(dialogue.repair(spark.createDataFrame(rows, SCHEMA)))
    assert found[2][5:7] == (0, "K" * 3000)
    cost, audit = dialogue.cheapest(b"u" * 3001)
    assert found[1][5:7] == (cost, audit.decode()) and cost == 3 * 1501 and len(audit) == 3001 + audit.count(b"I")
    for symbol in b"suaoSUAOx":
        v = (0, 6, 3, 0)
        one = v
        for _ in range(37):
            one = dialogue.advance(symbol, 1, one)
        assert dialogue.advance(symbol, 37, v) == one
