"""Repair of a conversation's structure by a run-length edit search.

A message is one of nine symbols: a fault that must go, or a role (system, user, assistant, other) with or without a cut
end. The cheapest edits that leave the roles ``(s?(ua)+)?`` are a walk through four states (nothing yet, after a system
message, after a user's, after an assistant's). A symbol is a 4 x 4 min-plus matrix on the costs to come; equal
neighbours are one run, and a run of n is passed by the matrix's binary powers, which are kept. The choices are then
unrolled, by halves of a run with the same powers, for the audit.

Conversations come as sorted streams: what a task holds of one is a byte per message and its audit, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import WORD

KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
#: Costs of the edits, and of leaving a message whose end is cut.
REROLED, DELETED, INSERTED, CUT_KEPT = 3, 4, 3, 3
#: The roles that edits give, and the pairs of initials that may adjoin.
USER, ASSISTANT = "user", "assistant"
ADJOIN = ("su", "ua", "au")
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
FAULT = ord("x")
_NEVER = 1 << 60
#: Conversations, and characters of text, handed on at once.
_ROWS, _SIZE = 4096, 1 << 22
#: Where an insertion leads from each state: a question, or the answer to one.
_INSERTED = (ASKED, ASKED, ANSWERED, ASKED)
_KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): ASKED, ("u", SYSTEM): ASKED, ("u", ANSWERED): ASKED, ("a", ASKED): ANSWERED}
#: Cost of ending in each state, insertions included.
_END = (0, 2 * INSERTED, INSERTED, 0)


def _edits(symbol: int, state: int) -> list[tuple[bytes, int, int]]:
    """(edit, cost, next state) of one message, by the edit's letter."""
    out = [(DELETE, DELETED, state)]
    if symbol != FAULT:
        role = chr(symbol).lower()
        extra = CUT_KEPT if chr(symbol).isupper() else 0
        if (role, state) in _KEPT:
            out.append((KEEP, extra, _KEPT[role, state]))
        out.append((REROLE, REROLED + extra, _INSERTED[state]))
    return out


def _closed(v: list[int]) -> tuple[int, ...]:
    """Costs to come, where messages may be inserted first."""
    for _ in range(3):
        v = [min(v[q], INSERTED + v[_INSERTED[q]]) for q in range(4)]
    return tuple(v)


Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=1024)
def power(symbol: int, log: int) -> Matrix:
    """Min-plus matrix of 2 ** log equal messages: cost from each state before them to each state after."""
    if log:
        half = power(symbol, log - 1)
        return _times(half, half)
    out = []
    for q in range(4):
        row = [_NEVER] * 4
        at, spent = q, 0
        for _ in range(3):
            for _, cost, to in _edits(symbol, at):
                row[to] = min(row[to], spent + cost)
            at, spent = _INSERTED[at], spent + INSERTED
        out.append(tuple(row))
    return tuple(out)


def advance(symbol: int, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to come before n equal messages, given those after them."""
    log = 0
    while n >> log:
        if n >> log & 1:
            m = power(symbol, log)
            v = tuple(min(m[q][k] + v[k] for k in range(4)) for q in range(4))
        log += 1
    return v


@lru_cache(maxsize=65536)
def _one(symbol: int, state: int, v: tuple[int, ...]) -> tuple[bytes, int]:
    """Edits of one message and what is inserted before it, the least string of the cheapest, and the state after it."""
    ahead = _closed([min(cost + v[to] for _, cost, to in _edits(symbol, q)) for q in range(4)])
    done = b""
    while True:
        for letter, cost, to in sorted([*_edits(symbol, state), (INSERT, INSERTED, _INSERTED[state])]):
            if cost + (ahead[to] if letter == INSERT else v[to]) == ahead[state]:
                break
        done += letter
        state = to
        if letter != INSERT:
            return done, state


@lru_cache(maxsize=4096)
def _unrolled(symbol: int, n: int, state: int, v: tuple[int, ...]) -> tuple[bytes, int]:
    """Edits of a run, and the state after it."""
    if n == 1:
        return _one(symbol, state, v)
    half = 1 << (n - 1).bit_length() - 1
    first, state = _unrolled(symbol, half, state, _relative(advance(symbol, n - half, v)))
    second, state = _unrolled(symbol, n - half, state, v)
    return first + second, state


def _relative(v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less their least: choices depend on differences alone, so unrolled runs are met again."""
    least = min(v)
    return tuple(x - least for x in v)


def cheapest(symbols: bytes) -> tuple[int, bytes]:
    """Cost and audit of a conversation: K, R, D and I in order, the ASCII-least of the cheapest."""
    runs = [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]
    after = [_END]
    for s, n in reversed(runs):
        after.append(advance(s, n, after[-1]))
    cost = after.pop()[NOTHING] if runs else 0
    state, out = NOTHING, []
    for s, n in runs:
        edits, state = _unrolled(s, n, state, _relative(after.pop()))
        out.append(edits)
    out.append(INSERT * (_END[state] // INSERTED))
    return cost, b"".join(out)


def messages(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, h): one space where role or text is null, and a hash of the text.

    Messages are in order of turn (nulls first), then role, then that hash, so repeated rows adjoin.
    """
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")).withColumn("h", F.xxhash64("text"))


_ORDER = ("turn", "role", "h")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, initial, fault) of ``messages``: a message's first fault is blank, duplicate, truncated or null."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flat = rows.select("conv", *_ORDER, F.substring("role", 1, 1).alias("initial"), F.length("text").alias("n"),
                       (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "h", "n").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    return flat.select("conv", *_ORDER, "initial", fault.alias("fault"))


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``messages``: gaps, faults, illegal neighbours, cost and audit."""
    kind = rows.schema["conv"].dataType.simpleString()
    symbol = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), chr(FAULT)).when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    flat = symbols(rows).withColumn("symbol", symbol).repartition("conv").sortWithinPartitions("conv", *_ORDER)
    flat = flat.select("conv", "turn", "initial", "fault", "symbol")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        open_ = _Conversation(None)
        for batch in batches:
            kinds = [("conv", batch.schema.field("conv").type), *counted]
            for conv, turn, initial, fault, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_.any or conv != open_.conv:
                    if open_.any:
                        held.append(open_.row())
                    open_ = _Conversation(conv)
                open_.add(turn, initial, fault, symbol)
            if len(held) >= _ROWS:
                yield _batch(held, kinds)
                held = []
        if open_.any:
            held.append(open_.row())
        if held:
            yield _batch(held, kinds)

    counted = [*[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]
    return flat.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Conversation:
    """Counts and symbols of the conversation that streams in."""

    def __init__(self, conv):
        self.conv, self.any = conv, False
        self.first = self.turn = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before = None
        self.symbols = bytearray()

    def add(self, turn, initial, fault, symbol) -> None:
        self.any = True
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ADJOIN:
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        self.symbols += symbol.encode()

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(bytes(self.symbols))
        return self.conv, gaps, *self.faults.values(), self.illegal, cost, audit.decode()


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv, at, edit, role, text): ``messages`` after the edits of their ``reports``, in order within each conversation.

    A deleted message stays as a row with the edit D and null role and text. A conversation's audit is sorted before its
    messages and spells out what to do with each as they stream by.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    first = judged.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("h"),
                          F.col("audit").alias("text"))
    rest = rows.select("conv", F.lit(1).alias("part"), *_ORDER, "text")
    stream = first.unionByName(rest).repartition("conv").sortWithinPartitions("conv", "part", *_ORDER).select("conv", "part", "role", "text")
    rest_kinds = [("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, i, answer = "", 0, False
        for batch in batches:
            out, size = [], 0
            kinds = [("conv", batch.schema.field("conv").type), *rest_kinds]

            def inserted(conv):
                nonlocal i, answer
                while i < len(audit) and audit[i] == "I":
                    out.append((conv, i, "I", ASSISTANT if answer else USER, ""))
                    answer = not answer
                    i += 1

            for conv, part, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not part:
                    audit, i, answer = text, 0, False
                    inserted(conv)
                    continue
                edit = audit[i]
                if edit == "D":
                    out.append((conv, i, edit, None, None))
                else:
                    if edit == "R":
                        role = ASSISTANT if answer else USER
                    out.append((conv, i, edit, role, text))
                    answer = role[:1] == "u"
                    size += len(text)
                i += 1
                inserted(conv)
                if size > _SIZE:
                    yield _batch(out, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, kinds)

    return stream.mapInArrow(run, f"conv {kind}, at long, edit string, role string, text string")


def digests(messages: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the rows of ``repaired``, as they stream: ``role:text`` of those that stay, newline-joined."""
    kind = messages.schema["conv"].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest, first, any_ = None, hashlib.sha256(), True, False
        for batch in batches:
            out, kinds = [], [("conv", batch.schema.field("conv").type), ("repaired_sha256", pa.string())]
            for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text")), strict=True):
                if any_ and conv != open_:
                    out.append((open_, digest.hexdigest()))
                    digest, first = hashlib.sha256(), True
                open_, any_ = conv, True
                if edit != "D":
                    digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    first = False
            if out:
                yield _batch(out, kinds)
        if any_:
            yield _batch([(open_, digest.hexdigest())], kinds)

    return messages.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Reads conv_id, turn, role and text; other columns don't matter. A null role or text is one space; rows without
    conv_id are one conversation; a null turn comes first and counts in no gap. Rows of one turn come by role, then by a
    hash of the text; a repeated row is a duplicate. A role without a letter s, u or a in front (an empty one too) can't be
    kept. No rows give none.

    A conversation's digest and audit are single values, so one task streams through it, with a byte per message and the audit
    in memory; duplicates are found by message, apart from that.
    """
    rows = messages(conversations)
    judged = staged(reports(rows))
    found = digests(repaired(rows, judged)).withColumnRenamed("conv", "_conv")
    out = judged.join(found, judged["conv"].eqNullSafe(found["_conv"])).drop("_conv")
    return out.withColumnRenamed("conv", "conv_id")
