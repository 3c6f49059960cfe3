"""Stages of the corpus pipeline against plain re-computations."""

from __future__ import annotations

import itertools
import os
import tracemalloc
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
from docs import plain, prose, table

from barsift import session
from barsift.llm import common, decontaminate, nearcopies, simhash


def shingled(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    a, b = shingled(a), shingled(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_of_similarity_are_dropped(spark):
    rows = plain(24)
    common = prose("en", 60, 900)
    for i in range(12):
        w = prose("en", 150 + i, 700 + i % 4).split()
        for k in range(i % 5):
            w[(17 * k + 5 * i) % len(w)] = f"x{i}y{k}"
        rows.append((500 + i, " ".join(w), "en", "s", 0))
        rows.append((600 + i, prose("de", 10 + 5 * i, 800 + i) + " " + common, "en", "s", 0))
    rows += [(700, rows[0][1], "en", "s", 0), (701, None, "en", "s", 0), (702, "one two", "en", "s", 0), (703, "One  two", "en", "s", 0)]
    root = {r[0]: r[0] for r in rows}
    for x, y in itertools.combinations(sorted(rows, key=lambda r: r[0]), 2):
        if similar(x[1], y[1]) and root[x[0]] != root[y[0]]:
            a, b = sorted((root[x[0]], root[y[0]]))
            root = {k: a if v == b else v for k, v in root.items()}
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))
    assert len(set(root.values())) == 46


SHORT = ["Compute 12 + 35 + 48 - 7 + 90.", "Sort 14, 3, 27, 9, 81, 42 and 5.", "Who Wrote The Novel Pride And Prejudice?", "What is two plus two?",
         "Welcher Fluss fliesst durch Berlin und Potsdam?", "Who was Ada Lovelace?", "\u54ea\u4e00\u6761\u6cb3\u6d41\u7ecf\u67cf\u6797\u548c\u6ce2\u8328\u5766"]


def test_items_rich_in_slots_or_short_are_found(spark):
    items = spark.createDataFrame(list(enumerate(SHORT)), "item_id long, text string")
    rows = [(i, f"{prose('en', 12, i)} {t} {prose('de', 9, i)}", "en", "s", 0) for i, t in enumerate(SHORT)]
    # The unspaced item stands inside a longer run; other numbers are another question.
    rows[6] = (6, "\u8bf7\u95ee" + SHORT[6] + "\u5417", "zh", "s", 0)
    rows += [(50, "Compute 11 + 35 + 48 - 7 + 90.", "en", "s", 0), (51, "Who was Bob Lovelace?", "en", "s", 0), *[(100 + r[0], *r[1:]) for r in plain(20)]]
    got = decontaminate.matches(table(spark, rows), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(len(SHORT))]
    kept = corpus_pipeline.decontaminate.clean(table(spark, rows), items)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(range(len(SHORT)))


def test_verbatim_passage_is_found_beside_a_changed_slot(spark):
    item = f"They say that Anna sold the house to Paul. {prose('en', 40, 950).lower()} and later on we saw Anna go home with him again"
    changed = item.replace("saw Anna", "saw Berta")
    rows = [(1, f"First {changed} last", "en", "s", 0), (2, f"First {item} last", "en", "s", 0), *[(100 + r[0], *r[1:]) for r in plain(10)]]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.matches(table(spark, rows), items).collect()) == [1, 2]


def test_passages_of_over_fifty_words_are_cut(spark):
    words = [w[:4] for w in prose("en", 200, 960).split()]
    long, short, tiny = " ".join(words[:51]), " ".join(words[60:110]), " ".join("abcdefghi"[i * i % 9] for i in range(51))
    assert max(len(long), len(short)) < 400 and len(tiny) == 101
    rows = [(10 * k + i, f"{a} {passage} {b}", "en", "s", 0) for k, passage in enumerate((long, short, tiny)) for i, (a, b) in enumerate((("x1", "y1"), ("z2", "w2")))]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_text(spark, table(spark, rows), "").collect()}
    assert [got[i] for i in (0, 1, 20, 21)] == ["x1y1", "z2w2"] * 2
    assert [got[i] for i in (10, 11)] == [rows[2][1], rows[3][1]]


def test_near_copies_are_first_grouped_by_fingerprint(spark, monkeypatch):
    words = prose("en", 900, 970).split()
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), prose("de", 300, 971)]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    prints = [simhash.majority(s) for s in sets]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.DIFFER < (prints[0] ^ prints[2]).bit_count()
    seen, links = [], nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda p: seen.extend(r.fp for r in p.collect()) or links(p))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()) == [0, 2, 3]
    assert {x % 2**64 for x in seen} == set(prints)
    # One fingerprint for all: unlike sets of a group are told apart.
    nodes = [(nearcopies._node(s), i, 5) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(nodes, "node long, t long, fp long")
    held = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "t long, text binary")
    first = min(r[0] for r in nodes.collect())
    near = {nearcopies._node(sets[0]), nearcopies._node(sets[1])}
    found = {frozenset(r) for r in nearcopies.by_fingerprint(nodes, held).collect()}
    assert found == ({frozenset(near)} if first in near else set())


def test_tables_staged_on_the_way_are_removed(spark):
    before = set(os.listdir(session._stages(spark))) if os.path.isdir(session._stages(spark)) else set()
    docs = table(spark, [*plain(12), (50, plain(1)[0][1], "en", "s", 0)])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert len(set(os.listdir(session._stages(spark))) - before) <= 4
    assert sorted(r.doc_id for r in got.collect()) == list(range(12))


def test_windows_take_little_memory():
    made = []
    rows = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))),
                           schema={"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, mapInArrow=lambda f, _: made.append(f))
    decontaminate._spread(rows, [decontaminate.WINDOW], np.zeros(1 << decontaminate.FILTER_BITS - 3, np.uint8))
    texts = [" ".join(f"w{i * 997 % 40_000}" for i in range(k, k + 5_000)).encode() for k in range(0, 500_000, 5_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "text_hash", "text"])
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in made[0](iter([batch]))) == 0
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20


def test_a_large_group_of_near_copies_is_not_compared_all_with_all(spark, monkeypatch):
    words, rows = prose("en", 4000, 980).split(), []
    words = [f"{w}{i}" for i, w in enumerate(words[:130])]
    for i in range(48):
        w = list(words)
        # Two with one change each are near copies; those with two changes just miss it, by places that prefixes don't tell apart.
        for k in range(1 if i < 4 else 2):
            w[(47 * k + 7 * i + 9) % len(w)] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    monkeypatch.setattr(nearcopies, "PAIRED", 4, raising=False)
    asked, confirmed = [], nearcopies._confirmed
    monkeypatch.setattr(nearcopies, "_confirmed", lambda pairs, nodes, texts: asked.append(pairs.count()) or confirmed(pairs, nodes, texts))
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect())
    root = list(range(48))
    close = 0
    for x, y in itertools.combinations(range(48), 2):
        if similar(rows[x][1], rows[y][1]):
            close += 1
            root = [root[x] if r == root[y] else r for r in root]
    assert 0 < close < 48 * 47 // 4
    assert len(got) == len(set(root)) and {root[i] for i in got} == set(root)
    assert sum(asked) < 48 * 47 // 3


def test_parity_bits_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 40, 900):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        b[:n // 2] = a[:n // 2]
        a, b = np.unique(a), np.unique(b)
        bits = [int.from_bytes(nearcopies._parities(x), "little") for x in (a, b)]
        assert len(nearcopies._parities(a)) == 8 * nearcopies.PARITIES
        assert 0 < (bits[0] ^ bits[1]).bit_count() <= len(np.setxor1d(a, b)) and nearcopies._parities(a) == nearcopies._parities(a[::-1])


def test_field_of_hashes_misses_none(spark, monkeypatch):
    monkeypatch.setattr(common, "_GATHERED", 50)
    c = np.random.default_rng(6).integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    rows = spark.createDataFrame([(int(x),) for x in [*c.view(np.int64), *c[:100].view(np.int64), *c[:30].view(np.int64)]], "c long").repartition(3)
    assert common.in_field(common.field_of(rows), c).all()
    twice = common.hash_field(rows, lambda batch: [batch.column(0).to_numpy().view(np.uint64)])
    assert common.in_field(twice, c).tolist() == [True] * 100 + [False] * 200
    none = common.field_of(rows.limit(0))
    asked, rest = common.split_by_field(rows, "c", twice)
    assert not none.any() and asked.count() == 230 and rest.count() == 200
