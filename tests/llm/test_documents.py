"""Operators over documents against plain re-computations, and their awkward cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from docs import awkward, plain, prose, table
from pyspark.sql import functions as F

from barsift.llm import decontaminate, langid, licenses, maxent, mixing, simhash, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = [*plain(), *awkward()]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Mixing


def test_mix_targets_and_copies(spark):
    rows = mixing.mix(table(spark, ALL)).collect()
    assert len(rows) == len(ALL)
    size, sources = Counter(), sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        assert r.size == len(WORD.findall(r.text or ""))
        size[r.source] += r.size
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    # Filling from the lowest cap, one source after the other.
    left, open_, target = sum(size.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * size[s] <= weight[s] * level]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.discard(s)
    for r in rows:
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and r.source_size == size[r.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.size * r.copies and math.floor(rate) <= r.copies <= math.ceil(rate) <= 3
    again = mixing.mix(table(spark, ALL[::-1]).repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in rows) == Counter((r.doc_id, r.text, r.copies) for r in again)


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 1 + id % 40) as text", "concat('s', id % 3) as source")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_mix_of_nothing_and_of_clashing_columns(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    got = mixing.emitted(mixing.mix(table(spark, ALL, extra=True)))
    assert dict(got.dtypes)["size"] == "bigint" and got.columns.count("size") == 1
    assert mixing.mix(table(spark, [(1, None, None, None, None)])).first().taken == 0


# Language


def test_language_of_held_out_documents(spark):
    rows = table(spark, plain(90))
    got = langid.identify(rows.filter("doc_id % 4 = 2"), langid.fit(rows.filter("doc_id % 4 <> 2"))).collect()
    assert len(got) == 22 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_posterior_is_that_of_the_counts(spark):
    rows = plain(12)
    model = langid.fit(table(spark, rows))
    grams = {}
    for _, text, lang, _, _ in rows:
        for w in text.lower().split():
            grams.setdefault(lang, Counter()).update(langid.ngram_buckets([w])[0].tolist())
    text = "das wasser house"
    score = []
    for lang in sorted(grams):
        total = sum(grams[lang].values()) + langid.ADDED * langid.BUCKETS
        found = [g for w in text.split() for g in langid.ngram_buckets([w])[0].tolist()]
        score.append(math.log(1 / 3) + sum(math.log((grams[lang][g] + langid.ADDED) / total) for g in found))
    want = np.exp(np.array(score) - max(score))
    got = langid.identify(table(spark, [(1, text, None, None, 0)]), model).first()
    assert got.lang_pred == sorted(grams)[int(want.argmax())] and math.isclose(got.score, 1 / want.sum(), rel_tol=1e-6)


def test_language_of_awkward_rows(spark):
    got = langid.identify(table(spark, ALL, extra=True), langid.fit(table(spark, ALL))).collect()
    assert len(got) == len(ALL)
    for r in got:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1
    nothing = langid.fit(table(spark, []))
    assert {r.lang_pred for r in langid.identify(table(spark, ALL), nothing).collect()} == {"und"}
    assert langid.identify(table(spark, []), nothing).count() == 0
    with pytest.raises(ValueError):
        langid.fit(spark.range(300).selectExpr("'word' as text", "string(id) as lang"))


# SimHash


def plain_fingerprint(text):
    w = WORD.findall(low(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates_match_all_pairs(spark):
    rows = [r for r in ALL if r[0] != 104]
    rows += [(200 + i, r[1] + " End", r[2], r[3], r[4]) for i, r in enumerate(plain(30))]
    rows += [(300 + i, plain(30)[i % 2][1], "en", "s0", 0) for i in range(10)]
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = Counter(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in rows], prints), strict=True))
    got = simhash.near_duplicates(table(spark, rows, extra=True))
    assert Counter(map(tuple, got.collect())) == want
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    groups = Counter(w[2] for w in want if w[2] is not None)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(groups)


@pytest.mark.parametrize("paired", [2, 256])
def test_links_join_what_brute_force_joins(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(3)
    prints = [0, (1 << 64) - 1]
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(14):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(signed, prints)
    assert [got.get(s, s) for s in signed] == want
    near = {(a, b) for a, b in ((x, y) for x in signed for y in signed if x < y) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in edges.collect()} <= near


def test_long_chain_is_one_component(spark):
    edges = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_simhash_of_no_rows(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.keep_one(table(spark, [])).count() == 0


# Suffixes


def plain_cut(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, 2048])
def test_repeats_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    passage = prose("en", 40, 77)
    rows = [r for r in ALL if r[0] != 104]
    rows += [(200 + i, prose("de", i % 7, i) + passage[i % 5:len(passage) - i % 3] + prose("fr", 5, i), "en", "s", 0) for i in range(12)]
    rows += [(300, "ab" * 90, "en", "s", 0), (301, "x" * 75, "en", "s", 0), (302, passage + passage, "en", "s", 0), (303, "y" * 60, "en", "s", 0), (304, "é" * 40, "e", "s", 0)]
    texts = [(r[1] or "").encode() for r in rows]
    for length, gram in ((60, 40), (61, 20)):
        got = suffixes.dedupe(table(spark, rows), keep=["doc_id"], with_text=False, length=length, gram=gram)
        want = Counter((r[0], *w) for r, w in zip(rows, plain_cut(texts, length), strict=True))
        assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def test_long_text_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 1000)
    text = prose("en", 900, 5)
    data = np.frombuffer(text.encode(), np.uint8)
    x, _ = suffixes.anchors(data, 100, 70)
    monkeypatch.undo()
    y, _ = suffixes.anchors(data, 100, 70)
    assert x.tolist() == y.tolist() and (np.diff(y) <= 31).all()


def test_suffix_order_is_alphabetical():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(1, 30, 200)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    group = np.sort(rng.integers(0, 5, 200))
    order = suffixes.suffix_order(data, suffixes.prefix_hashes(data), start, end, group)
    assert [parts[i] for i in order] == [parts[i] for i in sorted(range(200), key=lambda i: (group[i], parts[i]))]


def test_cut_texts_keep_columns_and_whole_characters(spark):
    passage = "ß" * 300
    rows = [(1, "a" + passage, "de", "s", 1), (2, "bc" + passage + "d", "de", "s", 1), (3, None, "de", "s", 1), (4, "", "de", "s", 1)]
    got = {r.doc_id: r for r in suffixes.dedupe(table(spark, rows, extra=True)).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("a", "bcd", None, "") and got[1].row == "x"
    assert suffixes.dedupe(table(spark, [])).count() == 0


# Decontamination

ITEM = "A farmer in Holm sells 12 kg of apples to Anna and Anna then gives 5 kg of these to her brother who eats them"


def test_reparameterised_questions_are_found(spark):
    other = ITEM.replace("12", "30").replace("Anna", "Berta").replace("5 kg", "7 kg").replace("kg", "lbs").replace("Holm", "Varde")
    mixed = ITEM.replace("to Anna and Anna", "to Berta and Clara")
    rows = [(401, f"Before. {ITEM} after", "en", "s", 0), (402, f"Before that {other}. After", "en", "s", 0), (403, f"x y z {mixed} end", "en", "s", 0),
            (404, ITEM.upper(), "en", "s", 0), (405, "; ".join(ITEM.split()), "en", "s", 0), *ALL]
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "short"), (10, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(table(spark, rows, extra=True), items).collect()}
    assert set(got) == {401, 402, 404, 405} and {r.item_id for r in got.values()} == {7}
    assert got[401].slots_changed == 0 and got[402].slots_changed >= 3 and got[401].windows == got[401].item_windows
    left = decontaminate.clean(table(spark, rows), items)
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in rows if r[0] not in got)
    assert left.columns == table(spark, rows).columns


def test_template_windows_match_a_plain_scan(spark):
    items = [(i, prose("en", 30, 500 + i)) for i in range(5)]
    rows = [(i, r[1] + " " + (items[i % 5][1] if i % 3 == 0 else ""), "en", "s", 0) for i, r in enumerate(plain(40))]
    words = lambda t: [w.strip(".,") for w in t.lower().split()]
    want = set()
    for d, t, *_ in rows:
        w = words(t)
        seen = {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
        for k, x in items:
            v = words(x)
            if sum(tuple(v[i:i + 8]) in seen for i in range(len(v) - 7)) >= 6:
                want.add((d, k))
    got = decontaminate.matches(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 14


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate.matches(table(spark, []), items).count() == 0
    assert decontaminate.matches(table(spark, ALL), items.limit(0)).count() == 0
    assert decontaminate.clean(table(spark, ALL), items.limit(0)).count() == len(ALL)


# Language model


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_language_model_scores(spark):
    rows = [*ALL, *[(1000 + i, prose("en", 200, 40 + i), "en", "s", 0) for i in range(40)]]
    learn = [r for r in rows if not held_out(r[0])]
    docs = table(spark, rows)
    got = maxent.score(docs.withColumn("n", F.lit(1)), table(spark, learn), keep=("source",)).collect()
    assert len(got) == len(rows)
    count = Counter(w for r in learn for w in [*(x.encode() for x in WORD.findall(low(r[1]))), b""])
    n, v = sum(count.values()), len(count)
    texts = Counter()
    for r in rows:
        w = [*(x.encode() for x in WORD.findall(low(r[1]))), b""]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        texts[r[0], len(w), sum(count[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == texts
    fresh = [r for r in got if held_out(r.doc_id) and r.n_tokens > 100]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_language_model_is_a_distribution(spark):
    learn = table(spark, plain(30)).select("doc_id", F.col("text").cast("binary").alias("text"))
    weights, in_cell = maxent.fit(learn)
    vocab = {bytes(r.word): r.n for r in maxent.word_counts(learn).collect()}
    words = maxent.Words(list(vocab))
    types = np.bincount(words.cell, minlength=len(in_cell))
    c = np.array(list(vocab.values()))
    room = in_cell + 1
    inside = np.bincount(words.cell, (c - maxent.DISCOUNT) / room[words.cell], len(in_cell)) + (maxent.DISCOUNT * types + 1) / room
    assert np.allclose(inside, 1)
    ids = np.array(words.numbers(b"the house and water"))
    words.settle()
    cell, classes, slots = maxent._rows(ids, ids, np.zeros(len(ids), int), words)
    # The same history with every class in turn, and every slot of the class.
    k = np.arange(maxent.CLASSES)
    total = [maxent._chances(np.full(1, c * maxent.SLOTS), [r[2:3] for r in classes], [r[2:3] for r in slots], weights, maxent._Room())[0] for c in k]
    assert math.isclose(np.exp(total).sum(), 1, abs_tol=1e-4)
    total = [maxent._chances(np.full(1, s), [r[2:3] for r in classes], [r[2:3] for r in slots], weights, maxent._Room())[1] for s in range(maxent.SLOTS)]
    assert math.isclose(np.exp(total).sum(), 1, abs_tol=1e-4)


def test_language_model_of_empty_tables(spark):
    assert maxent.score(table(spark, []), table(spark, plain(5))).count() == 0
    got = maxent.score(table(spark, plain(3)), table(spark, [])).collect()
    assert len(got) == 3 and all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


# Licences


def test_licences_and_their_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/x/one", "some code"), ("a/x/two", "/* Licensed under the Apache License,\n * Version 2.0 */\n" + prose("en", 40, 3)),
             ("a/x/deep/LICENSE", "Licensed under CC BY-NC 4.0."), ("a/x/deep/y/three", "text"), ("b/four", None), (None, "plain"), ("b/five", ""),
             ("top", "All rights reserved."), ("a/x/one", "some code"), ("c/long", prose("en", 30_000, 1) + "\nReleased under the MIT License.\n" + prose("en", 50, 2))]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "'q' as dir", "'q' as license")
    got = licenses.scan(df).collect()
    assert len(got) == len(files)
    by = {r.path: (r.license, r.origin, r.license_dir) for r in got}
    assert by["a/x/one"] == ("MIT", "inherited", "a") and by["a/x/two"][:2] == ("Apache-2.0", "own")
    assert by["a/x/deep/y/three"] == ("CC-BY-NC-4.0", "inherited", "a/x/deep") and by["a/LICENSE"][:2] == ("MIT", "own")
    assert by["b/four"] == by[None] == by["b/five"] == (None, None, None) and by["top"][0] == "Proprietary" and by["c/long"][:2] == ("MIT", "own")
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_cosine_is_that_of_the_vectors():
    df = dict.fromkeys((w for _, t in licenses.TEMPLATES for w in licenses.terms(t.encode())), 3) | {b"the": 90, b"license": 20}
    scorer, n = licenses.Scorer(df, 100), 100
    line = licenses.terms(b"(c) this file is licensed under the MIT License")
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1 if w in df else math.log(1 + n) + 1
    vec = lambda ws: {w: k * idf(w) for w, k in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a = vec(line)
    want = max(sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b) for b in (vec(licenses.terms(t.encode())) for _, t in licenses.TEMPLATES))
    name, score = scorer.best(line, 0.3)
    assert name == "MIT" and math.isclose(score, want)
