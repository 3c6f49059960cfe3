"""Operators over pages and vectors, and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from docs import plain, prose, table
from pyspark.sql import functions as F

from barsift.llm import ann, queries, urlfilter, warc

PAGES = "page_id long, url string, html string"


# URL filter


def rule_of(url):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = []
    for verdict, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def plain_ratios(texts):
    """The recursion on both models, one URL after the other."""
    order = urlfilter.ORDER
    models = {}
    for kind in ("allow", "block"):
        count, after = Counter(), defaultdict(Counter)
        for text, said, learned in texts:
            if said == kind and learned:
                s = "\x02" * (order - 1) + text + "\x03"
                for i in range(order - 1, len(s)):
                    for k in range(order):
                        after[s[i - k:i]][s[i]] += 1
                        count[s[i - k:i]] += 1
        models[kind] = after, count

    def chance(kind, context, x):
        after, count = models[kind]
        p = urlfilter.BASE
        for k in range(len(context) + 1):
            c = context[len(context) - k:]
            if count[c]:
                p = (after[c][x] + len(after[c]) * p) / (count[c] + len(after[c]))
        return p

    def score(text):
        s = "\x02" * (order - 1) + text + "\x03"
        places = range(order - 1, len(s))
        return sum(math.log10(chance("allow", s[i - order + 1:i], s[i]) / chance("block", s[i - order + 1:i], s[i])) for i in places) / len(places)

    return score


URLS = ["http://a.org/x", "http://EXAMPLE.org/es/1", "https://www.example.org/en/12?q#f", "http://example.org/en/2", "http://org", "http://b.com/fr/7",
        "http://c.com/de/8", "http://c.com/de", "ftp://x://y/z", "no scheme", None, "", "http://d.net/en/3", "http://d.net?x/y", "http://h#/de/", "://", "http://myorg/x",
        "http://é.com/fr/ü\nv", "http://long.net/" + "a" * 5000]


def test_urls_are_split_and_judged(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(100 + i, f"http://{'good' if i % 2 else 'bad'}{i}.com/{'fr' if i % 2 else 'de'}/{i}", "") for i in range(60)]
    rows += [(900, "http://good77.net/fr/9", ""), (901, "http://bad78.net/de/9", ""), (None, "http://a.org/x", ""), (0, "http://a.org/x", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'q' as host", "1 as score", "'t' as text")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows)
    said = {}
    for i, u, _ in rows:
        host, path, rule, verdict = rule_of(u)
        said[host + path] = verdict
    folds = {r.text: r.f for r in spark.createDataFrame([(t,) for t in said], "text string").selectExpr("text", "pmod(xxhash64(text), 5) as f").collect()}
    per_url = [(h + p, v, folds[h + p] != 0) for h, p, _, v in (rule_of(u) for _, u, _ in rows)]
    score = plain_ratios(per_url)
    want = {(i, u): rule_of(u) for i, u, _ in rows}
    url = {(i, *rule_of(u)[:2]): u for i, u, _ in rows}
    for r in got:
        host, path, rule, verdict = want[r.page_id, url[r.page_id, r.host, r.path]]
        assert r.rule == rule and math.isclose(r.score, score(r.host + r.path), rel_tol=1e-6, abs_tol=1e-9)
        assert r.verdict == (verdict or ("allow" if r.score >= r.threshold else "block"))
    by = {r.page_id: r.verdict for r in got}
    assert by[900] == "allow" and by[901] == "block"


def test_urls_without_rules_and_without_rows(spark):
    df = spark.createDataFrame([(1, "http://x.net/a", ""), (2, None, "")], PAGES)
    assert {(r.verdict, r.score) for r in urlfilter.judge(df).collect()} == {("allow", 0.0)}
    assert urlfilter.judge(df.limit(0)).count() == 0


# WARC


def page_rows():
    big = prose("en", 40_000, 8)
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" if i % 3 else prose("de", 50, i)) for i in range(400)]
    return rows + [(500, None, None), (501, "http://x/\r\ny", ""), (502, "http://x", big), (503, "http://y", big), (503, "http://y", big), (None, "http://z", "<p>1</p>")]


@pytest.mark.parametrize("least", [0, 20])
def test_archives_read_back(spark, tmp_path, least):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as shard", "'s' as sha1")
    manifest = warc.write(df, str(tmp_path / "w"), min_bytes=least, shard_bytes=20_000, file_bytes=4_000)
    got = warc.read(spark, str(tmp_path / "w"), manifest).collect()
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, u, h in rows:
        data = (h or "").encode()
        refers = largest[h or ""] if len(data) >= least and i != largest[h or ""] else None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers,
             data if refers is None else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got) == want
    files = sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    listed = manifest.collect()
    assert files == sorted(r.name for r in listed) and len(files) > 5 and sum(r.records for r in listed) == len(rows)
    for r in listed:
        data = (tmp_path / "w" / r.name).read_bytes()
        assert len(data) == r.size and hashlib.sha1(data).hexdigest() == r.sha1
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records


def test_archives_do_not_depend_on_the_deal(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), PAGES)
    sums = []
    for k, rows in enumerate((df.repartition(7), df.orderBy("url").coalesce(1))):
        manifest = warc.write(rows, str(tmp_path / str(k)), shard_bytes=20_000, file_bytes=4_000)
        sums.append(sorted((r.name, r.sha1) for r in manifest.collect()))
    assert sums[0] == sums[1]


def test_archive_of_no_pages(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert manifest.count() == 0


def test_a_damaged_record_is_refused():
    whole = warc.record(1, "http://x", b"payload", None)
    fields, block = next(warc.parse(gzip.compress(whole)))
    assert fields["WARC-Block-Digest"] == f"sha1:{warc.base32_sha1(block)}"
    assert fields["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(b'payload')}"


# Nearest neighbours


def vectors(n=700, d=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + rng.normal(scale=0.15, size=(n, d))
    return x * rng.uniform(0.5, 2, (n, 1))


def test_neighbours_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 20)
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "QUERIES", 7)
    x = vectors()
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())] + [(2000 + i, x[3].tolist(), 0) for i in range(300)]
    bad = [(3000, None, 0), (3020, [0.0] * 8, 0), (3040, [1.0, None, *[0.0] * 6], 0), (3060, [float("nan"), *[1.0] * 7], 0), (3080, [float("inf"), *[1.0] * 7], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 as leaf", "'v' as v")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = m @ m[ids == q][0]
        best = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:20]
        assert len(got[q]) == 20 and [v for v, _ in got[q]] == [v for v, _ in sorted(got[q], key=lambda t: (-t[1], t[0]))]
        assert all(math.isclose(v, s[ids == i][0], rel_tol=1e-12) for i, v in got[q])
        hit, total = hit + len(set(best) & {v for v, _ in got[q]}), total + 20
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hit / total >= 0.9


def test_blocks_go_to_visiting_runs_only(spark):
    blocked = spark.createDataFrame([(b, 10 * b + i, [1.0]) for b in range(6) for i in range(3)], "block int, vec_id long, v array<double>")
    sought = spark.createDataFrame([(1, [1.0], 0, [0, 1]), (2, [1.0], 0, [1]), (3, [1.0], 1, [1, 4]), (4, [1.0], 2, [])], "query_id long, q array<double>, run int, blocks array<int>")
    got = sorted((r.run, r.vec_id) for r in ann.copied(blocked, sought).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 10), (0, 11), (0, 12), (1, 10), (1, 11), (1, 12), (1, 40), (1, 41), (1, 42)]
    first, count = ann._dealt({0: 3, 1: 25, 2: 4, 3: 4, 4: 9}, 5, 10)
    assert first == {0: 0, 1: 1, 2: 4, 3: 4, 4: 5} and count == {0: 1, 1: 3, 2: 1, 3: 1, 4: 1}


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(few.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.search(few, lambda i: i > 9).count() == 0
    assert ann.search(few.filter("vec_id = 0"), lambda i: i == 0).count() == 0


def test_best_first_visits_every_leaf_once():
    tree = ann.Tree(vectors(3000, 6))
    order = tree.best_first(np.ones(6), tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 10
    assert set(tree.place(vectors(500, 6, 9)).tolist()) <= set(order)


# Pipeline and registration


def test_pipeline_stages_take_effect(spark, tmp_path):
    passage = prose("fr", 90, 4)
    item = prose("en", 25, 321)
    rows = plain(40) + [(50, plain(1)[0][1], "en", "s0", 1), (51, "123 --", "en", "s1", 1), (52, None, "en", "s1", 1), (53, item + " " + prose("en", 9, 5), "en", "s2", 1)]
    rows += [(60, prose("fr", 40, 60) + " " + passage, "fr", "s1", 1), (61, prose("fr", 40, 61) + " " + passage, "fr", "s3", 1)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    ids = {r[0] for r in rows}
    assert set(kept[0]) == ids - {51, 52} and set(kept[1]) == ids - {50, 51, 52} and set(kept[2]) == set(kept[1])
    assert set(kept[3]) == set(kept[1]) - {53} and set(kept[4]) <= set(kept[3])
    assert passage not in kept[2][60] and kept[2][60].startswith(prose("fr", 40, 60)[:100]) and kept[2][3] == rows[3][1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(queries.QUERIES) <= set(names) and "op6_mixing" in __spark_entry__.oracle_sql()
