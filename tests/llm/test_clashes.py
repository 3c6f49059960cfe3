"""Columns that bear names which operators use inside."""

from __future__ import annotations

from docs import plain, table

from barsift.llm import maxent, mixing


def test_mixing_keeps_columns_named_like_its_own_helpers(spark):
    docs = table(spark, plain(12)).selectExpr("*", "'a' as _source", "'b' as copy", "'c' as _p")
    mixed = mixing.mix(docs)
    assert {(r._source, r.copy, r._p) for r in mixed.collect()} == {("a", "b", "c")}
    out = mixing.emitted(mixed)
    assert out.columns == [*mixed.columns, "copy_"]
    assert {r.copy for r in out.collect()} == {"b"} and out.count() == sum(r.copies for r in mixed.collect())


def test_language_model_returns_kept_columns_as_they_are(spark):
    docs = table(spark, plain(20)).selectExpr("*", "true as block", "7 as kept", "doc_id % 2 = 0 as word")
    out = maxent.score(docs, docs, keep=("block", "kept", "word", "text", "lang"))
    assert out.columns == ["doc_id", "block", "kept", "word", "text", "lang", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = out.collect()
    assert len(got) == 20 and all(r.block is True and r.kept == 7 and r.word == (r.doc_id % 2 == 0) and (r.text, r.lang) == texts[r.doc_id] for r in got)
    assert {r.doc_id: r.score for r in maxent.score(docs, docs).collect()} == {r.doc_id: r.score for r in got}
