"""The corpus pipeline stage by stage against simple models."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        out.append((name, before.toPandas(), docs.toPandas()))
    return out


def test_columns_and_rows(stages):
    for _, before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns) and set(after.doc_id) <= set(before.doc_id)


def test_language_keeps_texts_with_letters(stages):
    _, before, after = stages[0]
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if t and any(map(str.isalpha, t))}


def test_exact(stages):
    _, before, after = stages[1]
    assert set(after.doc_id) == set(before.assign(n=before.text.str.split().str.join(" ")).groupby("n").doc_id.min())


def test_near(stages):
    from pelagia.llm.op9_simhash import shingle_hashes

    _, before, after = stages[2]
    sets = {i: set(shingle_hashes(t.encode(), 5).tolist()) for i, t in zip(before.doc_id, before.text, strict=True)}
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        changed = False
        for a in sets:
            for b in sets:
                if a < b and low[a] != low[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
        if not changed:
            break
    assert set(after.doc_id) == {i for i in low if low[i] == i}


def test_clean(stages):
    import duckdb

    _, before, after = stages[3]
    items = [" ".join(t.lower().split()) for (t,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    gone = set(before.doc_id) - set(after.doc_id)
    assert gone == {i for i, t in zip(before.doc_id, before.text, strict=True) if any(x in " ".join(t.lower().split()) for x in items)}


def test_packed(stages):
    _, before, after = stages[4]
    want = {i: len(t.split()) + 1 for i, t in zip(before.doc_id, before.text, strict=True)}
    assert after.groupby("doc_id").n_tokens.sum().to_dict() == want


def test_registered_queries_match_sql(spark):
    import duckdb

    from pelagia.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(repr(tuple(r)) for r in cur.fetchall()) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
