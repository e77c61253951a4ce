"""Suffix arrays and the two substring operators against brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pelagia.llm import op6_suffix_array as sa_op
from pelagia.llm import op7_substring_dedup as lsm_op
from pelagia.llm.spans import anchored, merged
from pelagia.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, lang string, h long, runs int, single boolean, kind int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 5))
def test_suffix_array(part, times):
    s = part * times
    assert suffix_array(np.array(s, np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=80), st.integers(1, 12))
def test_anchors_are_the_smallest(values, width):
    g = (np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    at, first, count = anchored(g, width)
    found = [int(a) for a, n in zip(at, count, strict=True) for _ in range(n)]
    key = lambda i: (int(g[i]) >> 21, i)
    assert found == [min(range(s, s + width), key=key) for s in range(max(0, len(g) - width + 1))]
    assert first.tolist() == [sum(count[:k]) for k in range(len(count))]


def test_merged():
    s, e = merged(np.array([30, 0, 5, 12]), np.array([1, 3, 2, 1]), 5)
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(0, 11), (12, 17), (30, 35)]


def model(rows, window, split, join):
    units = [split(t or "") for _, t in rows]
    seen: dict = {}
    for u in units:
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        gone = set()
        for k in range(len(u) - window + 1):
            if seen[tuple(u[k : k + window])] > 1:
                gone.update(range(k, k + window))
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(u), len(gone), len(spans), join([x for k, x in enumerate(u) if k not in gone])))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: rng.choice([" ", "  ", "\n"]).join(word() for _ in range(n))
    shared = [text(n) for n in (8, 30, 60, 200)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(50, None), (51, ""), (None, rows[3][1]), (None, text(90)), (3, rows[3][1]), (3, rows[3][1]), (3, text(70))]
    rows += [(60, "ab " * 400), (61, "x" * 500), (62, "ab " * 90 + text(30)), (63, (text(25) + " ") * 6)]
    edited = shared[3].split()
    for k in range(30):  # near copies with one change each
        rows.append((100 + k, " ".join(edited[:k] + ["zz"] + edited[k + 1 :])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, True, 0) for i, t in rows], SCHEMA).repartition(4)


def got(df):
    return sorted(((r["id"], r["n_units"], r["n_removed"], r["n_spans"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "most", "batches"), [(1, 2048, 1), (2, 2048, 3), (2, 3, 2)])
def test_words(spark, seed, most, batches):
    """With a small ``most`` large groups are cut into several batches."""
    rows = corpus(seed)
    found = lsm_op.remove_repeats(frame(spark, rows), window=12, gram=3, batches=batches, most=most, size=2000)
    assert got(found) == model(rows, 12, str.split, " ".join)
    spans = {(r["id"], sum(s["end"] - s["start"] for s in r["spans"])) for r in found.collect()}
    assert spans == {(r["id"], r["n_removed"]) for r in found.collect()}


@pytest.mark.parametrize(("seed", "most"), [(1, 2048), (2, 2048), (2, 3)])
def test_bytes(spark, seed, most):
    rows = corpus(seed)
    found = sa_op.remove_repeats(frame(spark, rows), window=48, gram=8, most=most, symbols=200, digest=True)
    import hashlib

    want = model(rows, 48, str.encode, bytes)
    assert got(found) == [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want]


def test_nothing_goes_without_the_suffix_array(spark):
    """With classes that are all different nothing is repeated: hashes only group."""
    rows = list({t: (i, t) for i, t in corpus(4)}.values())
    whole = sa_op.remove_repeats(frame(spark, rows), window=48, gram=8)
    assert whole.agg({"n_removed": "sum"}).first()[0] > 1000
    units = sa_op.byte_units(48, 8)
    apart = lambda runs, window=48: np.split(np.arange(sum(len(r) - window + 1 for r in runs)), np.cumsum([len(r) - window + 1 for r in runs])[:-1])
    units.classes = apart
    assert sa_op.repeated(frame(spark, rows), "doc_id", "text", units, sa_op.often, False, 2048, 4096).agg({"n_removed": "sum"}).first()[0] == 0


def test_empty(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert lsm_op.remove_repeats(none).count() == sa_op.remove_repeats(none).count() == 0


def test_index_matches_across_batches_and_compacts(spark):
    from pelagia.llm.spans import anchor_rows, counted, distinct_texts, keys_of

    u = lsm_op.word_units(12, 3)
    rows = corpus(3)
    a, b = (anchor_rows(distinct_texts(keys_of(frame(spark, part), "doc_id", "text")), u) for part in (rows[:20], rows[20:]))
    index = lsm_op.FingerprintIndex(spark, most_runs=1)
    first = {r["h"] for r in index.add(a).collect()}
    assert first == {r["h"] for r in counted(a).filter("c > 1").collect()}
    second = {r["h"] for r in index.add(b).collect()}
    both = a.unionByName(b)
    assert first | second == {r["h"] for r in counted(both).filter("c > 1").collect()}
    assert len(index.runs) == 1
    total = index.compact()
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, counted(both).collect()))
    plan = index.match(total)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.close()


def test_no_table_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    lsm_op.remove_repeats(frame(spark, corpus(5)), window=12, gram=3).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_many_copies_of_one_row(spark):
    """Copies are one text with a number: no list of all their runs."""
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**9)) for _ in range(3000))
    rows = spark.range(2000).selectExpr("id % 3 as doc_id").withColumn("text", sa_op.F.lit(text))
    for op in (sa_op, lsm_op):
        assert [tuple(r) for r in op.remove_repeats(rows).selectExpr("n_units = n_removed", "n_spans").distinct().collect()] == [(True, 1)]


def test_long_texts(spark):
    """A text of more than CHUNK bytes: runs that the chunks cut are compared like others."""
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, "xy" + body), (2, body[1_000_000:1_100_000]), (3, "other text")]
    found = {r["id"]: (r["n_removed"], r["n_spans"]) for r in sa_op.remove_repeats(frame(spark, rows)).collect()}
    assert found == {1: (100_000, 1), 2: (100_000, 1), 3: (0, 0)}
    found = {r["id"]: (r["n_spans"], r["n_units"] - r["n_removed"]) for r in lsm_op.remove_repeats(frame(spark, rows)).collect()}
    assert found[2][0] == 1 and found[2][1] <= 2 and found[3] == (0, 2)


def test_a_large_group_costs_rows_by_its_runs(spark, monkeypatch):
    """A line in 400 texts, each with its own words around it: what batches of the group tell each other is a few rows, not one for each window."""
    from pelagia.llm import spans

    rng, made, write = random.Random(31), {}, spans.staged
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = letters(70)
    rows = [(k, letters(90) + line + letters(90)) for k in range(400)]

    def counted(df, tag):
        out = write(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(spans, "staged", counted)
    found = sa_op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=48, gram=8, most=16, symbols=200).collect()
    often = collections.Counter(t[k : k + 48] for _, t in rows for k in range(len(t) - 47))
    want = {i: len({q for k in range(len(t) - 47) if often[t[k : k + 48]] > 1 for q in range(k, k + 48)}) for i, t in rows}
    assert {r["id"]: r["n_removed"] for r in found} == want and min(want.values()) >= 70
    assert made["large"] and made["solved"] <= 2 * made["runs"]


def test_passages_across_documents_at_the_limit(spark, tmp_path):
    """Passages of over 50 words in two documents each, through the registered query: of 400 bytes or more they go from both, shorter ones and those with other white space stay."""
    import hashlib

    import __spark_entry__

    rng = random.Random(51)

    def passage(size, letters="abcdefghij"):
        words = [["".join(rng.choices(letters, k=4))] for _ in range(60)]
        while len(" ".join(w[0] for w in words).encode()) < size:
            rng.choice(words)[0] += "x"
        return " ".join(w[0] for w in words)

    around = lambda mark: " ".join(mark + str(rng.randrange(10**9)) for _ in range(40))
    shared = {399: passage(399), 400: passage(400), 401: passage(401), 900: passage(900), 560: passage(560, "äöüßñ")}
    rows, want = [], {}
    for size, p in shared.items():
        assert len(p.encode()) == size and len(p.split()) == 60
        for k in (0, 1):
            head, tail = around("pq"[k]) + "-+"[k], "<>"[k] + around("rs"[k])
            rows.append((2 * size + k, head + p + tail))
            gone = size if size >= 400 else 0
            want[2 * size + k] = (len(rows[-1][1].encode()), gone, int(gone > 0), hashlib.sha256((head + ("" if gone else p) + tail).encode()).hexdigest())
    spaced = passage(450)
    for k, t in enumerate((spaced, spaced.replace(" ", "\n"))):
        rows.append((k, t))
        want[k] = (450, 0, 0, hashlib.sha256(t.encode()).hexdigest())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["op6_suffix_array_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == want
