"""Exact dedup, SimHash groups and near copies against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pelagia.llm import op9_simhash as near
from pelagia.llm import op10_exact_dedup as exact
from pelagia.llm.common import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def odd_rows(seed=3):
    """Nulls, empty and long texts, ties, repeated rows, near copies; the other columns have names that operators use themselves."""
    rng = random.Random(seed)
    base = [words(rng, n) for n in (1, 3, 4, 5, 40, 200, 900)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \n"), (23, " "), (None, base[4]), (None, "only me"), (3, base[3]), (3, base[3]), (3, "another text of the same id")]
    rows += [(30, base[4].replace(" ", "\t\n ")), (31, " " + base[4]), (32, base[5] + " tail"), (33, base[5].upper()), (34, base[6]), (35, base[6]), (36, "x" * 30000), (37, "x" * 30000), (38, "x" * 29999 + "y")]
    return [(i, t, "en", i, 0, "c", 1.0, 7) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, id long, th int, name string, component double, level int"


def null_last(xs):
    known = [x for x in xs if x is not None]
    return min(known) if known else None


def classes(n, linked):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in linked:
        p[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(n):
        groups[root(k)].append(k)
    return groups.values()


def by_norm(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    out = []
    for r, t in zip(rows, norm, strict=True):
        same = [q[0] for q, u in zip(rows, norm, strict=True) if u == t]
        keep = null_last(same)
        out.append((r[0], keep, len(same), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_groups(spark, block):
    rows = odd_rows()
    found = exact.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block)
    assert sorted((tuple(r) for r in found.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == by_norm(rows)


def test_hot_blocks_span_ranges(spark):
    rows = [(i, "same " * 50 if i % 3 else f"own {i}", "en", 0, 0, "", 0.0, 0) for i in range(400)]
    found = exact.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), block=16)
    assert sorted((tuple(r) for r in found.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == by_norm(rows)


def test_names_when_ranges_cut_colliding_keys(spark):
    """All rows have one hash, so ranges by the hash would cut between contents."""
    rows = [(i, 7, f"block {i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, h long, block string").repartition(5)
    found = exact.named(df, ["h", "block"], "id bigint", ["h"]).collect()
    assert sorted((r["id"], r["name"]) for r in found) == [(i, i % 5) for i in range(600)]


def test_keep_first(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([0, 1, 2, 3, 3, 4, 5, 6, 20, 22, 31, 32, 33, 36, 38, None], key=repr)
    assert exact.keep_first(df.limit(0)).count() == exact.exact_groups(df.limit(0)).count() == 0


def model_print(text):
    w = re.findall(b"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_groups(spark):
    rows = odd_rows()
    found = near.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    prints = [model_print(r[1]) for r in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = [(rows[k][0], prints[k], null_last([rows[q][0] for q in g])) for g in classes(len(rows), linked) for k in g]
    assert sorted(((r["id"], r["fp"] % 2**64, r["component"]) for r in found), key=repr) == sorted(want, key=repr)
    assert near.near_groups(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [7, 64, 4096])
def test_tiles_miss_no_link(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 60, np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(5)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = {r["v"]: r["m"] for r in components(near.near_links(df, 4, tile)).collect()}
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if bin(int(fps[a]) ^ int(fps[b])).count("1") <= 4]
    for g in classes(len(fps), linked):
        values = [int(x) for x in fps.view(np.int64)[list(g)]]
        assert {label.get(v, v) for v in values} == {min(values)}


def jaccard(a, b):
    x, y = (set(near.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return 1.0 if x == y else len(x & y) / len(x | y)


def test_similar_groups(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        text = words(rng, 150 + 20 * g).split()
        rows.append((100 * g, " ".join(text)))
        for k in range(1, 6):
            copy = text[:]
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 * g + k, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "", 0, 0, "", 0.0, 0) for i, t in rows], SCHEMA)
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1] or "", rows[b][1] or "") >= 0.8]
    want = [(rows[k][0], null_last([rows[q][0] for q in g])) for g in classes(len(rows), linked) for k in g]
    found = [(r["id"], r["component"]) for r in near.similar_groups(df.repartition(4), most=0).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    kept = near.keep_one_similar(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want})


@pytest.mark.parametrize("most", [0, 16])
def test_families_about_the_similarity(spark, most):
    """Twenty families of 150 copies, each edited so that about half of the pairs reach the similarity: groups are those of all pairs."""
    rows, want = [], {}
    for seed in range(20):
        rng = random.Random(seed)
        base = [f"w{seed}x{k}" for k in range(rng.randint(60, 200))]
        family = []
        for k in range(150):
            copy = base[:]
            for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.005, 0.02)))):
                copy[at] = f"e{seed}x{rng.randrange(10**6)}"
            family.append((1000 * seed + k, " ".join(copy)))
        sets = [(i, near.shingle_set(t.encode(), 5)) for i, t in family]
        low = {i: i for i, _ in sets}

        def root(i, low=low):
            while low[i] != i:
                i = low[i]
            return i

        for a, (i, x) in enumerate(sets):
            for j, y in sets[a + 1 :]:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= 0.8 * (len(x) + len(y) - both):
                    u, v = sorted((root(i), root(j)))
                    low[v] = u
        want |= {i: root(i) for i, _ in sets}
        rows += family
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r["id"]: r["component"] for r in near.similar_groups(df, most=most).collect()} == want
    assert 20 < len(set(want.values())) < 2500


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (3, 2)]
    random.Random(1).shuffle(edges)
    label = {r["v"]: r["m"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert label == {i: 0 for i in range(1, 61)} | {1000 + k: 1000 for k in range(1, 40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def stay(spark, rows, keep=near.keep_one_similar):
    return keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()


def test_every_candidate_is_verified(spark):
    """Groups of variants of an absent text, with similarities on both sides of 0.8: a forest of the nearest pairs isn't enough."""
    rng, rows = random.Random(11), []
    for g in range(6):
        text = words(rng, 200).split()
        for k in range(40):
            copy = text[:]
            for at in rng.sample(range(200), 2 + k % 2):
                copy[at] = f"own{g}x{k}x{at}"
            rows.append((100 * g + k, " ".join(copy)))
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    want = sorted(min(rows[q][0] for q in g) for g in classes(len(rows), linked))
    assert sorted(r["doc_id"] for r in stay(spark, rows)) == want
    assert sorted({r["component"] for r in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=0).collect()}) == want


def test_a_repeated_line_makes_no_copies(spark):
    """The line decides every bit of a fingerprint that counts repeats."""
    rng = random.Random(12)
    rows = [(k, "one two three four five six seven\n" * 60 + words(rng, 100)) for k in range(12)]
    assert sorted(r["doc_id"] for r in stay(spark, rows)) == list(range(12))


def test_similar_sets_far_apart_in_bits(spark):
    """One of two texts of one set repeats a line; and short texts against the same with a word more, of which some differ in many bits."""
    rng, rows = random.Random(13), []
    for k in range(8):
        text = words(rng, 200)
        rows += [(2 * k, text), (2 * k + 1, " ".join(text.split()[:40]) + "\n" + " ".join(text.split()[:7] * 60) + "\n" + text)]
    for k in range(600):
        text = words(rng, 8)
        rows += [(100 + 2 * k, text), (101 + 2 * k, f"{text} w{k}")]
    linked = [(q, q + 1) for q in range(0, len(rows), 2) if jaccard(rows[q][1], rows[q + 1][1]) >= 0.8]
    assert len(linked) > 600
    assert {rows[b][0] for _, b in linked}.isdisjoint(r["doc_id"] for r in stay(spark, rows))


def test_pairs_at_the_very_similarity(spark):
    """Sets of n shingles within sets of 5 / 4 n, and pairs of one size that share 8 / 9 of it: similarity 0.8 to the last digit; and the same a shingle short."""
    rng, rows, linked = random.Random(17), [], 0
    for k in range(150):
        n = 4 * rng.randint(2, 60)
        body, more = words(rng, n + 4), words(rng, n // 4 + k % 2)
        rows += [(2 * k, body), (2 * k + 1, f"{body} {more}" if k % 4 < 2 else f"{more} {body}")]
    for k in range(150, 300):
        n = rng.randint(1, 25)  # 8 n shingles in common, n at each end
        body = words(rng, 8 * n + 4)
        rows += [(2 * k, f"{words(rng, n)} {body}"), (2 * k + 1, f"{body} {words(rng, n + k % 2)}")]
    want = {rows[q][0] for q in range(0, len(rows), 2)}
    for q in range(0, len(rows), 2):
        if jaccard(rows[q][1], rows[q + 1][1]) >= 0.8:
            linked += 1
        else:
            want.add(rows[q + 1][0])
    assert linked == 150
    assert {r["doc_id"] for r in stay(spark, rows)} == want


@pytest.mark.parametrize("keep", [near.keep_one, near.keep_one_similar])
def test_unrelated_texts_of_one_id_stay(spark, keep):
    """Without an id, or with the same; a copy of one of them goes."""
    rng = random.Random(14)
    own = [words(rng, 60) for _ in range(7)]
    rows = [(None, own[0]), (None, own[1]), (7, own[2]), (7, own[3]), (None, own[4]), (8, own[4]), (None, own[5]), (None, own[5]), (9, own[6])]
    got = stay(spark, rows, keep)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(None, own[0]), (None, own[1]), (7, own[2]), (7, own[3]), (8, own[4]), (None, own[5]), (9, own[6])], key=repr)


def test_staged_leaves_no_shuffle_files(spark):
    """What a staged table was made through goes with the write, not when the driver collects garbage."""
    import glob

    from pyspark.sql import functions as F

    from pelagia.llm.common import bucketed, drop, staged

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    old = files()
    df = spark.range(100_000).groupBy((F.col("id") * 7 % 50_021).alias("k")).agg(F.max("id").alias("m"))
    made = staged(df, "freed"), bucketed(df, "freed", "k")
    assert not files() - old
    assert [x.count() for x in made] == [50_021] * 2 and spark.conf.get(key, None) == before
    drop(*made)


@pytest.mark.parametrize("tile", [7, 16384])
def test_fingerprints_propose_pairs(spark, tile):
    """The proposed pairs join what fingerprints within the radius join, one a node at most; sizes too far apart are no pair."""
    rng = random.Random(21)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)] + base[:20] * 2
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(k, 100, x) for k, x in enumerate(signed)], "node long, n int, fp long")
    pairs = [(r["u"], r["v"]) for r in near.print_pairs(df, 0.8, tile=tile).collect()]
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert sorted(map(sorted, classes(len(fps), pairs))) == sorted(map(sorted, classes(len(fps), linked)))
    far = spark.createDataFrame([(0, 100, 5), (1, 79, 5), (2, 80, 5)], "node long, n int, fp long")
    assert [tuple(r) for r in near.print_pairs(far, 0.8).collect()] == [(0, 2)]


def test_similar_groups_begin_with_fingerprints(spark, monkeypatch):
    """The join only gets what the fingerprints have left: copies with a changed word in 400 are joined before it."""
    rng, rows, seen = random.Random(22), [], []
    for g in range(6):
        text = words(rng, 400).split()
        for k in range(5):
            copy = text[:]
            copy[rng.randrange(400)] = f"own{k}"
            rows.append((10 * g + k, " ".join(copy)))
    propose = near.print_pairs

    def counted(*a):
        found = propose(*a)
        seen.append(found.count())
        return found

    monkeypatch.setattr(near, "print_pairs", counted)
    assert {r["doc_id"] for r in stay(spark, rows)} == {10 * g for g in range(6)}
    assert len(seen) == 1 and seen[0] >= 12
