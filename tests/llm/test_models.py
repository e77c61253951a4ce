"""Lattice likelihood, language ID, packing, decontamination, page texts and archives."""

from __future__ import annotations

import collections
import html.parser
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from pelagia.llm import op1_warc as warc
from pelagia.llm import op2_lattice_lm as lm
from pelagia.llm import op3_language as language
from pelagia.llm import op4_decontaminate as bench
from pelagia.llm import op5_html_text as pages
from pelagia.llm import op8_packing as packing
from pelagia.llm.lattice import Lattice

PIECES = [b" ", b"a", b"b", b"c", b" a", b"ab", b"bc", b"abc", b" ab"]


def every(word, pieces, p):
    """The sum over all segmentations, by listing them."""
    if not word:
        return 1.0
    return sum(q * every(word[len(x) :], pieces, p) for x, q in zip(pieces, p, strict=True) if word.startswith(x))


def test_lattice_sums_all_segmentations():
    p = np.arange(1, 10) / 45
    net = Lattice(PIECES, np.log(p))
    ws = [b" " + bytes(x) for n in range(5) for x in itertools.product(b"abc", repeat=n)] + [b" " + b"abc" * 40]
    assert np.allclose(np.exp(net.log_marginals(ws[:-1])), [every(w, PIECES, p) for w in ws[:-1]])
    a, b = np.zeros(9), np.zeros(9)
    net.log_marginals(ws[-1:], a)
    x = np.frombuffer(ws[-1], np.uint8)[None]
    assert np.allclose(net.forward(x, b), net.log_marginals(ws[-1:])) and np.allclose(a, b)


def test_lattice_expectation_maximisation_gains():
    rng = random.Random(2)
    ws = [b" " + b"".join(rng.choice([b"ab", b"abc", b"c"]) for _ in range(4)) for _ in range(200)]
    p = np.full(9, 1 / 9)
    last = -1e9
    for _ in range(4):
        uses = np.zeros(9)
        total = Lattice(PIECES, np.log(p)).log_marginals(ws, uses).sum()
        assert total > last - 1e-9
        last, p = total, (uses + 1e-6) / (uses + 1e-6).sum()


def test_lattice_without_logarithms(monkeypatch):
    """Sums of the probabilities themselves give what sums of logarithms give, words of several lengths and classes; deep strings keep to logarithms."""
    from pelagia.llm import lattice

    rng = random.Random(23)
    ws = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode() for _ in range(300)]
    p = np.array([rng.random() ** 8 + 1e-7 for _ in PIECES])
    logps = [np.log(p / p.sum()), np.log(p[::-1] / p.sum())]
    net = Lattice(PIECES, logps[0])
    assert lattice.shallow(20, logps[0]) and not lattice.shallow(lattice.LONG, logps[0] - 20)
    got, want = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    one, many = net.log_marginals(ws, got), net.log_marginals_of(ws, logps)
    monkeypatch.setattr(lattice, "DEEP", -1.0)
    assert np.allclose(one, net.log_marginals(ws, want), rtol=1e-12, atol=1e-12)
    assert np.allclose(got, want, rtol=1e-9) and got.sum() > 300
    assert np.allclose(many, net.log_marginals_of(ws, logps), rtol=1e-12, atol=1e-12)


def test_lattice_probabilities_sum_to_one():
    """All words up to a length, and what is left for longer ones."""
    p = np.array([0.2, 0.25, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
    start = {b" ", b" a", b" ab"}
    net = Lattice(PIECES, np.log(p))
    total = sum(np.exp(net.log_marginals([b" " + bytes(x) for x in itertools.product(b"abc", repeat=n)])).sum() for n in range(9))
    share = sum(q for x, q in zip(PIECES, p, strict=True) if x in start)
    assert total < 1 and total > 1 - (1 - share) ** 3


def test_scores(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the cat SAT on a mat tat".split()) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the Cat"), (5, rows[5][1]), (5, rows[5][1]), (102, "z" * 700 + " the\tzebra")]
    df = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, id int, held boolean").repartition(3)
    found = lm.score_texts(df, pieces=[bytes([b]) for b in range(256)] + [b" the", b"at"], logp=np.full(258, -math.log(258)), rounds=2, block=200).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows]
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    one = {r["id"]: r["score"] for r in found}
    assert one[102] < one[101] == one[100] and lm.score_texts(df.limit(0), rounds=1).count() == 0


def test_score_of_a_word_is_the_mixture(spark):
    df = spark.createDataFrame([(1, "ab ab b"), (4, "ab"), (9, "ba")], "doc_id long, text string")
    train = [i for i in (1, 4, 9) if zlib.crc32(str(i).encode()) % 7 != 2]
    pieces = [bytes([b]) for b in range(256)]
    found = {r["id"]: r for r in lm.score_texts(df, pieces=pieces, logp=np.full(256, -math.log(256)), rounds=0, alpha=None).collect()}
    texts = {1: ["ab", "ab", "b"], 4: ["ab"], 9: ["ba"]}
    c = collections.Counter(w for i in train for w in texts[i])
    words, share = sum(c.values()), sum(c.values()) / (sum(c.values()) + len(c))
    end = (len(train) + 0.5) / (words + len(train) + 1)
    p = lambda w: share * c[w] / words + (1 - share) * 256.0 ** -(len(w) + 1)
    for i, ws in texts.items():
        assert found[i]["score"] == pytest.approx(sum(math.log10(p(w) * (1 - end)) for w in ws) + math.log10(end))


def test_urn_is_a_draw_by_draw_product(spark):
    """A word that came n times among t before has the probability (alpha * p + n) / (alpha + t)."""
    rows = [(1, "ab ab b"), (4, "ab zz zz ab zz"), (9, "ba"), (10, "q" * 300 + " ab " + "q" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces, alpha = [bytes([b]) for b in range(256)], 5.0
    found = {r["id"]: r["score"] for r in lm.score_texts(df, pieces=pieces, logp=np.full(256, -math.log(256)), rounds=0, alpha=alpha).collect()}
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for ws in train for w in ws)
    words, share = sum(c.values()), sum(c.values()) / (sum(c.values()) + len(c))
    end = (len(train) + 0.5) / (words + len(train) + 1)
    p = lambda w: share * c[w] / words + (1 - share) * 256.0 ** -(len(w) + 1)
    for i, t in rows[:3]:
        total, seen = math.log10(end), collections.Counter()
        for n, w in enumerate(t.split()):
            total += math.log10((alpha * p(w) + seen[w]) / (alpha + n) * (1 - end))
            seen[w] += 1
        assert found[i] == pytest.approx(total, rel=1e-6)
    assert math.isfinite(found[10])


def test_log_gamma():
    x = np.array([1e-9, 1e-3, 0.5, 1, 2, 3.7, 50, 3000, 1e7])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-9)


def test_vocabulary_keeps_all_pieces_that_words_can_have():
    import os

    if not os.path.exists(lm.VOCABULARY):
        pytest.skip("the tokenizer files aren't here")
    pieces, logp = lm.vocabulary()
    assert set(bytes([b]) for b in range(256)) <= set(pieces) and len(set(pieces)) == len(pieces) and max(map(len, pieces)) > 16
    assert math.isclose(np.exp(logp).sum(), 1) and logp[pieces.index(b" of")] > logp[pieces.index("梦".encode())]
    assert all(p == p.lower() and b" " not in p[1:] for p in pieces if len(p) > 1)


def test_classes_are_summed(spark):
    """Each document's probability is the weighted sum over the classes, whatever its own label."""
    rows = [(i, t, k) for i, (t, k) in enumerate([("aa bb aa", "x"), ("cc dd", "y"), ("cc cc", "y"), ("aa dd", None), ("bb", "x"), ("zz aa", "y"), ("aa", "w"), ("cc", "x")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = [bytes([b]) for b in range(256)]
    found = {r["id"]: r["score"] for r in lm.score_texts(df, class_col="lang", pieces=pieces, logp=np.full(256, -math.log(256)), rounds=0, most_classes=2, alpha=None).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    top = [k for k, _ in sorted(collections.Counter(r[2] for r in train if r[2]).items(), key=lambda x: (-x[1], x[0]))[:2]]
    groups = [[r for r in train if r[2] == k] for k in top] + [[r for r in train if r[2] not in top]]
    tokens = sum(len(r[1].split()) + 1 for r in train)
    end = (len(train) + 0.5) / (tokens + 1)
    for i, t, _ in rows:
        p = 0.0
        for g in groups:
            c = collections.Counter(w for r in g for w in r[1].split())
            n, a = sum(c.values()), sum(c.values()) / (sum(c.values()) + len(c))
            q = (len(g) + 0.5) / (len(train) + 1.5) * end
            for w in t.split():
                q *= (a * c[w] / n + (1 - a) * 256.0 ** -(len(w) + 1)) * (1 - end)
            p += q
        assert found[i] == pytest.approx(math.log10(p), rel=1e-5)


def labelled(rng, n):
    syllables = {"xx": "ka ti mo ru".split(), "yy": "sch ung eit ver".split(), "zz": "ció ado ñas que".split()}
    return [(k, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 90))), lang) for k, (lang, s) in enumerate(rng.choice(list(syllables.items())) for _ in range(n))]


def test_language(spark):
    rows = labelled(random.Random(1), 400)
    df = spark.createDataFrame([(*r, "score") for r in rows], "doc_id long, text string, lang string, score string")
    net = language.fit(df.filter(~language.held_out("doc_id", 4)), "text", "lang", "doc_id")
    odd = [(1000, None, None, ""), (1001, "", None, ""), (1002, "123 ... !!", "xx", ""), (None, "kati moru", None, ""), (3, rows[3][1], "yy", ""), (3, rows[3][1], "yy", "")]
    found = language.predict(df.unionByName(spark.createDataFrame(odd, df.schema)), net).collect()
    assert len(found) == 406 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 400]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {1000, 1001, 1002}
    assert language.fit(df.limit(0), "text", "lang", "doc_id") is None
    assert {r["lang_pred"] for r in language.predict(df, None).collect()} == {"und"}
    assert language.predict(df.limit(0), net).count() == 0


def test_windows_hold_the_whole_text():
    for n in (1, 255, 256, 257, 1000):
        t = bytes(range(65, 91)) * 50
        w = language.windows_of(t[:n])
        assert w.tobytes()[:n] == t[:n].lower() and len(w) == -(-n // 256)


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= k) - k) for k, n in histogram.items())


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    h = {rng.randint(1, 40): rng.randint(1, 50) for _ in range(12)}
    for k in range(1, 6):
        best = min(padding(h, (*c, max(h))) for n in range(min(k, len(h))) for c in itertools.combinations(sorted(h)[:-1], n))
        ends = packing.boundaries(h, k)
        assert padding(h, ends) == best and len(ends) <= k and ends == sorted(ends)
    assert packing.boundaries({}, 3) == []


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 70)) for i in range(300)] + [(None, None), (400, ""), (5, "w w"), (5, "w w"), (401, "long " * 1000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, piece int, bucket int, batch int").repartition(4)
    found = packing.pack(df, max_tokens=64, buckets=4, budget=256).collect()
    want = collections.Counter((i, min(64, len((t or "").split()) + 1 - 64 * k), k) for i, t in rows for k in range(-(-(len((t or "").split()) + 1) // 64)))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["piece"]) for r in found) == want
    for (bucket, _), rs in itertools.groupby(sorted(found, key=lambda r: (r["bucket"], r["batch"], r["slot"])), key=lambda r: (r["bucket"], r["batch"])):
        rs = list(rs)
        assert [r["slot"] for r in rs] == list(range(len(rs))) and len(rs) * bucket <= 256
        assert all(r["n_tokens"] + r["padding"] == bucket for r in rs)
    for bucket in {r["bucket"] for r in found}:
        own = sorted((r for r in found if r["bucket"] == bucket), key=lambda r: (r["batch"], r["slot"]))
        assert [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=lambda i: (i is not None, i or 0))
        sizes = collections.Counter(r["batch"] for r in found if r["bucket"] == bucket)
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == 256 // bucket for k in range(len(sizes) - 1))
    assert packing.pack(df.limit(0)).count() == 0


def words(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def test_contaminated(spark):
    rng = random.Random(6)
    items = [(k, words(rng, n)) for k, n in enumerate((1, 3, 5, 20, 40, 60, 60))]
    items[6] = (6, items[5][1])  # a tie
    docs = [(i, words(rng, rng.randint(0, 300))) for i in range(60)]
    leak = lambda w, item, at: w[:at] + item + w[at:]
    docs += [(100, leak(words(rng, 90), items[4][1], 0)), (101, leak(words(rng, 90), items[5][1], 90)), (102, items[3][1]), (103, [x.upper() for x in leak(words(rng, 30), items[4][1], 9)])]
    edited = items[5][1][:]
    edited[30] = "changed"
    docs += [(104, leak(words(rng, 50), edited, 20)), (105, items[4][1] * 3), (106, items[5][1][:55]), (None, items[3][1]), (107, items[3][1]), (107, items[3][1])]
    rows = [(i, "\n ".join(w)) for i, w in docs] + [(200, None), (201, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, similarity int").repartition(4)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(90, None), (91, " ")], "item_id long, text string")

    def model(text, item):
        """The best window by trying all."""
        w, k = (text or "").lower().split(), min(5, len(item))
        size = min(len(item), len(w))
        found = [(bench.similarity([x.encode() for x in w[s : s + size]], [x.encode() for x in item], k), -s) for s in range(len(w) - size + 1)] if size >= k else []
        q, s = max(found, default=(0, 0))
        return (q, -s, size) if q >= 0.8 else None

    want = [(i, k, round(m[0], 9), m[1], m[2]) for i, t in rows for k, item in items if (m := model(t, item))]
    for block_words in (200_000, 30):  # one block, and several
        found = bench.contaminated(df, b, block_words=block_words).collect()
        assert sorted(((r["id"], r["item_id"], round(r["similarity"], 9), r["first_word"], r["n_words"]) for r in found), key=repr) == sorted(want, key=repr)
    bad = {i for i, *_ in want}
    assert {100, 101, 102, 103, 104, 105, 106, 107, None} <= bad
    clean = bench.keep_clean(df, b)
    assert clean.columns == df.columns and sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)
    assert bench.contaminated(df.limit(0), b).count() == bench.contaminated(df, b.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    b = bench.Benchmark([(k, " ".join(words(random.Random(k), 30))) for k in range(50)], radius=20)
    for fp in rng.integers(0, 2**63, 200).astype(np.uint64):
        assert b.near(fp).tolist() == [i for i, p in enumerate(b.prints) if bin(int(p) ^ int(fp)).count("1") <= 20]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body>
<header><a href=/>Home</a> The site</header><nav><ul><li><a href=x>The menu of the site</a></ul></nav>
<div id="cookie-notice">We use cookies and it is for you to be sure that we have them on all of the pages.</div>
{}
<div class="comments"><p>I think that this is the best of all that I have read, and it is for you and the others.</p></div>
<div id=sidebar><p>Related: the stories that you have not read and that are of the same kind as this one.</p></div>
<form>Subscribe to the list <input></form><footer>&copy; 2024 The site</footer></body></html>"""
ARTICLE = "<h1>Title &amp; more</h1><p>This is the text of the article, and it is long enough to be decided by\n the rules as it stands.</p><p>Short.</p><!-- <p>no</p> --><p>*** XQZ %% VVRR ** long block without a single word that is frequent anywhere ***</p><p title='a>b'>The end of it is here, and <a href=y>a link</a> is in the middle of the words that are kept.</p>"
TEXT = "Title & more\n\nThis is the text of the article, and it is long enough to be decided by the rules as it stands.\n\nShort.\n\n*** XQZ %% VVRR ** long block without a single word that is frequent anywhere ***\n\nThe end of it is here, and a link is in the middle of the words that are kept."


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div role='main'>{}</div>", "<article>{}<aside>More of the same</aside><div class='ad'>Buy the thing that is new</div></article>", "<div class='page with-sidebar no-comments'><article class='post has-sidebar'>{}</article></div>", "<div class='sidebar-right'><main id='content'>{}</main></div>", "<article>{}<div class='alert'>You have read all of the articles that are free</div></article><article class='comment'><p>It is the best of all the texts that I have read.</p></article>"])
def test_main_text(frame):
    assert pages.main_text(PAGE.replace("{}", frame.replace("{}", ARTICLE)).replace("if(a<b){", "if(a<b){")) == TEXT


@pytest.mark.parametrize("after", ["<ul><li><a href=a>Первая ссылка</a></li><li><a href=b>Вторая ссылка</a></li></ul>", "<p>© 2024</p>"])
def test_main_text_of_another_language(after):
    """Its stop words aren't known; a list of links, or a line of rights, is the only block that is decided by itself."""
    body = ["Старый маяк", "Маяк на северном берегу построили рыбаки, и каждую осень его огонь видели корабли далеко в открытом море.", "Теперь внутри небольшой музей, куда летом приезжают школьники из соседних деревень и приморских городов."]
    text = pages.main_text(f"<body><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p>{after}</body>")
    assert text == "\n\n".join(body)



@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>x<!-- open", "x"), ("<p>x</p><a href='", "x"), ("a<br>b<br><br>c", "a b\n\nc"), ("<p>1 < 2 &lt; 3&nbsp;</p>", "1 < 2 < 3"), ("<article><p>Hm.</p></article>", "Hm."), ("<script>x", ""), ("<b>a</b>b", "ab")],
)
def test_small_pages(page, text):
    assert pages.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Text that is in the article.</p><img alt='%s > leaked words'><p>And this.</p></article>" % ("x" * 70_000), "Text that is in the article.\n\nAnd this."),
        ("<article><p>The keeper of the light wrote in the log.</p><p>See <a href=r>the long report of the board on the state of all the lights of the coast</a>.</p></article>", "The keeper of the light wrote in the log.\n\nSee the long report of the board on the state of all the lights of the coast."),
        ("<article><p>The keeper of the light wrote in the log.</p><ol><li><a href=a>Smith 2001, Ships</a><li><a href=b>Jones 2004, Lights</a></ol></article>", "The keeper of the light wrote in the log.\n\nSmith 2001, Ships\n\nJones 2004, Lights"),
        ("<article><div class='register-of-ships'><p>Anna, 1902</p></div><h2 class='share-price'>Shares</h2><div class='share-buttons'>Post it</div><div class=cookieNotice>Take one</div></article>", "Anna, 1902\n\nShares"),
        ("<main><h2 class=promotion-of-captains>Captains</h2><p>It is the list of those who were there.</p><div id=social-links>Follow</div></main>", "Captains\n\nIt is the list of those who were there."),
        ("<ul><li><a href=a>Главная</a><li><a href=b>Новости</a></ul><p>" + "Маяк построили рыбаки, и каждую осень его огонь видели корабли в море. " * 3 + "</p><ul><li><a href=c>Контакты</a></ul>", "Маяк построили рыбаки, и каждую осень его огонь видели корабли в море. " * 2 + "Маяк построили рыбаки, и каждую осень его огонь видели корабли в море."),
        ("<ul><li><a href=a>Главная</a></ul><p>" + "Маяк построили рыбаки, и каждую осень его огонь видели корабли в море. " * 3 + "</p><ul><li><a href=c>Контакты</a></ul><p>This is the one text of the page that is in a language that is known to it, and it is long.</p>", ("Маяк построили рыбаки, и каждую осень его огонь видели корабли в море. " * 3).strip() + "\n\nThis is the one text of the page that is in a language that is known to it, and it is long."),
    ],
)
def test_nothing_of_the_article_is_dropped(page, text):
    assert pages.main_text(page) == text


SENTENCES = {
    "en": "the keeper of the light saw that all of the ships were in the harbour and that it was late",
    "de": "der Wärter auf dem Turm sah die Schiffe und das Meer und es war nicht mehr die Zeit für sie",
    "ru": "смотритель маяка видел корабли далеко в море и зажигал огонь каждую ночь до самого рассвета",
    "tr": "fener bekçisi her gece uzakta gemileri görür ve sabaha kadar ışığı yakardı denizin kıyısında",
}


class Reference(html.parser.HTMLParser):
    """Another way to the text, for well-formed pages: a stack of elements, and marks put there by the builder (x-boiler) instead of rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in pages.BLOCK:
            self.cut()
        if tag not in pages.VOID:
            self.stack.append((tag, ("x-boiler", "1") in attrs or tag in ("script", "style", "title")))
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in pages.BLOCK:
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        if not any(b for _, b in self.stack):
            self.now.append(data)


def built(rng, wrap):
    """A page with marks on what isn't the article; the marks are taken out before it is read by rules."""
    sentence = lambda lang, n: ". ".join(" ".join(rng.sample(SENTENCES[lang].split(), 12)) for _ in range(n)) + "."
    lang, m = rng.choice([*SENTENCES]), " x-boiler=1"
    link = lambda t: f'<a href="/{rng.randint(1, 99)}?a=1&amp;b=2">{t}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link(' '.join(rng.sample(SENTENCES[lang].split(), 2)))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
    junk = [
        lambda: f"<nav{m}>{menu()}</nav>",
        lambda: f"<div class='ad-slot'{m}>{sentence(lang, 1)}</div>",
        lambda: f"<aside{m}><h3>More</h3><p>{sentence(lang, 2)}</p></aside>",
        lambda: f"<div id=comments{m}><p>{sentence(lang, 2)}</p></div>",
        lambda: f"<div class='newsletter-box'{m}><form>{sentence(lang, 1)}<input></form></div>",
        lambda: "<script>if (a < b) { document.write('<p>no</p>') }</script>",
        lambda: f"<div class=cookieBanner role=dialog{m}>{sentence(lang, 1)}</div>",
    ]
    good = [
        lambda: f"<p>{sentence(lang, rng.randint(1, 4))}</p>",
        lambda: f"<h2>{sentence(lang, 1)}</h2>",
        lambda: f"<p>{sentence(lang, 1)[:-1]} {link(sentence(lang, 1))}</p>",
        lambda: f"<blockquote><p>{sentence(lang, 1)}</p>5 &lt; 6 &amp; 7 &gt;&nbsp;2</blockquote>",
        lambda: "<ul>" + "".join(f"<li>{sentence(lang, 1)}</li>" for _ in range(3)) + "</ul>",
        lambda: f"<table><tr><td>{rng.randint(1, 999)}</td><td>{sentence(lang, 1)}</td></tr></table>",
        lambda: f"<div class='{rng.choice(['register-of-ships', 'share-price', 'login-history-of-crew'])}'><p>{sentence(lang, 1)}</p></div>",
        lambda: f"<p><b>{sentence(lang, 1)}</b><br>{sentence(lang, 1)}<img alt='a > b'></p>",
    ]
    body = "".join(rng.choice(good)() if rng.random() < 0.8 else rng.choice(junk)() for _ in range(rng.randint(3, 12)))
    around = lambda: "".join(rng.choice(junk)() for _ in range(rng.randint(0, 3)))
    return f"<html><head><title>T</title></head><body><header{m}>{menu()}</header>{around()}{wrap.format(f'<h1>{sentence(lang, 1)}</h1>{body}')}{around()}<footer{m}>&copy; {sentence(lang, 1)}</footer></body></html>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<main><article class=post>{}</article></main>"])
def test_pages_built_with_marks(wrap):
    for seed in range(60):
        page = built(random.Random(seed), wrap)
        ref = Reference()
        ref.feed(page)
        ref.cut()
        assert pages.main_text(page.replace(" x-boiler=1", "")) == "\n\n".join(ref.blocks), seed


def test_pages_without_end():
    for x in ("<p><b>x" * 20000, '<a "' * 30000, "<div>" * 20000 + "x", "<" * 50000):
        pages.main_text(x)


def test_extract(spark):
    rows = [(1, "u", PAGE.replace("{}", ARTICLE)), (2, None, None), (None, "u", ""), (1, "u", PAGE.replace("{}", ARTICLE))]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = pages.extract(df).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (1, "u", TEXT, len(TEXT))], key=repr)
    assert pages.extract(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(0)
    for _ in range(300):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_give_back_every_byte(spark, tmp_path):
    big = "line\r\n\r\nmore\n\n" * 9000
    rows = [(1, "http://www.b.example.org/x?q=1#f", "p" * 200), (2, "https://a.example.org:80/", "p" * 200), (3, None, None), (4, "http://a.example.org/b c\n", ""), (5, "http://a.example.org/", big), (6, "x", "\r\n\r\n"), (7, "x", "\n"), (8, "x", "é\0\r"), (9, "x", "WARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    rows += [(0, "http://www.b.example.org/x?q=1", "p" * 200), (0, "http://c.example.org", "p" * 200), (None, "n", "p" * 200), (None, "n", "lone " * 50), (10, "x", "short"), (11, "x", "short")]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], "page_id long, url string, html string, bytes int, digest string").repartition(3)
    warc.write_archives(df, str(tmp_path / "a"))
    found = warc.read_archives(spark, str(tmp_path / "a"))
    got = sorted((repr(r["id"]), r["type"], bytes(r["payload"]).decode() if r["payload"] is not None else None, r["refers_to"]) for r in found.collect())
    again = [(i, t) for i, _, t in rows if t == "p" * 200 and i != 0]
    want = [(repr(i), "revisit" if (i, t) in again else "response", None if (i, t) in again else t or "", 0 if (i, t) in again else None) for i, _, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    index = sorted(warc.merged_index(found.drop("payload")).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in index] == list(range(len(rows)))
    order = [(r["key"], r["date"], r["id"] is not None, r["id"] or 0) for r in index]
    assert len(index) == len(rows) and order == sorted(order)
    assert {r["key"] for r in index if r["id"] in (0, 1)} == {"org,example,b)/x?q=1", "org,example,c)"}
    full = warc.resolved(found.drop("payload")).collect()
    assert {r["bytes"] for r in full if r["type"] == "revisit"} == {200}
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_histories_come_from_the_merge(spark, tmp_path):
    """Keys that many runs and several ranges hold; a run's own order alone gives other histories."""
    rng = random.Random(7)
    rows = [(i, f"http://{'hot' if i % 3 else rng.choice('abcdefgh')}.example.org/{rng.randint(0, 1)}", "x" * rng.randint(0, 5)) for i in range(500)] + [(None, "http://hot.example.org/1", "n")]
    rng.shuffle(rows)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), str(tmp_path / "a"))
    captures = warc.staged(warc.read_archives(spark, str(tmp_path / "a"), payloads=False).drop("payload"), "c")
    assert captures.select("file").distinct().count() > 3
    got = {r["id"]: (r["position"], r["capture"], r["previous"]) for r in warc.merged_index(captures).collect()}
    key = lambda u: "org,example," + u.split("/")[2].split(".")[0] + ")/" + u.rsplit("/", 1)[1]
    last: dict = {}
    order = sorted(rows, key=lambda r: (key(r[1]), r[0] or 0, r[0] is not None))
    for at, (i, u, _) in enumerate(order):
        n, before = last.get(key(u), (0, None))
        assert got[i] == (at, n + 1, before)
        last[key(u)] = (n + 1, i)


def test_offsets_lead_to_the_records(spark, tmp_path):
    import gzip
    import urllib.parse

    rows = [(i, f"http://a.org/{i}", "é\n" * i) for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "a"))
    for r in warc.read_archives(spark, str(tmp_path / "a")).collect():
        data = gzip.open(urllib.parse.urlparse(r["file"]).path).read()[r["offset"] : r["offset"] + r["length"]]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and f"<urn:capture:{r['id']}>".encode() in data and data.count(b"WARC/1.1") == 1


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload " * 30)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"))
    text = "\n".join(r[0] for r in spark.read.option("lineSep", "\n").text(str(tmp_path / "a")).collect()) + "\n"
    for name, bad in (("cut", text[:-40]), ("changed", text.replace("payload pay", "payload PAY", 1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(bad.encode())
        with pytest.raises(Exception, match="cut short|differs|doesn't end"):
            warc.read_archives(spark, str(tmp_path / name)).collect()
    (tmp_path / "cut" / "x.warc").write_bytes(text.encode() * 20000)
    with pytest.raises(ValueError, match="must be gzipped"):
        warc.read_archives(spark, str(tmp_path / "cut"))
