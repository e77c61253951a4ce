"""Subword lattice likelihood.

A text is a sequence of words and one end. The model weights every segmentation of a word into pieces of an existing vocabulary, and besides gives each word
that was seen in training an arc of its own; the forward recursion sums over all of them. So, in a class of documents (a language, say),

    P(word) = a * count(word) / words + (1 - a) * sum over segmentations of the product of the piece probabilities,

with a = words / (words + distinct words), as Witten and Bell weigh the unseen. Piece probabilities start from the vocabulary's own
scores and are set by expectation maximisation over the distinct training words of the class. Words come in bursts, so a document draws from an urn over P (Polya's: a word
that came n times among t before has the probability (alpha * P(word) + n) / (alpha + t)), which needs no order. A document's probability is the sum over the classes, weighted by
their share of the training documents; its own label is not asked. The probabilities of all texts sum to one. Word probabilities are carried to seven digits.

Scale: consecutive documents form blocks of bounded size, each with its own word list. Only the lists are shuffled, compressed, by a hash of the word, and what
comes back is a count and a probability for each place of a list; so a word travels once for a block, however often it is in it, and a word that is
everywhere is one entry for each block. Documents travel as compressed (word place, times) pairs. Only the piece probabilities, as many as the
vocabulary has pieces, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, map_arrow, partitions, staged, table, texts
from .lattice import Lattice
from .op3_language import held_out

VOCABULARY, ROUNDS, BLOCK = "/opt/tokenizers/piece_bpe_32k.model", 3, 12 << 20
CLASSES, ALPHA = 7, 3000.0
#: Words of a class that a task sums over at once.
TOGETHER = 1 << 15


def packed(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes(data))


def unpacked(data: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


class Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Integers of ``width`` bytes, their bytes sorted by place, compressed. Corpus counts take eight, what a block of text bounds takes four."""
    return packed(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def from_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of positive numbers, to about 1e-10."""
    x = np.asarray(x, np.float64)
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The pieces of an existing vocabulary that can be part of a lower-cased word, and all single bytes; and log probabilities from its scores. Scores of
    merged pieces are ranks, so a piece's weight is taken as one over its rank; single bytes that are no pieces come last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in p[1:] and p == p.lower():  # A-Z alone, as texts are lower-cased
                scores[p] = model.get_score(i)
    worst = min(scores.values(), default=0) - 1
    for b in range(256):
        scores.setdefault(bytes([b]), worst)
    rank = np.array([1 - s for s in scores.values()])
    weight = 1 / (rank - rank.min() + 10)
    return [*scores], np.log(weight / weight.sum())


def blocks(docs: DataFrame, parts: int, block: int, classes: int) -> DataFrame:
    """kind 0: a block's documents (ids, held, sizes, n_tokens, places and times); kind 1: the part ``r`` of its word list with training counts
    by class. Staged. docs: id, held, cls and text.

    A block is some consecutive documents of a task with ``block`` bytes of text, or one longer document."""
    names = ["kind", "block", "r", "ids", "held", "tokens", "sizes", "a", "b"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        at, size, part = Places(), 0, TaskContext.get().partitionId()
        ids, held, cls, tokens, places, times, number = [], [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            words = [*at]
            r = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(r, kind="stable")
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            train = np.zeros((classes, len(words)), np.int64)
            for h, k, p, t in zip(held, cls, places, times, strict=True):
                if not h:
                    train[k, new[p]] += t  # the places of a document are distinct
            key = (part << 24) + number
            a, b = [], []
            for p, t in zip(places, times, strict=True):
                q = new[p]
                o = np.argsort(q)
                a.append(np.diff(q[o], prepend=0))
                b.append(t[o])
            flat = lambda x: planes(np.concatenate(x) if x else np.zeros(0, np.int64))
            rows = [(0, key, None, ids, held, tokens, [len(p) for p in places], flat(a), flat(b))]
            cut = np.searchsorted(r[order], np.arange(parts + 1))
            for k in range(parts):
                own = order[cut[k] : cut[k + 1]]
                if len(own):
                    rows.append((1, key, k, None, None, None, None, packed(b" ".join([words[i] for i in own.tolist()])), planes(train[:, cut[k] : cut[k + 1]].ravel())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for key, h, k, t in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), b.column("cls").to_pylist(), texts(b), strict=True):
                words = t.lower().split()
                p, n = np.unique(np.fromiter(map(at.__getitem__, words), np.int64, len(words)), return_counts=True)
                ids.append(key), held.append(h), cls.append(k), tokens.append(len(words) + 1), places.append(p.astype(np.int32)), times.append(n.astype(np.int32))
                size += len(t)
                if size >= block or len(ids) >= 50_000:
                    yield close()
                    at, size, number = Places(), 0, number + 1
                    ids, held, cls, tokens, places, times = [], [], [], [], [], []
        if ids:
            yield close()

    return staged(map_arrow(docs, run, "kind int, block bigint, r int, ids array<bigint>, held array<boolean>, tokens array<bigint>, sizes array<bigint>, a binary, b binary"), "blocks")


def gathered(t: pa.Table, classes: int) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """For each block's list the numbers of its words, all the words, and their training counts by class."""
    at, picks, parts = Places(), [], []
    for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
        words = unpacked(a).split()
        picks.append(np.fromiter(map(at.__getitem__, words), np.int64, len(words)))
        parts.append(from_planes(b).reshape(classes, -1))
    counts = np.zeros((classes, len(at)), np.int64)
    for i, c in zip(picks, parts, strict=True):
        counts[:, i] += c  # the words of a list are distinct
    return picks, [*at], counts


def word_counts(lists: DataFrame, classes: int) -> DataFrame:
    """Distinct training words of each part with their counts, in rows of some thousands; staged."""

    def run(t: pa.Table) -> pa.Table:
        _, words, counts = gathered(t, classes)
        seen = np.flatnonzero(counts.sum(axis=0))
        rows = [seen[i : i + 8192] for i in range(0, len(seen), 8192)]
        ints = pa.list_(pa.int64())
        return pa.table({
            "words": pa.array([packed(b" ".join([words[w] for w in x.tolist()])) for x in rows], pa.binary()),
            "counts": pa.array([planes(counts[:, x].ravel(), 8) for x in rows], pa.binary()),
            "n": pa.array([len(x) for x in rows], pa.int64()),
            "kinds": pa.array([(counts[:, x] > 0).sum(axis=1).tolist() for x in rows], ints),
            "uses": pa.array([counts[:, x].sum(axis=1).tolist() for x in rows], ints),
        })

    return staged(lists.select("r", "a", "b").groupBy("r").applyInArrow(run, "words binary, counts binary, n bigint, kinds array<bigint>, uses array<bigint>"), "words")


def expected(counts: DataFrame, pieces: list[bytes], logp: list[np.ndarray]) -> np.ndarray:
    """How often each piece is used in the distinct training words of each class, by the current probabilities: a number for each class and piece, summed on the
    executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Lattice(pieces, logp[0])
        nets, total = [one.weighted(p) for p in logp], np.zeros((len(logp), len(pieces)))
        held: list[list[bytes]] = [[] for _ in nets]  # words of a class from row after row, as many small calls cost more than few large ones
        for b in batches:
            for w, c in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                words, of = unpacked(w).split(), from_planes(c, 8).reshape(len(logp), -1)
                for k, net in enumerate(nets):
                    held[k] += [b" " + words[i] for i in np.flatnonzero(of[k]).tolist()]
                    if len(held[k]) >= TOGETHER:
                        net.log_marginals(held[k], total[k])
                        held[k] = []
        for k, net in enumerate(nets):
            net.log_marginals(held[k], total[k])
        k, some = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(some.astype(np.int32)), pa.array(total[k, some])], names=["k", "piece", "uses"])

    found = np.zeros((len(logp), len(pieces)))
    dealt = counts.select("words", "counts").repartition(partitions(counts.sparkSession))  # few bytes, much work
    for r in map_arrow(dealt, run, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).collect():
        found[r["k"], r["piece"]] = r["uses"]
    return found


def class_numbers(df: DataFrame, id_col: str, class_col: str | None, most: int):
    """A Column with each row's class, and the number of classes. The ``most`` most frequent labels of training rows are classes; all other rows,
    and those without a label, are one more, if there are any."""
    if class_col is None:
        return F.lit(0), 1
    label = F.col(f"`{class_col}`").cast("string")
    train = df.filter(~held_out(id_col, 7))
    found = train.groupBy(label.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("k").isNull(), F.desc("n"), "k").limit(most + 1).collect()
    top = [r["k"] for r in found[:most] if r["k"] is not None]
    if not top:
        return F.lit(0), 1
    others = len(top) < len(found)  # a class for the rest, if training rows are in it; else other rows count as of the first, which only held-out ones can be
    number = F.create_map(*(F.lit(x) for i, k in enumerate(top) for x in (k, i)))
    return F.coalesce(F.try_element_at(number, label), F.lit(len(top) if others else 0)), len(top) + others


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, pieces: list[bytes] | None = None, logp: np.ndarray | None = None, rounds: int = ROUNDS, block: int = BLOCK, most_classes: int = CLASSES, alpha: float | None = ALPHA
) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probabilities of the add-one word model and of
    the lattice). Learns from the rows whose crc32 of the id as text has another remainder by 7 than 2; a null id isn't held out. ``class_col`` has the training
    rows' classes; without it there is one. The ``most_classes`` most frequent are told apart. alpha: how much of the urn is there before a document
    begins (3000 words' worth is a fixed choice; between 3000 and 10000 the score hardly changes); None: words are drawn independently.

    Null and empty texts are one end. Repeated rows count each. If there is nothing to learn from, counts are zero and the vocabulary's scores alone weigh
    the pieces. An empty table gives an empty result. Other columns aren't read."""
    spark = df.sparkSession
    if pieces is None:
        pieces, logp = vocabulary()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // block))
    cls, classes = class_numbers(df, id_col, class_col, most_classes)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), cls.alias("cls"), text.alias("text")).select("id", held_out("id", 7).alias("held"), "cls", "text")
    made = blocks(docs, parts, block, classes)
    lists = made.filter("kind = 1").select("block", "r", "a", "b")
    counts = word_counts(lists, classes)
    each = [f"coalesce(sum({c}[{k}]), 0L)" for c in ("kinds", "uses") for k in range(classes)]
    seen = counts.selectExpr("coalesce(sum(n), 0L) as n", *(f"{e} as x{i}" for i, e in enumerate(each))).first()
    distinct, kinds_of, words_of = seen["n"], np.array(seen[1 : classes + 1], np.float64), np.array(seen[classes + 1 :], np.float64)
    words = int(words_of.sum())
    of_class = [0] * classes
    for r in docs.filter("not held").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect():
        of_class[r["cls"]] = r["n"]
    ends = sum(of_class)
    total, kinds = words + ends, distinct + (ends > 0)
    logps = [logp] * classes
    for _ in range(rounds if distinct else 0):
        uses = expected(counts, pieces, logps) + 0.01
        logps = [*np.log(uses / uses.sum(axis=1, keepdims=True))]
    drop(counts)
    share = np.divide(words_of, words_of + kinds_of, out=np.zeros(classes), where=words_of > 0)
    end = (ends + 0.5) / (total + 1)
    weight = np.log10((np.array(of_class) + 0.5) / (ends + 0.5 * classes))

    def looked_up(t: pa.Table) -> pa.Table:
        """For each block's part of the list: training counts, and log10 probabilities by class, in the order of the list."""
        picks, every, c = gathered(t, classes)
        p = Lattice(pieces, logps[0]).log_marginals_of([b" " + w for w in every], logps)
        for k in range(classes):
            p[k] += math.log1p(-share[k])
            n = np.flatnonzero(c[k])
            p[k, n] = np.logaddexp(p[k, n], np.log(share[k] * c[k, n] / max(1, words_of[k])))
        p = (p + math.log1p(-end)) / math.log(10)
        n = c.sum(axis=0)
        return pa.table({"block": t.column("block"), "r": t.column("r"), "c": pa.array([planes(n[i], 8) for i in picks], pa.binary()), "p": pa.array([packed(p[:, i].astype("<f4").tobytes()) for i in picks], pa.binary())})

    values = lists.groupBy("r").applyInArrow(looked_up, "block bigint, r int, c binary, p binary")
    values = values.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("r", "c", "p"))).alias("v"))  # a block's word list is bounded by its size
    own = made.filter("kind = 0").select("block", "ids", "held", "tokens", "sizes", "a", "b").join(values, "block", "left")
    norm = total + kinds + 1
    go_on = math.log1p(-end) / math.log(10)
    end_base, end_score = math.log10((ends + 1) / norm), math.log10(end)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                v = b.column("v")[i].as_py() or []
                c = np.concatenate([from_planes(x["c"], 8) for x in v] or [np.zeros(0, np.int64)]).astype(np.float64)
                p = np.concatenate([unpacked(x["p"], "<f4").reshape(classes, -1) for x in v] or [np.zeros((classes, 0))], axis=1)
                base = np.log10((c + 1) / norm)
                sizes = np.array(b.column("sizes")[i].as_py(), np.int64)
                step, t = from_planes(b.column("a")[i].as_py()).astype(np.int64), from_planes(b.column("b")[i].as_py()).astype(np.float64)
                starts = np.cumsum(sizes) - sizes
                run = np.cumsum(step)
                before = np.where(starts > 0, run[np.maximum(starts - 1, 0)], 0) if len(run) else starts * 0
                at = run - np.repeat(before, sizes)
                add = lambda x, starts=starts, sizes=sizes: np.where(sizes > 0, np.add.reduceat(np.append(x, 0.0), np.minimum(starts, len(x))), 0.0)
                known = add(t * (c[at] > 0)).astype(np.int64) + (ends > 0)
                of = np.stack([weight[k] + add(t * p[k][at]) for k in range(classes)])
                if alpha is not None:  # what an urn adds: words that came before are likelier, all others less
                    again = np.flatnonzero(t > 1)
                    drawn = add(t)
                    less = drawn * math.log10(alpha) - (log_gamma(alpha + drawn) - math.lgamma(alpha)) / math.log(10)
                    for k in range(classes):
                        # the words' own probability: p holds it with that of going on
                        log_own = math.log10(alpha) + p[k][at[again]] - go_on
                        own = 10.0**log_own
                        more = np.zeros(len(t))
                        more[again] = (log_gamma(own + t[again]) - log_gamma(own + 1)) / math.log(10) - (t[again] - 1) * log_own
                        of[k] += add(more) + less
                most = of.max(axis=0)
                score = most + np.log10((10.0 ** (of - most)).sum(axis=0)) + end_score
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(b.column("ids")[i].as_py(), pa.int64()), pa.array(b.column("held")[i].as_py()), pa.array(b.column("tokens")[i].as_py(), pa.int64()), pa.array(known), pa.array([total] * n, pa.int64()), pa.array(add(t * base[at]) + end_base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_arrow(own, summed, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), class_col="lang").withColumnRenamed("id", "doc_id")
