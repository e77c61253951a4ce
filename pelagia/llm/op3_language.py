"""Language identification with a byte convolutional network in numpy.

Texts are cut into fixed windows of bytes (A-Z lower-cased), all of them, to the end. Each byte has a learned vector; filters two, three and
four bytes wide run over the window, the maximum of each filter over the window is kept, and a softmax layer gives the probabilities.
A document's probabilities are the mean of its windows', weighted by their bytes.

Scale: training uses a bounded sample (``per_lang`` documents a language, about, with four windows each, picked by a hash) on the driver; prediction is one
scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_arrow, table

WINDOW, WIDTHS, FILTERS, DIM, CHUNK = 256, (2, 3, 4), 16, 6, 64


@dataclass
class ByteCnn:
    langs: list[str]
    emb: np.ndarray  # 256 x DIM
    conv: np.ndarray  # (max width * DIM) x filters; narrow filters have zeros at the end
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (n, WINDOW, K) and filter values (n, WINDOW, filters)."""
        n, w = len(windows), WIDTHS[-1]
        e = np.zeros((n, WINDOW + w - 1, DIM), np.float32)
        e[:, :WINDOW] = self.emb[windows]
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, WINDOW, w * DIM), (s[0], s[1], s[2]))
        return patches, (patches.reshape(-1, w * DIM) @ self.conv).reshape(n, WINDOW, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax for rows of WINDOW bytes."""
        found = np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), CHUNK):
            hidden = np.maximum(self.pooled(windows[at : at + CHUNK])[1].max(axis=1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            found[at : at + CHUNK] = z / z.sum(axis=1, keepdims=True)
        return found


def windows_of(text: bytes) -> np.ndarray:
    """All of the text in rows of WINDOW bytes, the last one filled with zeros."""
    rows = -(-len(text) // WINDOW)
    return np.frombuffer(text.lower().ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
    """Adam on cross entropy; the gradient of max pooling reaches only the patch that won."""
    rng = np.random.default_rng(seed)
    w, n_out = WIDTHS[-1], FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(w * DIM) < k * DIM)[:, None], FILTERS, axis=1) for k in WIDTHS], axis=1)
    p = [rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.3, (w * DIM, n_out)) * mask, np.zeros(n_out), rng.normal(0, 0.3, (n_out, len(langs))), np.zeros(len(langs))]
    p = [x.astype(np.float32) for x in p]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick], labels[pick]
            net = ByteCnn(langs, *p)
            patches, values = net.pooled(x)
            best = values.argmax(axis=1)  # (n, filters)
            rows = np.arange(len(x))[:, None]
            top = values[rows, best, np.arange(n_out)[None]] + p[2]
            hidden = np.maximum(top, 0)
            z = hidden @ p[3] + p[4]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(x)), y] -= 1
            d /= len(x)
            dh = (d @ p[3].T) * (top > 0)
            won = patches[rows, best]  # (n, filters, K)
            g_conv = np.einsum("nf,nfk->kf", dh, won) * mask
            g_emb = np.zeros_like(p[0])
            spread = (dh[:, :, None] * p[1].T[None]).reshape(len(x), n_out, w, DIM)
            padded = np.pad(x, ((0, 0), (0, w - 1)))
            for k in range(w):
                inside = (best + k < WINDOW)[:, :, None]
                np.add.at(g_emb, padded[rows, best + k], spread[:, :, k] * inside)
            grads = [g_emb, g_conv, dh.sum(axis=0), hidden.T @ d + 1e-4 * p[3], d.sum(axis=0)]
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = (p[i] - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteCnn(langs, *p)


def fit(df: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int = 800, per_doc: int = 4) -> ByteCnn | None:
    """A network from the labelled rows of ``df``: of each language about ``per_lang`` documents, picked by a hash of id and text, with ``per_doc``
    windows each from places all over the text. None if no row has a label and a text."""
    df = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("lang")).filter("lang is not null and t <> ''")
    counts = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))))
    some = df.filter(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * F.lit(1 << 20))
    cut = F.expr(f"transform(sequence(1, {per_doc}), k -> substring(cast(t as binary), 1 + cast(pmod(xxhash64(i, k), greatest(1, octet_length(t) - {WINDOW - 1})) as int), {WINDOW}))")
    rows = some.select("lang", cut.alias("w")).collect()
    x = np.concatenate([windows_of(bytes(w)) for r in rows for w in dict.fromkeys(map(bytes, r["w"]))] or [np.zeros((0, WINDOW), np.uint8)])
    y = np.array([langs.index(r["lang"]) for r in rows for _ in dict.fromkeys(map(bytes, r["w"]))])
    return train(x, y, langs) if len(x) else None


def predict(df: DataFrame, net: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the mean probability, 0 to 1); ``und`` and 0 if the text is null or has no letter, or nothing was learned.
    Columns of these names are replaced; all others stay. Rows keep their number, repeated ones too."""
    df = df.drop("lang_pred", "score")
    schema = StructType([*df.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = [f.name for f in schema]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            some = [(i, t.encode()) for i, t in enumerate(b.column(at).to_pylist()) if net and t and any(map(str.isalpha, t))]
            while some:
                taken, size = 0, 0  # whole documents, of about 4 MB
                while taken < len(some) and size < 1 << 22:
                    size += len(some[taken][1])
                    taken += 1
                part, some = some[:taken], some[taken:]
                rows = [windows_of(t) for _, t in part]
                p = net.probabilities(np.concatenate(rows))
                weight = np.concatenate([np.minimum(WINDOW, len(t) - WINDOW * np.arange(len(r))) for (_, t), r in zip(part, rows, strict=True)])
                starts = np.cumsum([0, *map(len, rows[:-1])])
                mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                for (i, _), q in zip(part, mean, strict=True):
                    langs[i], scores[i] = net.langs[int(q.argmax())], min(1.0, float(q.max()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return map_arrow(df, run, schema)


def held_out(id_col: str, mod: int):
    """Rows with crc32 of the id as text of remainder 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % mod == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(~held_out("doc_id", 4)), "text", "lang", "doc_id")
    return predict(docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
