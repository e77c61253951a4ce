"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt into tiles of one population count each. A pair of tiles is met only if the counts differ by the radius at most,
since each differing bit changes the count by one. Inside a pair, rows are ordered by the counts of their four 16-bit quarters, and pairs of
sub-tiles whose quarter counts are further apart than the radius are skipped in the same way; the rest are compared in numpy by
exclusive-or and bit counts. No pair within the radius is missed.

A tile pair returns a spanning forest of its links, never the links themselves, so a group of n near copies costs n rows for each
pair of tiles it lies in. Copies share one fingerprint, which stands for all of them.

Scale: the comparison is exact and so quadratic in the number of distinct fingerprints (about a tenth of the pairs are compared);
tiles are sent to the square root of that many places. The README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, components, drop, keyed, map_arrow, only, staged, table, texts

RADIUS, SHINGLE, SEED, TILE, SUB = 4, 4, 42, 16384, 256
#: Rows of a tile from which one, two and three counts cut its sub-tiles.
LEAD = (512, 4096, 1 << 20)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) word shingles in order, repeats included; of fewer words the whole sequence; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns id, th (the row's key) and fp (the 64 bits as a signed long), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fps.view(np.int64))], names=["id", "th", "fp"])

    return map_arrow(keyed(df, id_col, text_col), run, "id bigint, th bigint, fp bigint")


def quarter_counts(a: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((a >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def ordered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints by their quarter counts, the starts of the sub-tiles and their end, and for each sub-tile the least and the largest counts.

    A sub-tile has SUB rows at most, and is cut where the leading counts change: none, one, two or three of them, by how many rows there are."""
    q = quarter_counts(a)
    order = np.lexsort(q.T[::-1])
    a, q = a[order], q[order]
    lead = q[:, : int(np.searchsorted(LEAD, len(a)))]
    new = np.concatenate(([True], (lead[1:] != lead[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    new |= (np.arange(len(a)) - first[np.cumsum(new) - 1]) % SUB == 0
    at = np.flatnonzero(new)
    return a, np.append(at, len(a)), np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the classes of i and j; labels holds for each node the smallest node of its class."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while (labels != (up := labels[labels])).any():
            labels = up


def links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within ``a`` (b is None) or between ``a`` and ``b``, as two arrays of fingerprints."""
    a, at, alo, ahi = ordered(a)
    (c, ct, clo, chi) = (a, at, alo, ahi) if b is None else ordered(b)
    nodes = a if b is None else np.concatenate((a, c))
    shift = 0 if b is None else len(a)
    labels = np.arange(len(nodes))
    far = np.maximum(0, np.maximum(alo[:, None] - chi[None], clo[None] - ahi[:, None])).sum(axis=2)
    for x, y in zip(*np.nonzero(far <= radius), strict=True):
        if b is None and y < x:
            continue
        s, t = a[at[x] : at[x + 1]], c[ct[y] : ct[y + 1]]
        i, j = np.nonzero(np.bitwise_count(s[:, None] ^ t[None]) <= radius)
        i, j = i + at[x], j + ct[y] + shift
        if len(i) and not (labels[i] == labels[j]).all():
            labels = forest(labels, i, j)
    tied = np.nonzero(labels != np.arange(len(nodes)))[0]
    return nodes[tied], nodes[labels[tied]]


def counts_of(fps: DataFrame) -> dict[int, int]:
    """Fingerprints by population count: 65 rows at most."""
    return {r["p"]: r["n"] for r in fps.groupBy(F.expr("cast(bit_count(fp) as int)").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}


def tile_pairs(fps: DataFrame, radius: int, tile: int, item: str = "fp") -> DataFrame:
    """Pairs (a, b) of tiles whose population counts differ by the radius at most, as arrays of ``item``; b is null for a tile with itself."""
    counted = counts_of(fps)
    chunks = F.array(*(F.lit(-(-counted.get(p, 0) // tile)) for p in range(65)))
    rows = fps.select(F.expr(item).alias("item"), F.expr("cast(bit_count(fp) as int)").alias("p"), chunks.alias("c"), "fp")
    rows = rows.select("item", "p", F.pmod(F.xxhash64("fp"), F.element_at("c", F.col("p") + 1)).cast("int").alias("k"))
    tiles = staged(rows.groupBy("p", "k").agg(F.collect_list("item").alias("items")), "tiles").withColumn("c", chunks)  # about `tile` values, evenly dealt by a hash
    # a pair has the smaller (p, k) first
    partners = "flatten(transform(sequence({a}, {b}), q -> transform(if(c[q] > 0, sequence(0, c[q] - 1), array()), l -> struct(q as q, l as l))))"
    upper = F.expr(f"filter({partners.format(a='p', b=f'least(p + {radius}, 64)')}, x -> x.q > p or x.l >= k)")
    lower = F.expr(f"filter({partners.format(a=f'greatest(p - {radius}, 0)', b='p')}, x -> x.q < p or x.l < k)")
    first = tiles.select("p", "k", "items", F.explode(upper).alias("x")).select("p", "k", F.col("x.q").alias("q"), F.col("x.l").alias("l"), F.col("items").alias("a"))
    second = tiles.select("p", "k", "items", F.explode(lower).alias("x")).select(F.col("x.q").alias("p"), F.col("x.l").alias("k"), F.col("p").alias("q"), F.col("k").alias("l"), F.col("items").alias("b"))
    return first.join(second, ["p", "k", "q", "l"], "left").select("a", "b")


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning forest (u, v) of the links between the distinct fingerprints in column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                u, v = links(np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64) if b.is_valid else None, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return map_arrow(tile_pairs(fps, radius, tile), run, "u bigint, v bigint")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row for each input row: id, th, fp, component (the smallest id reachable by links of ``radius`` bits at most) and m (the component's own
    number, which differs where ids don't).

    Null texts count as empty; all texts without words share the fingerprint zero, which links like any other. Null ids take part, but are never
    the smallest unless the component has no other. Repeated rows are members like others. An empty table gives an empty result."""
    rows = staged(fingerprints(df, id_col, text_col, shingle), "fps")
    best = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    forest_edges = staged(near_links(best.select("fp"), radius, tile), "forest")
    label = components(forest_edges)
    tied = best.join(label, best["fp"] == label["v"], "left").select("fp", F.coalesce("m", "fp").alias("m"), "least")
    least = tied.groupBy("m").agg(F.min("least").alias("component"))
    of = tied.join(least, "m").select("fp", "component", "m")
    return rows.join(of, "fp").select("id", "th", "fp", "component", "m")


def first_of_each(groups: DataFrame) -> DataFrame:
    """Keys (id, th) of one row for each component m: the one with the smallest id, null ids last."""
    return groups.groupBy("m").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th")).alias("r")).select("r.id", "r.th")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest id, once if it is repeated. All columns are kept."""
    return only(df, first_of_each(near_groups(df, id_col, text_col, radius, shingle)), id_col, text_col)


# Near copies by similarity. SimHash proposes first: sets whose fingerprints link are compared exactly. What it leaves, pairs beyond its radius among
# them, is found by an exact join of shingle sets: all pairs that can have the similarity share a shingle of their prefixes, and each of them is
# verified, unless verified pairs join its ends already.
SIMILARITY, HOT, SAMPLE, HUBS, OPEN, LIKELY = 0.8, 1 << 16, 16, (1, 4), 16, 16
KEY = ("i", "z", "th")  # a row's key (common.keyed) without nulls
#: Bytes of shingle sets that a task keeps while it compares pairs.
KEPT = 32 << 20


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, shingle))


def prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share: by hash, then the frequent ones by rank. Two sets of the similarity ``least``
    have one of them in common, as they share ``least`` times the larger set at least. hot is sorted."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        known = hot[at] == s
        s = np.concatenate((s[~known], s[known][np.argsort(rank[at[known]])]))
    return s[: prefix_size(len(s), least)]


def prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-6)) + 1 if n else 0


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their ranks from rare to frequent: of every SAMPLE-th text, HOT shingles at most. They only order the prefixes; any choice gives the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["s"])

    counted = map_arrow(docs.filter(F.pmod("th", F.lit(SAMPLE)) == 0).select("text"), run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    found = counted.filter("c > 2").orderBy(F.desc("c"), "s").limit(HOT).collect()
    hot = np.array([r["s"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def print_pairs(nodes: DataFrame, least: float, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Pairs (u, v) of nodes that fingerprints join (columns node, n, the size of its set, and fp): each node with the smallest one of its fingerprint, and the smallest ones of
    fingerprints that a spanning forest of their links joins. Without those whose sizes rule out the similarity; staged."""
    prints = staged(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("r")).select("fp", "r.*"), "prints")
    head = lambda c, k: prints.select(F.col("fp").alias(f"f{c}"), F.col("node").alias(c), F.col("n").alias(k))
    same = nodes.select(F.col("fp").alias("fu"), F.col("node").alias("v"), F.col("n").alias("k")).join(head("u", "n"), "fu").select("u", "n", "v", "k")
    linked = near_links(prints.select("fp"), radius, tile).toDF("fu", "fv").join(head("u", "n"), "fu").join(head("v", "k"), "fv").select("u", "n", "v", "k")
    fits = same.unionByName(linked).filter(f"u <> v and least(n, k) >= {least} * greatest(n, k) - 1e-6")
    found = staged(fits.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "proposed")
    drop(prints)
    return found


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILARITY, most: float = OPEN) -> DataFrame:
    """One row for each input row: id, th, component (the smallest id reachable by pairs whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``least`` at least) and m (the component's own number, which differs where ids don't).

    Rows of one shingle set (128 bits of hash) are one node. No similar pair is missed: sets of n and k shingles have at least a = least / (1 + least) * (n + k)
    in common, so the first n - a + 1 of the one and the first k - a + 1 of the other share a shingle, and all pairs that do are candidates. Those whose SimHash
    fingerprints (of the sets, so that repeats don't weigh) link are compared before all others. Then rounds that compare
    the nodes of a shingle with two of them, then with eight, join large groups first, as long as more pairs are open than ``most`` times the entries
    of the prefixes. Half of those are picked by hashes; the others have the fewest rarer shingles, so they are the least changed of a group of
    changed copies, and are similar to most of it. Then all candidates are listed: for each node the sixteen that share most with it are compared, and after that
    every other pair; each time only those whose ends aren't joined by verified pairs. Nulls,
    repeated rows and empty tables are treated as in near_groups."""
    docs = keyed(df, id_col, text_col)
    # texts move once, into a table bucketed by row key; copies of a row are one
    one_id = (F.coalesce("id", F.lit(0).cast("long")).alias("i"), F.col("id").isNull().cast("int").alias("z"))
    held = bucketed(docs.select(*one_id, "th", "text").groupBy(*KEY).agg(F.first("text").alias("text")), "held", *KEY)
    hot, rank = frequent(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in texts(batch)]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in found), np.int64).reshape(len(found), 2)
            cut = [prefix(s, hot, rank, least).tobytes() for s in found]
            fps = np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64)
            columns = [batch.column("id"), batch.column("th"), *(pa.array(np.ascontiguousarray(names[:, k])) for k in (0, 1)), pa.array(fps), pa.array([len(s) for s in found], pa.int32()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "k1", "k2", "fp", "n", "prefix"])

    mapped = map_arrow(docs, run, "id bigint, th bigint, k1 bigint, k2 bigint, fp bigint, n int, prefix binary")
    full = staged(mapped.withColumn("row", F.monotonically_increasing_id()), "sets")
    rows = staged(full.drop("prefix"), "rows")
    one = rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th", "row", "n", "fp")).alias("r"))
    nodes = staged(one.select("k1", "k2", "r.id", "r.th", F.col("r.row").alias("node"), "r.n", "r.fp").select("*", *one_id), "nodes")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            size = np.array([len(p) for p in cut], np.int64)
            repeated = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size)) for c in ("node", "n")]
            place = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in size)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *cut])), *repeated, place], names=["s", "node", "n", "p"])

    # shingles that the prefixes of two or more nodes have, with their places there
    own = full.filter("n > 0").select(F.col("row").alias("node"), "n", "prefix").join(nodes.select("node"), "node", "left_semi")
    posts = map_arrow(own, exploded, "s bigint, node bigint, n int, p int")
    shared = staged(posts.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("s"))).filter("c > 1").select("s", "node", "n", "p"), "shared")
    drop(full)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            keep = []
            for u, v, *ab in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), texts(batch, "a"), texts(batch, "b"), strict=True):
                if size > KEPT:
                    known, size = {}, 0
                for node, text in zip((u, v), ab, strict=True):
                    if node not in known:
                        known[node] = shingle_set(text, shingle)
                        size += known[node].nbytes
                x, y = known[u], known[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # sets of n and k shingles can be similar only if their sizes are near, and if they meet at places p and q before the last a - 1 shingles of each
    common = f"ceil({least / (1 + least)} * (n + k) - 1e-6)"
    fits = f"m <> l and least(n, k) >= {least} * greatest(n, k) - 1e-6 and p <= n - {common} and q <= k - {common}"

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs (u, v), the smaller first, of rows for each shingle at which two nodes met, with the number of these; staged."""
        return staged(met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("c")), "pairs")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of some staged pairs that are similar. Of each pair one text moves, to the place where the other lies."""
        sided = pairs.select("u", "v")
        for node, side in (("u", "a"), ("v", "b")):
            key = {c: c + node for c in KEY}
            of = nodes.select(F.col("node").alias(node), *(F.col(c).alias(k) for c, k in key.items()))
            sided = sided.join(of, node).join(held.select(*(F.col(c).alias(k) for c, k in key.items()), F.col("text").alias(side)), [*key.values()]).drop(*key.values())
        return staged(map_arrow(sided.select("u", "v", "a", "b"), verify, "u bigint, v bigint"), "verified")

    def labelled(found: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The components of verified pairs, the shared shingles whose nodes lie in several of them, and the pairs these have to compare."""
        label = components(found)
        of = shared.join(label.select(F.col("v").alias("node"), "m"), "node", "left").withColumn("m", F.coalesce("m", "node"))
        counted = staged(of.groupBy("s", "m").agg(F.count(F.lit(1)).alias("c")), "counted")
        several = counted.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum(F.expr("c * c")).alias("q")).filter("k > 1")
        several = staged(several.select("s", F.expr("(c * c - q) div 2").alias("pairs")), "several")
        still, work = staged(of.join(several.select("s"), "s"), "open"), several.agg(F.sum("pairs")).first()[0] or 0
        drop(counted, several)
        return label, still, work

    proposed = print_pairs(nodes.filter("n > 0").select("node", "n", "fp"), least)
    found = similar(proposed)
    drop(proposed)
    label, left, work = labelled(found)
    limit = most * shared.count()
    for several in HUBS:
        hub = lambda *first: F.struct(*first, F.col("node").alias("u"), F.col("n").alias("k"), F.col("p").alias("q"), F.col("m").alias("l"))
        by = lambda j: F.xxhash64(F.lit(j), "node").alias("h")
        picked = [x for j in range(several, 2 * several) for x in (F.min(hub(by(j))).alias(f"a{j}"), F.min(hub(F.col("p"), by(j))).alias(f"b{j}"))]
        hubs = left.groupBy("s").agg(*picked)
        hubs = staged(hubs.select("s", F.array_distinct(F.array(*(F.struct(f"{c}.u", f"{c}.k", f"{c}.q", f"{c}.l") for c in hubs.columns if c != "s"))).alias("f")), "hubs")
        star = left.select("s", F.col("node").alias("v"), "n", "p", "m").join(hubs, "s").select("v", "n", "p", "m", F.explode("f").alias("f"))
        met = candidates(star.select("f.*", "v", "n", "p", "m").filter(fits))
        new = similar(met)
        drop(met, hubs)
        found = staged(found.unionByName(new), "links")
        drop(left)
        label, left, work = labelled(found)
        if work <= limit:
            break
    # every other pair; of the smaller set (of equal ones, that of the smaller number) only the places that a set of its own size or more can meet count
    short = left.filter(f"p <= n - ceil({2 * least / (1 + least)} * n - 1e-6)")
    a, b = short.withColumnRenamed("node", "u"), left.select("s", F.col("node").alias("v"), F.col("n").alias("k"), F.col("p").alias("q"), F.col("m").alias("l"))
    pairs = candidates(a.join(b, "s").filter(f"(n < k or n = k and u < v) and {fits}"))
    drop(shared, left)
    either = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "c"))
    at = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), F.xxhash64("v"), "v"))
    first = either.withColumn("at", at).filter(F.col("at") <= LIKELY).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    likely = staged(first, "likely")
    found = staged(found.unionByName(similar(likely)), "links")
    label = staged(components(found), "label")
    of = lambda c: label.select(F.col("v").alias(c), F.col("m").alias(f"m{c}"))
    rest = pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").filter(F.coalesce("mu", "u") != F.coalesce("mv", "v"))
    rest = staged(rest.select("u", "v").join(likely, ["u", "v"], "left_anti"), "left")
    drop(pairs, likely)
    new = similar(rest)
    drop(held)
    if not new.isEmpty():
        label = components(found.unionByName(new))
    tied = nodes.join(label, nodes["node"] == label["v"], "left").select("k1", "k2", "id", F.coalesce("m", "node").alias("m"))
    least_id = tied.groupBy("m").agg(F.min("id").alias("component"))
    return rows.select("id", "th", "k1", "k2").join(tied.join(least_id, "m").select("k1", "k2", "component", "m"), ["k1", "k2"]).select("id", "th", "component", "m")


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay: of each group of near copies the row with the smallest id, once if it is repeated. All columns are kept."""
    return only(df, first_of_each(similar_groups(df, id_col, text_col, shingle, least)), id_col, text_col)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
