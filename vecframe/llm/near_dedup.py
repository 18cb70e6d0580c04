"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

A text is a weighted set of its shingles (runs of five words): count times inverse document frequency. The
frequencies come from all documents through a count-min sketch of fixed size, so what is broadcast is bounded;
a shingle's frequency is off by about its bucket's load, a fixed fraction of the documents at every size.
Improved consistent weighted sampling draws samples that two sets share with the probability of their weighted
Jaccard similarity; samples are banded, and texts that share a band are candidates, verified by that similarity.

Small buckets list their pairs. In large ones, texts are first compared with one leader, not with each other, and the
classes (connected components of all links so far) are found. What is left there are texts outside of the largest
class of their bucket; each is compared with all texts of the bucket that are not of its class, in tiles of a bounded
number of texts and shingles, spread over the tasks: a tile compares the samples of its texts as arrays, verifies what
is alike in bulk, and hands on only links that join two classes, fewer than it has texts. So pairs are never rows
within large groups, and every two texts of a bucket are in one class or have been compared.

Defined results: equal texts are one class (null is the empty text); a text without words is near no other text;
one of fewer than five words is a single shingle; null ids lose against any id; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name, text_or_empty
from vecframe.llm.decontamination import words_of
from vecframe.session import ship, write_and_read

SHINGLE, SIMILAR = 5, 0.8
# How much heavier the rarest shingles are than the commonest. Kept small, so that 0.8 means nearly the same for
# weighted and for plain sets: an edit is rare by nature and would else weigh more than the text it is made to.
SPREAD = 0.25
# A pair of similarity s is found with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8, 0.9999 at 0.85.
BANDS, ROWS = 12, 4
# Cells of each of the two rows of the frequency sketch, and the parts in which rows of it travel.
WIDTH, PARTS = 1 << 20, 32
# Of 48 samples, a pair of similarity 0.8 shares fewer than this with a probability of 0.0003; such pairs are left out.
ALIKE = 28
# Texts of a bucket whose pairs are listed; texts and shingles of either side of a tile of a larger one, on average.
SMALL, TILE, TILE_SHINGLES = 16, 1024, 1_000_000
# Shingles that a tile weighs at once.
COLUMNS = 2048
# What rounding may take from a similarity.
ROUNDING = 1e-9
# Shingles of texts that a task keeps while it verifies pairs.
HELD = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, how often each occurs) of a text's runs of `size` words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        total = total * _ODD[3] + hashes[j:j + n] * _ODD[j % 5]
    total = np.sort(_mix(total))
    first = np.flatnonzero(np.append(True, total[1:] != total[:-1]))
    return total[first], np.diff(first, append=n)


# ---- weights ----------------------------------------------------------------------------------------------------


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(WIDTH - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


class Frequencies:
    """Document frequencies from a count-min sketch, as weights from 1 (in all documents) to 1 + SPREAD (in none)."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.counts, self.documents = counts, documents

    def weights(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        a, b = _cells(hashes)
        found = np.minimum(self.counts[0, a], self.counts[1, b]).astype(np.float64)
        found = np.minimum(found, self.documents)
        idf = np.log((self.documents + 1) / (found + 1)) / math.log(self.documents + 2)
        return times * (1 + SPREAD * idf)


def frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """The sketch of all documents: tasks count into arrays, which are summed in PARTS streams."""
    spark = ship(docs.sparkSession)
    part = 2 * WIDTH // PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, WIDTH), dtype=np.uint32)
        for batch in batches:
            held, size = [], 0
            for text in batch["text"]:
                held.append(shingles(text)[0])
                size += len(held[-1])
                if size > WIDTH:
                    _add(total, held)
                    held, size = [], 0
            _add(total, held)
        yield from _sent(total.reshape(PARTS, part))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["part"], batch["counts"], strict=True):
                now = np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.uint32)
                sums[k] = sums[k] + now if k in sums else now
        for k, total in sums.items():
            yield pd.DataFrame({"part": [k], "counts": [zlib.compress(total.astype("<u4").tobytes(), 1)]})

    schema = "part int, counts binary"
    rows = (
        docs.select(col(text_col).alias("text")).mapInPandas(count, schema)
        .repartition(PARTS, "part").mapInPandas(add, schema).collect()  # PARTS rows of a fixed size
    )
    total = np.zeros((PARTS, part), dtype=np.uint32)
    for r in rows:
        total[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4")
    return Frequencies(total.reshape(2, WIDTH), docs.count())


def _add(total: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        for row, cells in enumerate(_cells(np.concatenate(held))):
            total[row] += np.bincount(cells, minlength=WIDTH).astype(np.uint32)


def _sent(parts: np.ndarray) -> Iterator[pd.DataFrame]:
    for k, p in enumerate(parts):
        if p.any():
            yield pd.DataFrame({"part": [k], "counts": [zlib.compress(p.astype("<u4").tobytes(), 1)]})


# ---- samples ----------------------------------------------------------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling. A hash of the shingle picks its random numbers from a table.

    Shingles with equal numbers tie for the least; the one with the lower hash wins in every text.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        chance = np.random.default_rng(seed)
        n = 1 << 16
        self.bands, self.rows = bands, rows
        self.odd = chance.integers(1, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        r, c = chance.gamma(2.0, 1.0, n), chance.gamma(2.0, 1.0, n)
        beta = chance.uniform(0.0, 1.0, n)
        # With t = floor(log(weight) / r + beta), the least of log(c) - r * (t - beta + 1) is drawn.
        self.table = np.stack([1 / r, beta, np.log(c) - r * (1 - beta), r], axis=1).astype(np.float32)

    def sample(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One number for each sample: it stands for a shingle and its quantised weight."""
        k = len(self.odd)
        best, out = np.full(k, np.inf, dtype=np.float32), np.zeros(k, dtype=np.uint64)
        logs, every = np.log(weights).astype(np.float32), np.arange(k)
        for at in range(0, len(hashes), 512):
            h = hashes[at:at + 512]
            pick = h * self.odd
            pick >>= np.uint64(48)
            drawn = self.table.take(pick.view(np.int64), 0)
            t = np.floor(drawn[..., 0] * logs[at:at + 512] + drawn[..., 1])
            a = drawn[..., 2] - drawn[..., 3] * t
            i = a.argmin(1)
            lowest = a[every, i]
            better = lowest < best
            best[better] = lowest[better]
            steps = t[every, i].astype(np.int64).astype(np.uint64)
            out[better] = _mix(h[i] + steps * _ODD[3])[better]
        return out

    def buckets(self, drawn: np.ndarray) -> np.ndarray:
        """One key for each band of samples."""
        drawn = drawn.reshape(self.bands, self.rows)
        keys = np.arange(self.bands, dtype=np.uint64) * _ODD[2]
        for j in range(self.rows):
            keys = _mix(keys * _ODD[0] + drawn[:, j])
        return keys.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total > 0 else 0.0


# ---- links ------------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, text_hash (half a SHA-256), buckets (none without words), print (16 bits a sample), size (shingles)."""

    @F.pandas_udf("buckets array<long>, print array<short>, size int")
    def run(texts: pd.Series) -> pd.DataFrame:
        sampler, found = Sampler(), sent.value
        rows = []
        for text in texts:
            hashes, times = shingles(text)
            if len(hashes):
                drawn = sampler.sample(hashes, found.weights(hashes, times))
                rows.append((sampler.buckets(drawn), (drawn >> np.uint64(48)).astype(np.uint16).view(np.int16), len(hashes)))
            else:
                rows.append(([], [], 0))
        return pd.DataFrame(rows, columns=["buckets", "print", "size"])

    return docs.select(
        col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        _text_hash(text_col).alias("text_hash"), run(text_or_empty(text_col)).alias("drawn"),
    ).select("doc_id", "row", "text_hash", "drawn.buckets", "drawn.print", "drawn.size")


def _text_hash(text_col: str):
    return F.unhex(F.substring(F.sha2(text_or_empty(text_col), 256), 1, 32))


def _verified(pairs: DataFrame, texts: DataFrame, sent) -> DataFrame:
    """a, b, similarity of distinct pairs; `texts` has one row (node, text) for each node of a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sent.value
        held: dict[int, tuple] = {}
        size = 0

        def weighted(node: int, text: str):
            nonlocal size
            if node not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                hashes, times = shingles(text)
                held[node] = hashes, found.weights(hashes, times)
                size += len(hashes)
            return held[node]

        for batch in batches:
            pairs = zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True)
            values = [similarity(weighted(a, text_a), weighted(b, text_b)) for a, b, text_a, text_b in pairs]
            yield batch[["a", "b"]].assign(similarity=values)

    texts_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(texts_b, "b").join(texts_a, "a")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similarity double")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that have at least ALIKE samples in common."""
    prints = nodes.select("node", "print")
    both = pairs.join(prints.select(F.col("node").alias("a"), F.col("print").alias("pa")), "a").join(
        prints.select(F.col("node").alias("b"), F.col("print").alias("pb")), "b"
    )
    same = F.size(F.filter(F.zip_with("pa", "pb", lambda x, y: x == y), lambda s: s))
    return both.filter(same >= ALIKE).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its connected component) of every node of the edges (a, b)."""
    both = write_and_read(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = write_and_read(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("near", "node").alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near")
        )
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = write_and_read(
            stepped.join(jump, "label").select("node", "old", F.least("label", "beyond").alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels


def _merged(left: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label of what `left` (node, label) says, after the classes that `edges` link have become one."""
    label_a = left.select(F.col("node").alias("a"), F.col("label").alias("la"))
    label_b = left.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    crossing = edges.join(label_a, "a").join(label_b, "b").filter("la != lb").select(
        F.col("la").alias("a"), F.col("lb").alias("b")
    )
    found = components(crossing).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return left.join(found, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _in_tiles(held: DataFrame, nodes: DataFrame, texts: DataFrame, sent, similar: float) -> DataFrame:
    """Links (a, b) that join classes, of texts outside of their bucket's main class with all others of the bucket.

    `held`: bucket, node, label, outside (of the main class) of whole buckets.
    """
    rows = write_and_read(held.join(nodes.select("node", "print", "buckets", "size"), "node"), "large-buckets")

    def parts(some):
        n, cells = F.count(F.when(some, 1)), F.sum(F.when(some, F.col("size")).otherwise(0))
        return F.greatest(F.ceil(n / F.lit(TILE)), F.ceil(cells / F.lit(TILE_SHINGLES)), F.lit(1)).cast("int")

    cut = rows.groupBy("bucket").agg(parts(F.col("outside")).alias("down"), parts(F.lit(True)).alias("across"))
    placed = rows.join(cut, "bucket")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = placed.filter("outside").withColumn("i", F.pmod(F.xxhash64("node"), F.col("down")).cast("int")).withColumn(
        "j", every("across")).withColumn("side", F.lit(0))
    right = placed.withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("across")).cast("int")).withColumn(
        "i", every("down")).withColumn("side", F.lit(1))
    names = ["bucket", "i", "j", "side", "node", "label", "outside", "print", "buckets"]
    tiles = left.select(*names).unionByName(right.select(*names)).join(texts, "node")
    tiles = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for batch in batches:
            for new, rows in batch.groupby(["bucket", "i", "j"], sort=False):
                if new != key and held:
                    yield _tile_links(pd.concat(held), sent.value, similar)
                    held = []
                key = new
                held.append(rows)
        if held:
            yield _tile_links(pd.concat(held), sent.value, similar)

    return tiles.select(*names, "text").mapInPandas(run, "a long, b long")


def _tile_links(rows: pd.DataFrame, found: Frequencies, similar: float) -> pd.DataFrame:
    """Links between the two sides of a tile that join classes."""
    down, across = rows[rows["side"] == 0], rows[rows["side"] == 1]
    alike = _candidates(down, across)
    links, joined = [], _Sets()
    if alike.any():
        down, across, alike = down[alike.any(1)], across[alike.any(0)], alike[alike.any(1)][:, alike.any(0)]
        sets = [[(h, found.weights(h, n), n) for h, n in map(shingles, side["text"])] for side in (down, across)]
        nodes, labels = ([side[c].to_numpy() for side in (down, across)] for c in ("node", "label"))
        few = alike.sum() <= 4 * sum(alike.shape)
        if not few:
            alike &= _similarities(*sets, found) >= similar - ROUNDING
        for i, j in np.argwhere(alike).tolist():
            ends = joined.find(labels[0][i]), joined.find(labels[1][j])
            if ends[0] != ends[1] and (not few or similarity(sets[0][i], sets[1][j]) >= similar - ROUNDING):
                joined.join(*ends)
                links.append((nodes[0][i], nodes[1][j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _candidates(down: pd.DataFrame, across: pd.DataFrame) -> np.ndarray:
    """Which pairs of a tile are to be verified: enough samples in common, classes apart, and not met elsewhere."""
    (pa, pb), (ba, bb) = ([np.stack(side[c].to_numpy()) for side in (down, across)] for c in ("print", "buckets"))
    same = np.zeros((len(down), len(across)), dtype=np.uint8)
    for k in range(pa.shape[1]):
        same += pa[:, k, None] == pb[None, :, k]
    alike = same >= ALIKE
    alike &= down["label"].to_numpy()[:, None] != across["label"].to_numpy()
    # Two texts outside of the main class meet in two tiles: the one in which the lower node is on this side counts.
    alike &= ~across["outside"].to_numpy() | (down["node"].to_numpy()[:, None] < across["node"].to_numpy())
    # Texts that share several buckets are compared in the first of them.
    band = int(np.flatnonzero(ba[0] == down["bucket"].iloc[0])[0])
    for k in range(band):
        alike &= ba[:, k, None] != bb[None, :, k]
    return alike


def _similarities(down: list, across: list, found: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of two lists of (hashes, weights, times).

    What two texts share of a shingle is the lesser number of times: the first, second, ... occurrence of a shingle
    are things of their own, of equal weight, that a text has or has not. Only things on both sides are weighed.
    """
    def things(sets):
        n = np.concatenate([t for *_, t in sets])
        hashes, text = np.repeat(np.concatenate([h for h, *_ in sets]), n), np.repeat(np.arange(len(sets)), [t.sum() for *_, t in sets])
        nth = (np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        return hashes, _mix(hashes + nth * _ODD[4]), text

    (hashes, keys, text_a), (_, others, text_b) = things(down), things(across)
    shared, first = np.unique(keys[np.isin(keys, others)], return_index=True)
    weight = found.weights(hashes[np.isin(keys, others)][first], np.ones(len(first)))
    inner = np.zeros((len(down), len(across)))
    at = []
    for k, text in ((keys, text_a), (others, text_b)):
        place = np.minimum(np.searchsorted(shared, k), max(0, len(shared) - 1))
        fits = shared[place] == k if len(shared) else np.zeros(len(k), dtype=bool)
        place, text = place[fits], text[fits]
        order = np.argsort(place, kind="stable")
        at.append((place[order], text[order]))
    for start in range(0, len(shared), COLUMNS):
        stop = min(start + COLUMNS, len(shared))
        sides = []
        for (place, text), n in zip(at, inner.shape, strict=True):
            few = slice(*np.searchsorted(place, [start, stop]))
            side = np.zeros((n, stop - start))
            side[text[few], place[few] - start] = 1
            sides.append(side)
        inner += (sides[0] * weight[start:stop]) @ sides[1].T
    total = [np.array([w.sum() for _, w, _ in side]) for side in (down, across)]
    return inner / (total[0][:, None] + total[1] - inner)


class _Sets:
    """Union-find over labels."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, x: int, y: int) -> None:
        self.parent[max(x, y)] = min(x, y)


def link_classes(
    members: DataFrame, nodes: DataFrame, texts: DataFrame, sent, similar: float = SIMILAR, small: int = SMALL
) -> DataFrame:
    """node, label of the classes of near texts. `members`: bucket and node, in buckets of two at least."""

    def near(pairs):
        compared = _verified(write_and_read(_alike(pairs, nodes), "pairs"), texts, sent)
        return write_and_read(compared.filter(F.col("similarity") >= similar - ROUNDING).select("a", "b"), "links")

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    labels = members.select("node").distinct().withColumn("label", F.col("node"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    sized = write_and_read(members.join(sizes, "bucket"), "buckets")
    few, many = sized.filter(F.col("n") <= small), sized.filter(F.col("n") > small)
    # All pairs of small buckets; of large ones each text with a leader, the least node.
    pairs = few.join(few.select("bucket", F.col("node").alias("other")), "bucket").filter("node < other").select(
        *ordered("node", "other")
    ).unionByName(many.filter("node != leader").select(*ordered("node", "leader"))).distinct()
    labels = write_and_read(_merged(labels, near(pairs)), "labels")
    # Large buckets that are not all of one class.
    left = many.select("bucket", "node", "n").join(labels, "node")
    main = left.groupBy("bucket", "n", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("bucket", "n").agg(
        F.max(F.struct("m", "label")).alias("main")
    ).filter(F.col("n") > F.col("main.m")).select("bucket", "main")
    left = left.join(main, "bucket").select(
        "bucket", "node", "label", (F.col("label") != F.col("main.label")).alias("outside")
    )
    links = write_and_read(_in_tiles(left, nodes, texts, sent, similar), "links")
    return write_and_read(_merged(labels, links), "labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """For every row: doc_id, row, text_hash, class_id (least id of its class), class_size, kept.

    kept is true for one row of each class, that of the least id.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(frequencies(docs, text_col))
    rows = write_and_read(signatures(docs, sent, id_col, text_col), "signatures")
    # Equal texts are one node.
    nodes = write_and_read(
        rows.groupBy("text_hash").agg(F.first("buckets").alias("buckets"), F.first("print").alias("print"),
                                       F.first("size").alias("size"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes"
    )
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = write_and_read(members.join(shared, "bucket", "left_semi"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "text_hash"), "node")
    texts = docs.select(_text_hash(text_col).alias("text_hash"), text_or_empty(text_col).alias("text"))
    texts = write_and_read(
        texts.join(wanted, "text_hash").groupBy("node").agg(F.first("text").alias("text")), "texts"
    )
    labels = link_classes(members, nodes, texts, sent, similar)
    known = nodes.select("text_hash", "node").join(labels, "node", "left").select(
        "text_hash", F.coalesce("label", "node").alias("label")
    )
    marked = write_and_read(rows.select("doc_id", "row", "text_hash").join(known, "text_hash"), "marked")
    # Null ids come last: a struct that starts with a flag orders them.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = marked.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return marked.join(best, "label").select(
        "doc_id", "row", "text_hash", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows that stay, whole and with their columns: of each class one, that of the least id."""
    found = classes(docs, id_col, text_col, similar).filter("kept").select("text_hash", "doc_id")
    text_hash, rank = free_name(docs, "text_hash"), free_name(docs, "rank")
    kept_id = free_name(docs, "kept_id")
    marked = docs.withColumn(text_hash, _text_hash(text_col))
    kept = found.select(F.col("text_hash").alias(text_hash), F.col("doc_id").alias(kept_id))
    stays = marked.join(kept, text_hash).filter(col(id_col).eqNullSafe(col(kept_id)))
    # Rows equal in text and id: one of them.
    order = Window.partitionBy(col(text_hash)).orderBy(F.lit(0))
    return stays.withColumn(rank, F.row_number().over(order)).filter(col(rank) == 1).select(
        *[col(c) for c in docs.columns]
    )
