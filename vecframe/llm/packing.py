"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens (only longer documents are cut; the first piece takes the
remainder). Pieces that fill a sequence stand alone. The others fall into blocks of at most `BLOCK` pieces as
they lie in the stored table. Each block is packed by several islands, each a small population in a task of its
own: crossover injects whole well-filled bins of one parent into another, bins that hold a piece twice are
dissolved, and displaced pieces go back best-fit. The best packings of an island migrate to the next one
between the rounds. Badly filled bins of all blocks are dissolved at the end and packed once more together.

Defined results: a null or empty text is the end token alone; repeated rows are packed one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecframe.llm.common import col, free_name
from vecframe.llm.token_counts import PRETOKENS, RankMerger, byte_letters, chunks, whole
from vecframe.session import ship, write_and_read

CAPACITY, END = 2048, 0
# Pieces of a block, islands of a block, rounds between migrations, crossovers of a round, packings of an island.
BLOCK, ISLANDS, ROUNDS, CROSSOVERS, POPULATION = 4096, 3, 2, 4, 4
# Bins that are filled less than this are dissolved in the end, and packed anew together with some of the others.
POOR = 0.97
# Texts' characters that are tokenized at once, and chunks of texts that a worker remembers.
CHARS, REMEMBERED = 250_000, 100_000


# ---- tokens -------------------------------------------------------------------------------------------------


class IdTable:
    """Token ids of chunks; the first `most` chunks met are remembered. `begins`: ids that begin with a blank or line end."""

    def __init__(self, tokenize: Callable[[str], list[int]], begins: np.ndarray, most: int):
        self.tokenize, self.begins, self.most, self.known = tokenize, begins, most, {}
        self.ids, self.ends = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def look_up(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of every text, which comes in chunks. All new chunks are tokenized at once."""
        for t in texts:
            t[0] = "\r\r" + t[0]
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        holes = np.flatnonzero(at < 0).tolist()
        fresh: dict[str, int] = {}
        for i in holes:
            fresh.setdefault(flat[i], len(self.ends) - 1 + len(fresh))
        at[holes] = [fresh[flat[i]] for i in holes]
        more, lengths = self.computed(list(fresh))
        ids, ends = np.concatenate([self.ids, more]), np.append(self.ends, self.ends[-1] + np.cumsum(lengths))
        if len(self.known) < self.most:
            self.known.update(fresh)
            self.ids, self.ends = ids, ends
        # The ids of all chunks in a row: what lies before a chunk here, and where its ids lie in the table.
        n = ends[at + 1] - ends[at]
        upto = np.cumsum(n)
        out = ids[np.arange(upto[-1]) + np.repeat(ends[at] - upto + n, n)].tobytes()
        cut = [0, *(4 * upto[np.cumsum([len(t) for t in texts]) - 1]).tolist()]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def computed(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them are each chunk's) of chunks."""
        # Whose only white space is the blank or line end before them: such ones tokenize alike behind each other.
        plain = np.array([c.split() == [c.removeprefix("\n")] for c in new], dtype=bool)
        row = np.array(self.tokenize("".join(map(whole, compress(new, plain.tolist())))), dtype="<u4")
        rest = [self.tokenize(c[2:] if c[:2] == "\r\r" else whole(c)) for c in compress(new, (~plain).tolist())]
        lengths = np.empty(len(new), dtype=np.int64)
        lengths[plain] = np.diff(np.flatnonzero(self.begins[row]), append=len(row))
        lengths[~plain] = list(map(len, rest))
        ids, own = np.empty(lengths.sum(), dtype="<u4"), np.repeat(plain, lengths)
        ids[own], ids[~own] = row, list(chain.from_iterable(rest))
        return ids, lengths


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(splitter at special strings, ids of special strings, table of the ids of chunks)."""
    merger, tokenizer = RankMerger(path), Tokenizer.from_file(path)
    letters = {c: b for b, c in byte_letters().items()}
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items()
        if token not in merger.special
    }
    # The file's own vocabulary and merges, whose ranks follow its ids, in a quicker encoder.
    quick = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
    begins[[i for token, i in ranks.items() if token[:1] in (b" ", b"\n")]] = True
    special = {s: np.array([tokenizer.token_to_id(s)], dtype="<u4").tobytes() for s in merger.special}
    return merger, special, IdTable(quick.encode_ordinary, begins, REMEMBERED)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers."""
    merger, special, table = _encoder(path)
    split, marks = [], []
    for text in texts:
        found = [s for s in merger.special if s in text]
        split += [chunks(p) for p in (merger.split_special(text) if found else [text])]
        marks.append(_specials(text, merger.special) if found else [])
    found = iter(table.look_up(split) if split else [])
    out = []
    for between in marks:
        ids = [next(found)]
        for name in between:
            ids += special[name], next(found)
        out.append(b"".join(ids))
    return out


def _specials(text: str, names: list[str]) -> list[str]:
    return regex.findall("|".join(map(regex.escape, names)), text)


def cut_into_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            batch["text"] = batch["text"].fillna("")
            cut = np.cumsum(batch["text"].str.len().to_numpy(dtype=np.int64)) // CHARS
            for _, part in batch.groupby(cut):
                rows = []
                for id_, ids in zip(part["doc_id"], encode(part["text"].tolist(), path), strict=True):
                    ids += end
                    for at, (start, n) in enumerate(cut_into_pieces(len(ids) // 4, capacity)):
                        rows.append((id_, at, start, n, zlib.crc32(ids[4 * start:4 * (start + n)])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": object})

    given = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    # A null among whole numbers would turn them into floats on the way: ids travel as text.
    return given.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, piece int, start long, length long, ids_crc32 long"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))


# ---- one packing ---------------------------------------------------------------------------------------------


class Packing:
    """Bins of a set of pieces; `sizes` is shared by all packings of a block."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> None:
        """Puts items, the largest first, each into the fullest bin that has room for it."""
        room = sorted((self.capacity - f, b) for b, f in enumerate(self.fill))
        sizes = self.sizes
        for i in sorted(items, key=lambda i: -sizes[i]):
            at = bisect_left(room, (sizes[i], -1))
            if at < len(room):
                left, b = room.pop(at)
                self.bins[b].append(i)
                self.fill[b] += sizes[i]
            else:
                left, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(sizes[i])
            if left > sizes[i]:
                insort(room, (left - sizes[i], b))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones (mean square of the fill)."""
        return -len(self.bins), sum(f * f for f in self.fill) / max(1, len(self.bins))

    def crossed(self, other: "Packing", chance: random.Random) -> "Packing":
        """A child: this packing with the better-filled of a random part of the other's bins injected."""
        n = len(other.bins)
        span = {(chance.randrange(n) + k) % n for k in range(max(1, n // 4))}
        mean = sum(other.fill) / n
        injected = [other.bins[b] for b in sorted(span) if other.fill[b] >= mean]
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        poor = self.capacity * chance.uniform(0.8, 0.98)
        for b, fill in zip(self.bins, self.fill, strict=True):
            if taken.isdisjoint(b):
                # A badly filled bin goes at times, so that its pieces may find better places.
                if fill >= poor or chance.random() < 0.5:
                    kept.append(b)
                else:
                    displaced += b
            else:
                displaced += [i for i in b if i not in taken]
        child = Packing(self.sizes, self.capacity, [list(b) for b in injected + kept])
        child.best_fit(displaced)
        return child

    def places(self) -> list[int]:
        """The bin of each piece."""
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out


def from_places(sizes: list[int], capacity: int, places) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
    for i, b in enumerate(places):
        bins[b].append(i)
    return Packing(sizes, capacity, bins)


def first_packing(sizes: list[int], capacity: int, chance: random.Random, spread: float) -> Packing:
    """Best fit in order of size, which `spread` blurs."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + spread * chance.random()))
    out = Packing(sizes, capacity)
    if not spread:
        out.best_fit(order)
        return out
    room: list[tuple[int, int]] = []
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, len(out.bins))
        if b == len(out.bins):
            out.bins.append([])
            out.fill.append(0)
        out.bins[b].append(i)
        out.fill[b] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return out


def evolve(sizes: list[int], capacity: int, start: list[Packing], seed: int, crossovers: int, population: int):
    """A round on one island: the best packings, the best first."""
    chance = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    live = list(start)
    if not live:
        live.append(first_packing(sizes, capacity, chance, 0.0))
    while len(live) < population and len(live[0].bins) > least:
        live.append(first_packing(sizes, capacity, chance, 0.05 * len(live)))
    live.sort(key=Packing.fitness, reverse=True)
    for _ in range(crossovers):
        if len(live[0].bins) <= least or len(live) < 2:
            break
        a, b = (min(chance.sample(range(len(live)), 2)) for _ in range(2))
        b = b if b != a else (a + 1) % len(live)
        live.append(live[a].crossed(live[b], chance))
        live.sort(key=Packing.fitness, reverse=True)
        del live[population:]
    return live


# ---- islands over Spark --------------------------------------------------------------------------------------


def _islands(blocks: DataFrame, capacity: int, islands: int, rounds: int, crossovers: int, population: int):
    """block, places (the bin of each piece) of the best packing; `blocks` has block and sizes, one row each."""
    crowd = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn(
        "elite", F.lit(None).cast("array<array<int>>")
    )
    schema = "block long, island int, sizes array<int>, elite array<array<int>>, bins int, fill double"

    def round_(seed: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    sizes = [int(s) for s in r.sizes]
                    start = [from_places(sizes, capacity, list(map(int, p))) for p in (() if r.elite is None else r.elite)]
                    live = evolve(sizes, capacity, start, seed + 7919 * int(r.block) + int(r.island), crossovers, population)
                    bins, fill = live[0].fitness()
                    rows.append((r.block, r.island, sizes, [p.places() for p in live[:2]], -bins, fill))
                yield pd.DataFrame(rows, columns=["block", "island", "sizes", "elite", "bins", "fill"])

        return run

    for k in range(rounds):
        # Each island is a row; the rows are dealt anew so that all tasks have some.
        crowd = crowd.select("block", "island", "sizes", "elite").repartition("block", "island")
        crowd = crowd.mapInPandas(round_(1 + k), schema)
        if k + 1 < rounds:
            ring = Window.partitionBy("block").orderBy("island")
            ahead = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(
                ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            crowd = crowd.withColumn("elite", F.concat("elite", F.slice(ahead, 1, 1)))
    return crowd.groupBy("block").agg(
        F.max_by(F.struct(F.col("elite")[0].alias("places")), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best")
    ).select("block", F.col("best.places").alias("places"))


def _pack_rows(rows: DataFrame, capacity: int, block: int, **how) -> DataFrame:
    """`rows` (row, length and others) with block and bin more."""
    rows = write_and_read(rows.withColumn("order", F.monotonically_increasing_id()), "pieces").withColumn(
        "block", F.col("order") - F.col("order") % block
    )
    blocks = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "length"))).alias("all")).select(
        "block", F.transform("all", lambda p: p["length"].cast("int")).alias("sizes"),
        F.transform("all", lambda p: p["order"]).alias("orders"),
    )
    best = _islands(blocks.select("block", "sizes"), capacity, **how)
    placed = best.join(blocks.select("block", "orders"), "block").select(
        "block", F.explode(F.arrays_zip("orders", "places")).alias("p")
    ).select("block", F.col("p.orders").alias("order"), F.col("p.places").alias("bin"))
    return rows.join(placed, ["block", "order"]).drop("order")


def pack(
    parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS,
    crossovers: int = CROSSOVERS, population: int = POPULATION, poor: float = POOR,
) -> DataFrame:
    """`parts` (with a column length, from 1 to `capacity`) with sequence_id and offset more."""
    how = {"islands": islands, "rounds": rounds, "crossovers": crossovers, "population": population}
    seq, off = free_name(parts, "sequence_id"), free_name(parts, "offset")
    row = free_name(parts, "row")
    stored = write_and_read(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    small = stored.filter(F.col("length") < capacity).select(F.col(row).alias("row"), "length")
    first = write_and_read(_pack_rows(small, capacity, block, **how), "packed")
    bin_ = ["block", "bin"]
    filled = first.groupBy(*bin_).agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("n"))
    # The poor bins of all blocks, and a few good ones chosen by hash to mix with, are packed once more.
    again = filled.filter((F.col("filled") < poor * capacity) | (F.xxhash64(*bin_) % 32 == 0)).select(*bin_)
    loose = write_and_read(first.join(again, bin_, "left_semi").select("row", "length"), "loose")
    loose = loose.repartition(max(1, loose.count() // (4 * block)))
    second = _pack_rows(loose, capacity, block, **how).select("row", "length", "block", "bin", F.lit(1).alias("step"))
    tight = first.join(again, bin_, "left_anti").select("row", "length", "block", "bin", F.lit(0).alias("step"))
    inside = Window.partitionBy("step", "block", "bin").orderBy("row")
    # Three kinds of sequences share the numbers: by row for full pieces, else by block and bin. A block's number is
    # that of its first piece, and it has fewer bins than pieces follow before the next block.
    packed = tight.unionByName(second).select(
        F.col("row").alias(row),
        (F.lit(3) * (F.col("block") + F.col("bin")) + F.col("step")).alias(seq),
        (F.sum("length").over(inside) - F.col("length")).cast("long").alias(off),
    )
    alone = stored.filter(F.col("length") >= capacity).select(
        *[col(c) for c in parts.columns], (F.lit(3) * F.col(row) + 2).alias(seq), F.lit(0).cast("long").alias(off)
    )
    return stored.join(packed, row).select(*[col(c) for c in parts.columns], seq, off).unionByName(alone)
