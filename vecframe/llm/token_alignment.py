"""Alignment of two tokenizers' tokens, once for each distinct text, weighted by how often the text occurs.

Texts are shuffled whole, equal ones meet and are counted. Each distinct text is encoded by both tokenizers and
aligned by byte offsets: bytes where tokens of both end cut it into groups, and the stretches between any two
neighbouring ends are the links, the overlapping pairs of one token each. How often two ids are linked in the
corpus is the sum of a text's links times its number of copies. Measures of a text are then joined to the doc_ids
of its copies by the text's digest.

A text falls into segments at blanks after other characters, where no token of either kind crosses: pre-tokens of
the byte-level tokenizer end there, and no piece has a blank behind another character (`Aligner` refuses a
vocabulary that has). A worker remembers the alignments of segments, so common words are aligned once.

What leaves the tasks: of each distinct text its digest, measures and distinct id pairs. Counts are summed in the
tasks, then by id pair. At most `HEAD` pairs hold a share of 1/HEAD of all links each; those, and one highest count
for each id of the second vocabulary, go to all tasks, and all rarer pairs are joined by shuffle. Likewise at most
`HEAVY` texts hold a share of 1/HEAVY of all rows each; their measures go to all tasks.

Defined results: null and empty texts, and texts whose tokens do not spell a blank and the text in both (such as
those with U+2581), have no tokens and zeros; strings of special tokens are plain text; repeated rows count each;
ties for an id's highest count all count as best; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecframe.llm.common import col, slices_of, text_or_empty
from vecframe.llm.token_counts import PRETOKENS, byte_letters
from vecframe.session import ship, write_and_read

HEAD, HEAVY = 1 << 18, 1000
# Segments that a worker remembers; characters that are aligned at once, but for a single longer text.
REMEMBERED, CHARS = 200_000, 1_000_000
# Pairs that a task sums before it passes the sums on.
SUMMED = 2_000_000

_SEGMENTS = re.compile(r"(?<=\S) ")


# ---- one batch of texts --------------------------------------------------------------------------------------


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(weights[order], starts)


class Aligner:
    """Aligns a byte-level BPE (A, a tokenizers file) with a piece model that adds a blank in front (B)."""

    def __init__(self, path_a: str, path_b: str):
        tokenizer = Tokenizer.from_file(path_a)
        letters = {c: b for b, c in byte_letters().items()}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        # The file's own vocabulary, whose ids follow the ranks of its merges, in a quicker encoder.
        self.a = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for spelt, i in ranks.items():
            self.bytes_a[i] = spelt
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [self._bytes(i) for i in range(self.size_b)]
        names = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece has a blank behind another character, so texts have no segments")
        self.blank = [self.b.piece_to_id("▁")]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # How an id of either side is written within a group, and as the last one of its side there.
        self.written = np.array([
            f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (self.size_b, ",;")) for end in ends for i in range(n)
        ], dtype=object)
        self.forget()

    def _bytes(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.empty((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, links, broken
        self.starts, self.pairs = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _learn(self, segments: list[str]) -> None:
        """Remembers the alignments of segments, each with the blank before it, all found at once."""
        self.known.update(zip(segments, range(len(self.groups), len(self.groups) + len(segments)), strict=True))
        texts = [b" " + s.encode() for s in segments]
        a = list(map(self.a.encode_ordinary, [" " + s for s in segments]))
        # An empty segment is the blank alone, which the piece model would not see.
        b = [ids or self.blank for ids in self.b.encode(segments, num_threads=1)]
        broken = np.zeros(len(segments), dtype=bool)
        for ids, spelt in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(spelt.__getitem__, chain.from_iterable(ids))) != b"".join(texts):
                broken |= [b"".join(map(spelt.__getitem__, i)) != t for i, t in zip(ids, texts, strict=True)]
        for i in np.flatnonzero(broken):
            a[i], b[i], texts[i] = [], [], b""
        groups, numbers, pairs = self._aligned(a, b, np.array(list(map(len, texts)), dtype=np.int64))
        self.groups += groups
        fresh = np.column_stack([numbers, broken])
        begin = len(self.pairs) + np.cumsum(fresh[:, 3]) - fresh[:, 3]
        self.numbers = np.concatenate([self.numbers, fresh])
        self.starts = np.concatenate([self.starts, begin])
        self.pairs = np.concatenate([self.pairs, pairs])

    def _aligned(self, a: list[list[int]], b: list[list[int]], n_bytes: np.ndarray):
        """Of segments whose tokens spell the same bytes: groups as `a1,a2|b1;`, (n_a, n_b, n_groups, links), pairs."""
        n_a, n_b = (np.array(list(map(len, ids)), dtype=np.int64) for ids in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=n.sum()) for x, n in ((a, n_a), (b, n_b)))
        # Segments lie one after the other, so byte offsets of all tokens are sums over all of them.
        end_a, end_b, ends = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]), np.cumsum(n_bytes)
        both = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        twice = np.append(both[1:] == both[:-1], False)[:len(both)]
        shared, cuts = both[twice], both[~twice]
        # The stretch before a cut lies in the tokens that end there or next.
        pairs = ids_a[np.searchsorted(end_a, cuts)] * self.size_b + ids_b[np.searchsorted(end_b, cuts)]
        n_links, n_groups = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (cuts, shared))
        side = np.concatenate([2 * np.searchsorted(shared, end_a), 2 * np.searchsorted(shared, end_b) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([ids_a, ids_b])[order]
        last = np.append(side[1:] != side[:-1], True)[:len(side)]
        size_a = len(self.bytes_a)
        place = np.where(side % 2 == 0, ids + last * size_a, ids + 2 * size_a + last * self.size_b)
        written = self.written[place].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(written[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
        return groups, np.column_stack([n_a, n_b, n_groups, n_links]), pairs

    def measure(self, texts: list[str]):
        """Of non-empty texts: n_a, n_b, n_groups, n_links, digest of the groups; pairs, times, pairs of each text."""
        split = [_SEGMENTS.split(t) for t in texts]
        flat = list(chain.from_iterable(split))
        new = set(flat) - self.known.keys()
        if new and len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = set(flat)
        if new:
            self._learn(list(new))
        length = np.array(list(map(len, split)), dtype=np.int64)
        which = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        begin = np.cumsum(length) - length
        numbers = np.add.reduceat(self.numbers[which], begin, axis=0)
        broken = numbers[:, 4] > 0
        numbers[broken] = 0
        digests, at = [], 0
        names = list(map(self.groups.__getitem__, which.tolist()))
        for n, bad in zip(length.tolist(), broken.tolist(), strict=True):
            digests.append("" if bad else hashlib.sha256("".join(names[at:at + n])[:-1].encode()).hexdigest())
            at += n
        # Distinct segments of each text first, then their pairs.
        text = np.repeat(np.arange(len(texts)), length)
        whole = ~broken[text]
        key, times = summed((text * len(self.groups) + which)[whole], np.ones(int(whole.sum()), dtype=np.int64))
        text, segment = key // max(1, len(self.groups)), key % max(1, len(self.groups))
        n = self.numbers[segment, 3]
        pair = self.pairs[ragged(self.starts[segment], n)]
        span = len(self.bytes_a) * self.size_b + self.size_b
        key, times = summed(np.repeat(text, n) * span + pair, np.repeat(times, n))
        return numbers[:, :4], digests, key % span, times, np.bincount(key // span, minlength=len(texts))


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---- over Spark ----------------------------------------------------------------------------------------------


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def measure_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of each row (text, copies): key, copies, its measures, and its distinct pairs with how often it has them."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for part in slices_of(batch, "text", CHARS):
                numbers, digests, pairs, times, n = aligner.measure(part.column("text").to_pylist())
                columns = {"key": part.column("key"), "copies": part.column("copies")}
                columns |= {c: numbers[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                columns |= {"groups_sha256": digests, "pairs": _lists(pairs, n), "times": _lists(times, n)}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    found = texts.select(_digest("text").alias("key"), "copies", "text").mapInArrow(
        run, f"key binary, copies long, {schema}"
    )
    return write_and_read(found, "aligned")


def _digest(text: str):
    return F.unhex(F.sha2(col(text), 256))


def pair_counts(measured: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows, copies included, hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            copies = np.repeat(batch.column("copies").to_numpy(), pairs.value_lengths().to_numpy())
            held.append((pairs.flatten().to_numpy(), times.flatten().to_numpy() * copies))
            size += len(copies)
            if size > 2 * SUMMED:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > SUMMED:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["pair", "n"])
                    held, size = [], 0
        if held:
            keys, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    partial = measured.select("pairs", "times", "copies").mapInArrow(run, "pair long, n long")
    return write_and_read(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def _looked_up(measured: DataFrame, counts: DataFrame, size_b: int, head: int) -> DataFrame:
    """`measured` with n_best and count_sum in place of the pairs."""
    spark = measured.sparkSession
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most `head` rows, as each holds a share of 1/head of all links.
    common = counts.where(F.col("n") * head >= total).toPandas().sort_values("pair") if total else None
    highest = np.zeros(size_b, dtype=np.int64)
    # One row for each id of the second vocabulary.
    for r in counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("n")).toLocalIterator():
        highest[r["b"]] = r["n"]
    table = [np.empty(0, dtype=np.int64)] * 2 if common is None else [common[c].to_numpy() for c in ("pair", "n")]
    shared = spark.sparkContext.broadcast((*table, highest))
    carried = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, most = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            length, pair = pairs.value_lengths().to_numpy(), pairs.flatten().to_numpy()
            row = np.repeat(np.arange(len(length)), length)
            at = np.searchsorted(known, pair)
            here = np.zeros(len(pair), dtype=bool)
            inside = at < len(known)
            here[inside] = known[at[inside]] == pair[inside]
            n = np.zeros(len(pair), dtype=np.int64)
            n[here] = counted[at[here]]
            best = np.where(here & (n == most[pair % size_b]), times, 0)
            columns = {c: batch.column(c) for c in carried}
            columns["n_best"] = _per_row(row, best, len(length))
            columns["count_sum"] = _per_row(row, n * times, len(length))
            rare = np.bincount(row[~here], minlength=len(length))
            columns |= {"pairs": _lists(pair[~here], rare), "times": _lists(times[~here], rare)}
            yield pa.RecordBatch.from_pydict(columns)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.select(*carried).schema.fields)
    found = write_and_read(measured.mapInArrow(
        run, f"{kept}, n_best long, count_sum long, pairs array<long>, times array<long>"
    ), "looked-up")
    # The others, each rarer than 1/head of all links.
    each = found.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", "p.pairs", "p.times")
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    rare = counts.where(F.col("n") * head < total).withColumn("b", F.col("pair") % size_b)
    rare = rare.join(F.broadcast(best), "b")
    more = each.join(rare, each["pairs"] == rare["pair"]).groupBy("key").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("best_more"),
        F.sum(F.col("n") * F.col("times")).alias("sum_more"),
    )
    return found.drop("pairs", "times").join(more, "key", "left").select(
        *carried, (F.col("n_best") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"),
    )


def _per_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row number (rows are in order)."""
    before = np.concatenate([[0], np.cumsum(values)])
    edges = np.searchsorted(row, np.arange(n + 1))
    return before[edges[1:]] - before[edges[:-1]]


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD,
    heavy: int = HEAVY,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id and measures of every row; pair counts as id_a, id_b, n)."""
    given = docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    distinct = given.where(F.col("text") != "").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    measured = measure_texts(distinct, path_a, path_b)
    counts = pair_counts(measured)
    per_text = write_and_read(_looked_up(measured, counts, size_b, head).withColumnRenamed("key", "digest"), "per-text")
    keys = write_and_read(given.select(
        "doc_id", F.when(F.col("text") != "", _digest("text")).alias("digest")
    ), "digests")
    n_rows = keys.count()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    some = keys.where(F.col("digest").isNotNull())
    # At most `heavy` rows, as each text has a share of 1/heavy of all rows.
    hot = F.broadcast(per_text.where(F.col("copies") * heavy >= n_rows).select("digest", *names))
    out = some.join(hot, "digest").unionByName(
        some.join(hot.select("digest"), "digest", "left_anti").join(
            per_text.where(F.col("copies") * heavy < n_rows).select("digest", *names), "digest"
        )
    ).select("doc_id", *names)
    nothing = keys.where(F.col("digest").isNull()).select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in names[:-1]], F.lit("").alias("groups_sha256")
    )
    pairs = counts.select(
        F.floor(F.col("pair") / size_b).alias("id_a"), (F.col("pair") % size_b).alias("id_b"), "n"
    )
    return out.unionByName(nothing), pairs
