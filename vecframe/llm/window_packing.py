"""Packing into windows by best-fit decreasing, over all documents at once.

Documents become token sequences; one that is longer than `capacity` is first cut into full windows and a
remainder. Pieces are then packed from the longest to the shortest, each into the open window with the least
room that still holds it; a segment tree indexed by remaining capacity finds that window.

Pieces of one length are alike, so the packing depends on how many there are of each length and on nothing else:
at most `capacity` numbers, counted by Spark, whatever the size of the corpus. `plan` packs all pieces of a length
in steps: if the tightest room is r, a window of that room takes r // length pieces in a row (what is left after
each is tighter still), and all windows of one filling take them together. A step is one row of the plan, and
windows hold at most 63 different lengths of 2048 tokens, so the plan stays small and is the same as packing piece
by piece. Tasks then number the pieces of a length and look their places up; texts are read once, nothing else
than counts is collected, and a length that a third of all pieces have is dealt out like any other.

Defined results: a null or empty text is the end token alone; repeated rows and ties in length are packed one by
one, in the order in which tasks meet them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecframe.llm.common import col, slices_of
from vecframe.session import ship, write_and_read

CAPACITY, END = 2048, 1
# Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
# Characters that are tokenized at once.
CHARS = 2_000_000
# Fixed value: the pattern of pre-tokens of the word-level tokenizer, on text in lower case.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for text of these characters, whose letters have one lower case and no other form.
_PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*").fullmatch
_LOWER = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
# A word with another character: white space that is not listed here, such as U+00A0, counts as such.
_ODD = re.compile("(?<![^ \t-\r])([!-~À-ÖØ-öø-ÿ]*+[^ \t-\r!-~À-ÖØ-öø-ÿ][^ \t-\r]*+)")


# ---- tokens -------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts, as little-endian 32-bit numbers, by a tokenizer that drops white space.

    White space ends every pre-token there, so parts of a text tokenize on their own. Stretches of plain Latin
    letters are put into lower case and cut into pre-tokens here, as the tokenizer would; only pre-tokens not met
    before go through its merges. Words with other characters, and texts with special strings, go through the
    tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        normal, splits = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        shapes = [n["type"] for n in normal], [p.get("pattern", {}).get("Regex") for p in splits]
        if shapes != (["NFC", "Replace", "Lowercase"], [PRETOKENS, None]):
            raise ValueError(f"{path} does not cut words as expected")
        # The same merges without what has been done to a pre-token already.
        merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": splits[-1], "added_tokens": []}))
        self.parts, self.words = _Remembered(merges), _Remembered(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.special) for t in texts]
        # Plain stretches and, between them, words with other characters.
        split = [None if w else [t] if _PLAIN(t) else _ODD.split(t) for t, w in zip(texts, whole, strict=True)]
        split = [s and [p if i % 2 else _LOWER.findall(p.lower()) for i, p in enumerate(s)] for s in split]
        self.parts.learn([p for s in split if s for p in s[::2]])
        self.words.learn([s[1::2] for s in split if s])
        part, word = self.parts.__getitem__, self.words.__getitem__
        others = iter(_ids(self.tokenizer, [t for t, w in zip(texts, whole, strict=True) if w]))
        return [
            next(others) if s is None else b"".join(word(p) if i % 2 else b"".join(map(part, p)) for i, p in enumerate(s))
            for s in split
        ]


def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [array("I", e.ids).tobytes() for e in found]


class _Remembered(dict):
    """The ids of strings. Very long ones, and all when they become too many, are kept for one batch only."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.long = tokenizer, {}

    def learn(self, groups: list[list[str]]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set().union(*groups) - self.keys())
        found = dict(zip(new, _ids(self.tokenizer, new), strict=True))
        self.long = {s: found.pop(s) for s in new if len(s) > LONGEST}
        self.update(found)

    def __missing__(self, string):
        return self.long[string]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_into_windows(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full windows, then what is left."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, stored; task and nth number those of a length."""
    ship(docs.sparkSession)
    given = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in slices_of(batch, "text", CHARS):
                doc, rows = [], []
                for at, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    for start, length in cut_into_windows(n, capacity):
                        doc.append(at)
                        rows.append((start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n, seen[length]))
                        seen[length] += 1
                start, length, crc, n, nth = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(doc, pa.int64())), "start": start, "length": length,
                    "ids_crc32": crc, "doc_tokens": n, "task": np.full(len(doc), task, dtype=np.int32), "nth": nth,
                })

    found = given.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
    )
    return write_and_read(found, "windows")


# ---- the plan -----------------------------------------------------------------------------------------------


class RoomTree:
    """A segment tree indexed by remaining capacity; it holds the window groups with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.groups: list[list] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, group) -> None:
        self.groups[room].append(group)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = True
            node //= 2

    def pop(self, room: int):
        group = self.groups[room].pop()
        node = room + self.leaves
        if not self.groups[room]:
            self.some[node] = False
            while node > 1:
                node //= 2
                self.some[node] = self.some[2 * node] or self.some[2 * node + 1]
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that some window has."""
        node = least + self.leaves
        if self.some[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces of each length.

    A row (length, nth, window, each, offset) says that the pieces from number `nth` of that length on lie in the
    windows from `window` on, `each` in every window, the first at `offset`, until the length's next row.
    """
    tree, rows, windows = RoomTree(capacity), [], 0

    def put(length: int, nth: int, n: int, room: int, first: int, of: int) -> int:
        """Fills windows of a group (numbered from `first`, `of` of them) with up to n pieces; how many went in."""
        each = room // length
        full = min(of, n // each)
        rest = n - full * each if full < of else 0
        rows.append((length, nth, first, each, capacity - room))
        left = room - each * length
        if full and left:
            tree.add(left, (first, full))
        if rest:
            tree.add(room - rest * length, (first + full, 1))
        untouched = of - full - (1 if rest else 0)
        if untouched:
            tree.add(room, (of - untouched + first, untouched))
        return full * each + rest

    for length in sorted(counts, reverse=True):
        nth, n = 0, counts[length]
        while n:
            room = tree.tightest(length)
            if room is None:
                of = -(-n // (capacity // length))
                done = put(length, nth, n, capacity, windows, of)
                windows += of
            else:
                first, of = tree.pop(room)
                done = put(length, nth, n, room, first, of)
            nth, n = nth + done, n - done
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (of `pieces`) with sequence_id and offset in place of task and nth."""
    counted = parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # A number for every piece of a length: those of earlier tasks, then those met before in its own.
    earlier = counted.withColumn(
        "earlier", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ).drop("n")
    # At most `capacity` rows.
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(plan(totals, capacity)), dtype=np.int64).reshape(-1, 5)
    scale = max(totals.values(), default=0) + 1
    shared = parts.sparkSession.sparkContext.broadcast((table, table[:, 0] * scale + table[:, 1], scale))
    names = [c for c in parts.columns if c not in ("task", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, starts, unit = shared.value
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            _, first, window, each, offset = steps[np.searchsorted(starts, length * unit + nth, side="right") - 1].T
            columns = {c: batch.column(c) for c in names}
            columns["sequence_id"] = window + (nth - first) // each
            columns["offset"] = offset + (nth - first) % each * length
            yield pa.RecordBatch.from_pydict(columns)

    numbered = parts.join(earlier, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("earlier"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*names).schema.fields)
    return numbered.select(*names, "nth").mapInArrow(place, f"{schema}, sequence_id long, offset long")
