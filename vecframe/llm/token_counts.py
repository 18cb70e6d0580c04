"""Token counts of byte-level BPE by rank-synchronous merging of whole batches.

A text falls into chunks at blanks and line ends, chunks into pre-tokens. The pre-tokens that a task has not
met are held as one ragged numpy array of symbols; each round finds every sequence's lowest-ranked pair and
joins all places of that pair in all sequences at once, until no pair is left. What counts is how many symbols
survive. Counts of chunks are kept in a table of bounded size in each worker.

Defined results: a null or empty text has no bytes and no tokens; strings of special tokens in a text are
that token, as the library has it by default; repeated rows are counted one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name
from vecframe.session import ship

LIMIT = 1024
# Chunks that a worker remembers, the first ones it meets.
REMEMBERED = 1_000_000
# Symbols that are merged at once, but for a longer single sequence.
SYMBOLS = 4_000_000

# Fixed value: the pattern of pre-tokens of the byte-level tokenizers.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PRETOKEN = regex.compile(PRETOKENS)
_TWO_BLANKS = re.compile(r"\s\s")
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Byte-level BPE over many sequences at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, _NONE)
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        letters = byte_letters()
        self.bytes = np.array([vocabulary[letters[b]] for b in range(256)], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").split

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, sequences: list[bytes]) -> list[np.ndarray]:
        """The surviving symbols of each sequence."""
        out: list = [np.empty(0, np.int64)] * len(sequences)
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        name = np.flatnonzero(lengths)
        lengths = lengths[name]
        symbols = self.bytes[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = _NONE
        while len(name):
            starts = ends - lengths
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[name[i]] = symbols[starts[i]:ends[i]]
                left = np.repeat(~done, lengths)
                symbols, rank = symbols[left], rank[left]
                name, lengths, lowest = name[~done], lengths[~done], lowest[~done]
                ends = np.cumsum(lengths)
                if not len(name):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # Of places that overlap (a letter that repeats) every second one counts, from the left.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            symbols[hit] = self.joined[rank[hit]]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[hit + 1] = True
            lengths = lengths - np.add.reduceat(gone, ends - lengths, dtype=np.int64)
            symbols, rank = symbols[~gone], rank[~gone]
            ends = np.cumsum(lengths)
            new = hit - np.arange(len(hit))
            following = np.minimum(new + 1, len(symbols) - 1)
            rank[new] = self._rank(symbols[new], symbols[following])
            new = new[new > 0]
            rank[new - 1] = self._rank(symbols[new - 1], symbols[new])
            rank[ends - 1] = _NONE
        return out

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols of each sequence survive, a bounded number of symbols at a time."""
        found, batch, size = [], [], 0
        for s in sequences:
            if batch and size + len(s) > SYMBOLS:
                found += map(len, self.merge(batch))
                batch, size = [], 0
            batch.append(s)
            size += len(s)
        found += map(len, self.merge(batch))
        return np.array(found, dtype=np.int64)


def chunks(text: str) -> list[str]:
    """Parts of a text that tokenize on their own; one that starts with neither a line end nor " " lacks its blank.

    The first part is whole. Cuts lie before single blanks and line ends; a text with two blanks in a row is cut
    into its pre-tokens instead, each marked by a leading "\\n\\n".
    """
    if _TWO_BLANKS.search(text):
        return ["", *["\n\n" + p for p in _PRETOKEN.findall(text)]]
    return text.replace("\n", " \n").split(" ")


def whole(chunk: str) -> str:
    """The characters that a chunk after the first stands for."""
    return chunk[2:] if chunk.startswith("\n\n") else chunk if chunk.startswith("\n") else " " + chunk


class ChunkTable:
    """What `compute` gives for the chunks of texts; the first `most` chunks met are remembered."""

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = REMEMBERED):
        self.compute, self.most, self.known = compute, most, {}

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """The values of every text's chunks. All new chunks are computed at once."""
        get = self.known.get
        for t in texts:
            t[0] = "\r\r" + t[0]
        found = [list(map(get, t)) for t in texts]
        holes = [i for i, values in enumerate(found) if None in values]
        new = list({c for i in holes for c, v in zip(texts[i], found[i], strict=True) if v is None})
        values = self.compute([c[2:] if c.startswith("\r\r") else whole(c) for c in new])
        fresh = dict(zip(new, values, strict=True))
        for i in holes:
            found[i] = [fresh[c] if v is None else v for c, v in zip(texts[i], found[i], strict=True)]
        if len(self.known) < self.most:
            self.known.update(fresh)
        return found


@lru_cache(maxsize=2)
def _counter(path: str) -> tuple[RankMerger, ChunkTable]:
    merger = RankMerger(path)

    def count(parts: list[str]) -> np.ndarray:
        split = [_PRETOKEN.findall(p) for p in parts]
        distinct = list(set().union(*split))
        size = dict(zip(distinct, merger.count([t.encode() for t in distinct]).tolist(), strict=True))
        get = size.__getitem__
        return [sum(map(get, s)) for s in split]

    return merger, ChunkTable(count)


def count_tokens(texts: Iterable[str], path: str) -> list[int]:
    """Token counts of a batch of texts."""
    merger, table = _counter(path)
    out, held, size = [], [], 0

    def flush():
        counts = iter(table.look_up([c for parts in held for c in parts]))
        for parts in held:
            out.append(sum(sum(next(counts)) for _ in parts) + len(parts) - 1)
        held.clear()

    for text in texts:
        text = text or ""
        parts = merger.split_special(text) if any(s in text for s in merger.special) else [text]
        held.append([chunks(p) for p in parts])
        size += len(text)
        if size > SYMBOLS:
            flush()
            size = 0
    flush()
    return out


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> tuple[DataFrame, str]:
    """`docs` with a struct more (n_bytes, n_tokens, over_limit), and its name. `path`: a byte-level BPE file."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts, path), dtype="int64")

    name = free_name(docs, "tokens")
    n = count(col(text_col))
    out = docs.withColumn(name, n)
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long")
    return out.withColumn(
        name, F.struct(size.alias("n_bytes"), col(name).alias("n_tokens"), (col(name) > limit).alias("over_limit"))
    ), name
