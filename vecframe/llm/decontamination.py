"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is built from their normalised words, `CHUNK_WORDS` words at a time, and sent to
the tasks; its size is bounded by that number. Document words stream through it, and the longest match that
ends at each word tells which windows (runs of `window` words of an item, or a whole shorter item) end there.

Defined results: a null text has no words; an item without words has no window; an item with a null id
marks words but is not listed; items with the same id count once; empty tables give no rows or no marks;
repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.llm.common import col, free_name
from vecframe.session import ship

WINDOW = 10
# One automaton holds about this many item words (a few hundred bytes each); more items take more passes.
CHUNK_WORDS = 500_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


# Every byte as it counts in words: A-Z in lower case, blanks for what lies between words.
_PLAIN = bytes(b if _WORD.match(bytes([b])) else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of digits, letters and all that is not ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


class SuffixAutomaton:
    """All word runs of the items. `add` takes an item; `finish` prepares matching."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[list[int], str | None]] = []

    def add(self, words: list[bytes], name: str | None) -> None:
        coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
        if not coded:
            return
        last = 0
        for c in coded:
            last = self._extend(last, c)
        self.items.append((coded, name))

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p's run plus c has for its own, split off when it also stands for longer runs."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def finish(self) -> "SuffixAutomaton":
        """Names the items of each window's state; runs of known words shorter than any window need no look."""
        self.windows: dict[int, dict[int, set]] = {}
        self.shortest = min((min(len(c), self.window) for c, _ in self.items), default=1)
        for coded, name in self.items:
            size = min(len(coded), self.window)
            for _, state, _ in self._walk(coded, size):
                self.windows.setdefault(state, {}).setdefault(size, set()).add(name)
        self.items = []
        # For each state, the windows that end every run it stands for: its own and those of its suffixes.
        self.ends: list[int] = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.windows else self.ends[self.link[s]]
        return self

    def _walk(self, coded: list[int], size: int) -> Iterator[tuple[int, int, int]]:
        """(position, state that stands for the run of `size` words that ends there, length) within an item."""
        state = length = 0
        for i, c in enumerate(coded):
            state, length = self.next[state][c], length + 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
                length = self.length[state]
            length = min(length, self.length[state])
            if length >= size:
                yield i, state, size

    def match(self, coded: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first word, word after the last, names) of every window that occurs in the run of known words."""
        follow, link, lengths, windows, ends = self.next, self.link, self.length, self.windows, self.ends
        state = length = 0
        for i, c in enumerate(coded, 1):
            while state and c not in follow[state]:
                state = link[state]
                length = lengths[state]
            state = follow[state].get(c, 0)
            length = length + 1 if state else 0
            at = ends[state]
            while at > 0:
                for size, names in windows[at].items():
                    if size <= length:
                        yield i - size, i, names
                at = ends[link[at]] if link[at] > 0 else -1

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint hit spans in words, and the names of the items that occur."""
        if len(words) < self.shortest:
            return [], set()
        get = self.ids.get
        coded = np.fromiter([get(w, 0) for w in words], dtype=np.int32, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (coded > 0).astype(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for a, b in known.reshape(-1, 2).tolist():
            if b - a >= self.shortest:
                hits = []
                for i, j, names in self.match(coded[a:b].tolist()):
                    hits.append((a + i, a + j))
                    found |= names
                spans += merge_spans(hits)
        return spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(items: DataFrame, id_col: str, text_col: str, chunk_words: int) -> Iterator[list]:
    """Items in lists of about `chunk_words` words, read from Spark piece by piece; one list at least."""
    held, words = [], 0
    for r in items.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text")).toLocalIterator():
        split = words_of(r["text"])
        if held and words + len(split) > chunk_words:
            yield held
            held, words = [], 0
        held.append((split, r["id"]))
        words += len(split)
    yield held


def mark(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", chunk_words: int = CHUNK_WORDS, cut_above: int | None = None,
) -> tuple[DataFrame, str]:
    """`docs` with a struct column more: n_words, spans (array of first and end word), items (array of ids).

    Also returns the name of that column. One pass without a shuffle for all chunks of items. With `cut_above` the
    struct has rest too: the text without its spans of more words than that, null where it has none.
    """
    spark = ship(docs.sparkSession)
    name = free_name(docs, "contamination")
    kind = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    if cut_above is not None:
        kind = kind.add("rest", T.StringType())
    automata = []
    for chunk in _chunks(items, item_id, item_text, chunk_words):
        automaton = SuffixAutomaton(window)
        for words, id_ in chunk:
            automaton.add(words, id_)
        automata.append(spark.sparkContext.broadcast(automaton.finish()))
    return docs.withColumn(name, _scan(automata, kind, cut_above)(col(text_col))), name


def _scan(automata: list, kind: T.StructType, cut_above: int | None):
    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            spans, items = [], set()
            for automaton in automata:
                now, names = automaton.value.find(words)
                spans = merge_spans(spans + now) if spans else now
                items |= names
            rest = ()
            if cut_above is not None:
                long = [s for s in spans if s[1] - s[0] > cut_above]
                rest = (cut_words(text, long) if long else None,)
            rows.append((len(words), [list(s) for s in spans], sorted(n for n in items if n is not None), *rest))
        return pd.DataFrame(rows, columns=kind.names)

    # Else a filter on the result is moved below it, and all texts are scanned once more there, by more workers.
    return scan.asNondeterministic()


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5,
    text_col: str = "text", chars_col: str | None = "n_chars", **names,
) -> DataFrame:
    """`docs` with its columns, without benchmark passages.

    Hit spans of more than `max_span` words are cut out, from the first character of the first word to the
    last of the last. A document goes when more than `max_coverage` of its words lie in such spans.
    `chars_col`, where there is one, is brought up to date for texts that were cut. Others stay as they are.
    """
    marked, name = mark(docs, items, window, text_col, cut_above=max_span, **names)
    spans = F.filter(col(name)["spans"], lambda s: s[1] - s[0] > max_span)
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = marked.filter((F.size(spans) == 0) | (covered <= max_coverage * col(name)["n_words"]))
    rest = col(name)["rest"]
    hit = rest.isNotNull()
    out = out.withColumn(text_col, F.coalesce(rest, col(text_col)))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(hit, F.char_length(col(text_col)).cast(kind)).otherwise(col(chars_col)))
    return out.select(*[col(c) for c in docs.columns])


def cut_words(text: str | None, spans) -> str | None:
    """`text` without the word spans."""
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at = [], 0
    for a, b in sorted((int(s[0]), int(s[1])) for s in spans):
        kept.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def digest_of(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
