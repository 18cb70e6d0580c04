"""Secret scans: fixed patterns, and guess costs of values in a credential context.

A value that follows a credential word is split into words, dates, repeats, keyboard walks and brute-force
spans so that the guesses an attacker needs are fewest (dynamic programming over its characters). A value
that still costs many guesses is a secret. Words are the fixed list and the words of the documents themselves: a
Spark job counts the documents of every word outside credential values, and a word's rank is its guess number. The
`WORDS` words of most documents are sent to the tasks; a rarer one costs brute force.

Defined results: a null or empty text has no spans; spans are in code points with the end left out, by start
and then by kind; repeated rows are scanned one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name
from vecframe.session import ship

# Spans of equal start come in this order.
KINDS = ("assign", "access", "hex", "value")
# log10 of the guesses from which on a value counts as a secret, and the characters of a value that are weighed;
# a longer one is a secret if any part of so many characters is.
COSTLY, LONGEST = 9.0, 128
# Documents that a word of the table is in at least, words of the table, and distinct words a task counts before it
# hands them on.
LEAST, WORDS, DISTINCT = 5, 100_000, 200_000

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# A credential word, a sign that a value follows, and the value, quoted or not.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key"""
    r"""|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?|login|key)["']?"""
    r"""\x20{0,8}(?:=>|:=|[:=]|\x20is\x20)\x20{0,8}(?:(?:Bearer|Basic)\x20+)?["']?([^\s"'<>,;(){}\[\]|]{6,})""",
    re.I | re.A,
)

# Every match above has one of these.
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
_CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "auth", "bearer", "credential", "login")

# Words that guessers try first, the commonest first.
COMMON_WORDS = """
password qwerty admin welcome letmein monkey dragon master login abc iloveyou sunshine princess football
baseball shadow superman trustno hello freedom whatever secret test user root guest default changeme pass
access account temp demo example sample server system database service public private token apikey key
value string none null true false undefined your here the and for with this that from have not are was you
name work home love life time people world summer winter spring autumn monday friday january october
december company office email phone number computer internet security network manager hunter ninja
""".split()
# Rows of a keyboard.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_WORD = re.compile(r"[^\W\d_]{3,24}")
_WALKS = [r for row in KEYBOARD for r in (row, row[::-1])]
_PLAIN = str.maketrans("@4310$57!", "aaeiosstl")
_DATES = [re.compile(p) for p in (
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]|[1-9])",
    r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d",
    r"(?:19|20)\d\d",
)]


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def ranks(words: list[str]) -> dict[str, int]:
    """Guess numbers: of words, the commonest first, and of the fixed ones."""
    table = {w: i + 1 for i, w in enumerate(words)}
    return table | {w: min(r, table.get(w, r)) for w, r in _RANK.items()}


def word_table(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> list[str]:
    """The words of the most documents, the commonest first; values in a credential context do not count."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                lower = (text or "").lower()
                if any(h in lower for h in _CONTEXT_HINTS):
                    lower = _CONTEXT.sub(" ", lower)
                held.update(set(_WORD.findall(lower)))
                if len(held) > DISTINCT:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": list(held.values())})

    counts = (
        docs.select(col(text_col).alias("text")).mapInPandas(run, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    )
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def guess_cost(value: str, known: dict[str, int] = _RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the fewest guesses, and the parts (start, end, kind) of the cheapest segmentation."""
    n = len(value)
    lower = value.lower()
    plain = lower.translate(_PLAIN)
    brute = [math.log10(_alphabet(c)) for c in value]
    edges: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + 24) + 1):
            rank = known.get(lower[i:j])
            turned = rank is None and known.get(plain[i:j])
            if rank or turned:
                cost = math.log10(rank or turned) + 0.3 * (value[i:j] != lower[i:j]) + 0.6 * bool(turned)
                edges[i].append((j, cost, "word"))
        if value[i].isdigit():
            for j in {m.end() for m in (d.match(value, i) for d in _DATES) if m}:
                edges[i].append((j, 2.2 if j - i == 4 else 4.6, "date"))
        for size in range(1, (n - i) // 2 + 1):
            unit, j = value[i:i + size], i + size
            while len(unit) == size and value.startswith(unit, j):
                j += size
            if j > i + 2 * size or size > 1 and j > i + size:
                edges[i].append((j, sum(brute[i:i + size]) + math.log10((j - i) // size), "repeat"))
        for walk in _WALKS:
            at, j = walk.find(lower[i]), i
            while at >= 0 and j < n and at < len(walk) and lower[j] == walk[at]:
                at, j = at + 1, j + 1
            if j - i >= 3:
                edges[i].append((j, math.log10(len(_WALKS) * 10 * (j - i)), "walk"))
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for i in range(n):
        for j, cost, kind in [(i + 1, brute[i], "brute"), *edges[i]]:
            # Every part but a run of brute force costs the guesser a choice of what comes next.
            extra = 0.0 if kind == "brute" and (i == 0 or back[i][1] == "brute") else 0.3
            if best[i] + cost + extra < best[j]:
                best[j], back[j] = best[i] + cost + extra, (i, kind)
    parts, at = [], n
    while at:
        start, kind = back[at]
        if kind == "brute" and parts and parts[-1][2] == "brute" and parts[-1][0] == at:
            parts[-1] = (start, parts[-1][1], kind)
        else:
            parts.append((start, at, kind))
        at = start
    return best[n], parts[::-1]


def is_secret(value: str, costly: float = COSTLY, known: dict[str, int] = _RANK) -> bool:
    """Whether a value costs at least 10 ** `costly` guesses."""
    pieces = [value[i:i + LONGEST] for i in range(0, len(value), LONGEST)]
    return any(guess_cost(p, known)[0] >= costly for p in pieces)


def scan(text: str | None, costly: float = COSTLY, known: dict[str, int] = _RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then by kind."""
    if not text:
        return []
    lower, found = text.lower(), []
    if any(h in lower for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    covered = sorted((a, b) for _, a, b in found)
    for m in _CONTEXT.finditer(text) if any(h in lower for h in _CONTEXT_HINTS) else ():
        a, b = m.span(1)
        value = m[1].rstrip(".:!?")
        b = a + len(value)
        if len(value) >= 6 and not any(x < b and a < y for x, y in covered) and is_secret(value, costly, known):
            found.append(("value", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text_col: str = "text", costly: float = COSTLY) -> tuple[DataFrame, str]:
    """`docs` with an array of (kind, start, end) more, and the name of that column."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(ranks(word_table(docs, text_col)))

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, costly, sent.value)] for t in texts], dtype=object
        )

    name = free_name(docs, "secrets")
    return docs.withColumn(name, run(col(text_col))), name


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", costly: float = COSTLY) -> DataFrame:
    """`docs` with every span replaced by `mark`; overlapping spans by one."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(ranks(word_table(docs, text_col)))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            pieces, at = [], 0
            for _, a, b in scan(text, costly, sent.value):
                if a >= at:
                    pieces += [text[at:a], mark]
                at = max(at, b)
            out.append(text if text is None else "".join(pieces) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(col(text_col)))
