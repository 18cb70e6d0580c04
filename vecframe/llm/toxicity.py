"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has a logistic score over selected words and beginnings of words, as an insult may be inflected in more
forms than the labels can show one by one; a document is toxic if any sentence is, so its score is the noisy-or
1 - prod(1 - p). The weights are trained from document labels alone, through the noisy-or.

Training sees at most `SAMPLE` labelled documents (those with the smallest hash of their id). Word counts by
label are a Spark aggregation; the fit gets, for each of these documents, the selected words of its sentences.

Defined results: a null or empty text has no sentence and score 0; a null label is no label; an id labelled
twice is toxic if any of its labels is; without toxic or without clean training documents all scores are 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name, text_or_empty
from vecframe.session import ship

# Labelled documents that a fit may see.
SAMPLE = 20_000
# Words and beginnings a model may weigh, and the least likelihood ratio statistic of their link to toxic sentences.
WORDS, SURE = 2_000, 25.0
# Letters of the beginnings of words; a beginning is written with a "*" after it, which no word has.
STEMS = (3, 4, 5, 6)
# A document is rejected from this score on.
THRESHOLD = 0.5
# Steps of the fit, its step length, and the pull of all weights towards 0.
STEPS, STEP, PULL = 400, 0.05, 1e-4

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    """Weights of words and beginnings, and the bias, of a sentence's logit."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._near = starts(self.weights)

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, probability) of the sentences with a weighted word, and how many have none."""
        found, plain, text = [], 0, text or ""
        get, near = self.weights.get, self._near
        for m in _SENTENCE.finditer(text):
            words = set(_WORD.findall(m[0].lower()))
            if not words:
                continue
            hits = [w for w in map(get, marks(words, near)) if w is not None]
            if hits:
                found.append((m.start(), m.end(), _logistic(self.bias + sum(hits))))
            else:
                plain += 1
        return found, plain

    def score(self, text: str | None) -> float:
        return self.combined(*self.sentences(text))

    def combined(self, found: list[tuple[int, int, float]], plain: int) -> float:
        """The noisy-or of all sentences of a text."""
        clean = plain * math.log1p(-_logistic(self.bias))
        for _, _, p in found:
            clean += math.log1p(-min(p, 1 - 1e-12))
        return -math.expm1(clean)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def starts(chosen) -> frozenset[str]:
    """The first letters of words that can have any of the chosen words and beginnings."""
    return frozenset(m.rstrip("*")[:STEMS[0]] for m in chosen)


def marks(words: set[str], near: frozenset[str]) -> set[str]:
    """Those words that begin as `near` (see `starts`) says, and their beginnings."""
    first = STEMS[0]
    some = {w for w in words if w[:first] in near}
    return some.union(w[:k] + "*" for w in some for k in STEMS if len(w) >= k)


def distinct_marks(found: list[tuple[str, int, int]]) -> list[str]:
    """Of (mark, toxic sentences, sentences): the marks, but of nested ones that occur as often only the longest beginning."""
    have = set(found)

    def within(mark: str, *counts: int) -> bool:
        longer = (o for o, *others in by_start[mark[:STEMS[0]]] if others == list(counts) and o.endswith("*"))
        stem = mark.rstrip("*")
        return any(o != mark and (mark.startswith(o[:-1]) if mark == stem else o.startswith(stem)) for o in longer)

    by_start: dict[str, list] = {}
    for one in have:
        by_start.setdefault(one[0][:STEMS[0]], []).append(one)
    return [mark for mark, *counts in found if not within(mark, *counts)]


def _marks(text: Column) -> Column:
    """Distinct lower-case words of a text, and their beginnings."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))

    def begun(size: int) -> Column:
        long = F.filter(words, lambda w: F.char_length(w) >= size)
        return F.transform(long, lambda w: F.concat(F.substring(w, 1, size), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(begun, STEMS)))


def _evidence(c1: Column, c: Column, share: float) -> Column:
    """Likelihood ratio statistic for a share of c1 in c above `share`; 0 where it is below."""
    c0 = c - c1
    part = lambda n, p: F.when(n > 0, n * F.log(n / (c * p))).otherwise(0.0)
    return F.when(c1 > c * share, 2 * (part(c1, share) + part(c0, 1 - share))).otherwise(0.0)


def labelled(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    usable: Column | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """id, text, label of at most `sample` labelled documents; `usable` filters the labels (by their id_col)."""
    picked = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull())
    if usable is not None:
        picked = picked.filter(usable)
    picked = (
        picked.groupBy(col(id_col).alias("id")).agg(F.max(col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "id")


def fit(train: DataFrame, words: int = WORDS, sure: float = SURE) -> ToxicityModel:
    """A model from (text, label) rows."""
    train = train.select("text", "label")
    # A sentence that a clean document has is clean; copies of a document count once.
    sentences = (
        train.select("label", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence"))
        .groupBy("sentence").agg(F.min("label").alias("label"))
    )
    counts = (
        sentences.select("label", F.explode(_marks(F.col("sentence"))).alias("word"))
        .groupBy("word").agg(F.sum("label").alias("c1"), F.count(F.lit(1)).alias("c"))
    )
    n = {r["label"]: r["count"] for r in sentences.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()
    sure_ones = (
        counts.withColumn("g", _evidence(F.col("c1"), F.col("c"), n1 / (n1 + n0)))
        .filter(F.col("g") >= sure).orderBy(F.desc("g"), "word").limit(words).collect()
    )
    chosen = distinct_marks([(r["word"], r["c1"], r["c"]) for r in sure_ones])
    place, near = {w: i for i, w in enumerate(chosen)}, starts(chosen)

    @F.pandas_udf("plain int, sizes binary, places binary")
    def bags(texts: pd.Series) -> pd.DataFrame:
        """Sentences with words but no chosen one; how many chosen ones each other sentence has, and their places."""
        out = []
        for text in texts:
            found, plain = [], 0
            for m in _SENTENCE.finditer(text):
                split = set(_WORD.findall(m[0].lower()))
                hit = sorted(place[w] for w in marks(split, near) if w in place)
                if hit:
                    found.append(hit)
                else:
                    plain += bool(split)
            sizes, places = map(len, found), chain.from_iterable(found)
            out.append((plain, *(np.fromiter(some, dtype="<u4").tobytes() for some in (sizes, places))))
        return pd.DataFrame(out, columns=["plain", "sizes", "places"])

    ship(train.sparkSession)
    rows = train.select("label", bags("text").alias("bags")).select("label", "bags.*").toArrow()
    bias, weights = _noisy_or(rows, len(chosen))
    return ToxicityModel(bias, dict(zip(chosen, weights.tolist(), strict=True)))


def _noisy_or(bags: pa.Table, size: int) -> tuple[float, np.ndarray]:
    """Bias and weights that fit the labels best, by Adam on the noisy-or's log-likelihood."""
    plain, labels = (bags.column(c).to_numpy().astype(float) for c in ("plain", "label"))
    sizes, places = ([np.frombuffer(b.as_py(), dtype="<u4") for b in bags.column(c)] for c in ("sizes", "places"))
    doc = np.repeat(np.arange(len(sizes)), list(map(len, sizes)))
    sizes, word = (np.concatenate(some).astype(np.int64) for some in (sizes, places))
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.zeros(size + 1)
    theta[-1] = -6.0
    theta[:-1] = 4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        base = 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)) + plain * math.log1p(-base)
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # d(log-likelihood) / d(sum of logits' p): -1 for a clean document, (1 - toxic) / toxic for a toxic one.
        outer = np.where(labels > 0, (1 - toxic) / toxic, -1.0) / len(labels)
        inner = outer[doc] * p
        slope = np.append(np.bincount(word, inner[sentence], size), inner.sum() + (outer * plain).sum() * base)
        slope[:-1] -= PULL * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta += STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with a column more, and its name: score, and the offending sentences (start, end, p >= 0.5)."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, sentences array<struct<start: int, end: int, p: double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        rows = []
        for text in texts:
            found, plain = model.sentences(text)
            bad = [{"start": a, "end": b, "p": p} for a, b, p in found if p >= THRESHOLD]
            rows.append((min(1.0, max(0.0, model.combined(found, plain))), bad))
        return pd.DataFrame(rows, columns=["score", "sentences"])

    name = free_name(docs, "toxicity")
    return docs.withColumn(name, run(col(text_col))), name


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents with a score below `threshold`, with their columns."""
    scored, name = score(docs, model, text_col)
    return scored.filter(col(name)["score"] < threshold).select(*[col(c) for c in docs.columns])
