"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the forward recursion.

Tokens are the words of a text and one end. The `HEAD` most frequent words and the end have emission
probabilities of their own in every state; all other words share the class "tail", in which a word's share
follows its training count. What is sent to the tasks (head words and parameters) is bounded by `HEAD` and
`STATES`; counts of tail words meet the texts in a shuffle join.

Training: the words are counted over all training texts and give seeded random emissions near the corpus shares;
then every pass is one Spark job in which tasks run forward-backward over all training texts, whole, and the
expected counts are summed by token, until a pass gains less than `TOLERANCE`. Scores: the scaled forward recursion
over the whole text. In both, beyond `DIRECT` tokens the text falls into segments whose transfer matrices carry the
state weights over the cuts, which is the same recursion.

Defined results: a null or empty text is the end alone; repeated rows are scored and learned one by one; a null
id is training data; with no training texts N is 0 and every token is unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.common import col
from vecframe.session import ship, write_and_read

# States, words with emissions of their own (at most 65,000).
STATES, HEAD = 8, 50_000
# Training ends with the pass that gains less than this log10 likelihood per token (a thousandth of a nat).
TOLERANCE = 1e-3 / math.log(10)
# Tokens of a text that one lane runs over, and of a segment of a longer text.
DIRECT, FAR_SEGMENT = 2048, 128
# Tokens that are held as arrays at once; distinct words that a task counts before it hands them on.
TOKENS, DISTINCT = 800_000, 500_000
# State weights that run on over texts at once, and tokens between two scalings of them: far fewer than would leave the
# range of double precision. In single precision, weights that fall below `SMALLEST` in between are scaled at each token.
GROUPED, RESCALED, SMALLEST = 40_000, 8, 1e-25
# Tokens that are worked on at once, as far as that is no recursion.
PORTION = 4096
# Weight of the corpus shares in every state's emissions, and of even transitions.
PRIOR, EVEN = 20.0, 1.0


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of bytes other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@dataclass
class Vocabulary:
    """Head words (the end follows them, then the class tail) and the counts of the training texts."""

    head: dict[bytes, int]
    counts: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return len(self.head)

    @property
    def tail(self) -> int:
        return len(self.head) + 1

    @property
    def tail_mass(self) -> int:
        """Tail tokens, distinct tail words and one: what shares of the tail are taken of."""
        in_tail = self.tokens - int(self.counts.sum()) - self.texts
        return in_tail + self.distinct - (len(self.head) + (self.texts > 0)) + 1

    def shares(self) -> np.ndarray:
        """Corpus shares of head words, end and tail, none of them 0."""
        n = np.append(self.counts + 0.5, [self.texts + 0.5, self.tail_mass])
        return n / n.sum()


@dataclass
class Hmm:
    """start: of a text; inner: of any token at a cut (known for reference); step: transitions; emit: tokens by states."""

    start: np.ndarray
    inner: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @cached_property
    def relative(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions as shares of each token's largest, in single precision, and log10 of that largest."""
        most = self.emit.max(1)
        return (self.emit / most[:, None]).astype(np.float32), np.log10(most)


# ---- counts -----------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c over all rows. Tasks hand on partial counts after `DISTINCT` different words."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words_of(text))
                if len(held) > DISTINCT:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return (
        texts.select(col(text_col).alias("text")).mapInPandas(run, "word string, c long")
        .groupBy("word").agg(F.sum("c").alias("c"))
    )


def _counted(held: Counter) -> pd.DataFrame:
    words = pd.Series([w.decode("utf-8", "surrogatepass") for w in held], dtype=object)
    return pd.DataFrame({"word": words, "c": list(held.values())})


def vocabulary(counts: DataFrame, texts: int, head: int = HEAD) -> Vocabulary:
    """The most frequent words (at most `head`, fetched) and totals of a table of word counts."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Counts by size class (some hundreds) say from which class on words can be among the most frequent: what tasks
    # send is then near `head` rows together, not each.
    size = F.floor(F.log2("c") * 16)
    least, held = 0, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        least, held = r["size"], held + r["count"]
        if held >= head:
            break
    top = counts.filter(size >= least).orderBy(F.desc("c"), "word").limit(head).collect()
    names = {r["word"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(top)}
    return Vocabulary(
        names, np.array([r["c"] for r in top], dtype=np.int64), texts, (total["n"] or 0) + texts,
        total["v"] + (texts > 0),
    )


def encode(docs: DataFrame, vocabulary, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """row, id (as text), held_out, ids (16-bit numbers, end included), tail (words of the class tail)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary.value
        get, tail, end = words.head.get, words.tail, (words.end,)
        for batch in batches:
            ids, rest = [], []
            for text in batch["text"]:
                split = words_of(text)
                coded = np.fromiter(chain(map(get, split, repeat(tail)), end), dtype="<u2", count=len(split) + 1)
                rest.append([split[i].decode("utf-8", "surrogatepass") for i in np.flatnonzero(coded == tail).tolist()])
                ids.append(coded.tobytes())
            yield batch[["row", "id", "held_out"]].assign(ids=ids, tail=rest)

    given = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("string").alias("id"),
        held_out.alias("held_out"), col(text_col).alias("text"),
    )
    return given.mapInPandas(run, "row long, id string, held_out boolean, ids binary, tail array<string>")


# ---- forward and backward ---------------------------------------------------------------------------------------


def _lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by falling length, tokens, sequences still running at each time, place of each time's first token).

    Tokens lie by time, at each time those of the running sequences in that order, so nothing is padded: a long
    sequence beside many short ones takes its own room only.
    """
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    running = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
    at = np.concatenate([[0], np.cumsum(running)])
    flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.empty(0, dtype=np.int64)
    tokens, place = np.empty(len(flat), dtype=np.int64), np.cumsum(lengths) - lengths
    for start, stop in _portions(at):
        if running[start] > running[stop - 1]:
            found = [flat.take(place[:running[t]] + t) for t in range(start, stop)]
        else:
            found = flat.take(place[:running[start]] + np.arange(start, stop)[:, None])
        np.concatenate(found, out=tokens[at[start]:at[stop]])
    return order, tokens, running, at


def expected_counts(
    model: Hmm, sequences: list[np.ndarray], first: np.ndarray, before: np.ndarray | None = None,
    after: np.ndarray | None = None, every: int = RESCALED,
) -> tuple:
    """Baum-Welch counts of segments: (emissions, transitions, starts of texts, states after cuts, log10 likelihood).

    `first` says which segments begin a text. `before` has the state weights at the token before each of the others,
    `after` the backward weights at each segment's last token (absent: every segment is a whole text). No segment is
    empty. Weights are scaled every so many tokens, or at each where single precision would not hold them until then.
    """
    order, tokens, running, at = _lanes(sequences)
    begins = first[order]
    n, s = len(sequences), len(model.start)
    step, ones = model.step.astype(np.float32), np.ones(s, dtype=np.float32)
    back = np.ascontiguousarray(step.T)
    emit, most = model.relative
    begin = np.repeat(model.start[None], n, 0)
    if before is not None:
        carried_in = before[order][~begins]
        begin[~begins] = carried_in @ model.step
    # A block of running sequences by states for each time, one after the other in memory: the emissions of a token
    # are read at once. Blocks go in portions that stay in a core's cache, so what is not a recursion is done to many.
    alpha, by_state = np.empty((len(tokens), s), dtype=np.float32), np.empty((s, len(tokens)), dtype=np.float32)
    at, portions = at.tolist(), _portions(at)
    shares = {}
    now = None
    for start, stop in portions:
        emitted = emit.take(tokens[at[start]:at[stop]], axis=0)
        for t in range(start, stop):
            last, now = now, alpha[at[t]:at[t + 1]]
            if t:
                np.matmul(last[:len(now)], step, out=now)
            else:
                now[:] = begin
            now *= emitted[at[t] - at[start]:at[t + 1] - at[start]]
            if t % every == every - 1:
                shares[t] = now @ ones
                now /= shares[t][:, None]
    lengths = np.array([len(sequences[i]) for i in order])
    last = alpha[np.array(at)[lengths - 1] + np.arange(n)].astype(np.float64)
    ends = np.ones((n, s)) if after is None else after[order]
    scales = np.concatenate([last.sum(1), *shares.values()])
    likelihood = float(np.bincount(tokens, minlength=len(most)) @ most + np.log10(scales).sum())
    ends = (ends / (last * ends).sum(1, keepdims=True)).astype(np.float32)
    # Backward weights, and what lies ahead of a token: emissions by backward weights of the next, 0 after the last.
    moved, beta = np.zeros((s, s)), ends[:0]
    for start, stop in reversed(portions):
        rows = slice(at[start], at[stop])
        emitted = emit.take(tokens[at[start + 1]:at[min(stop + 1, len(running))]], axis=0)
        ahead, behind = np.empty((2, at[stop] - at[start], s), dtype=np.float32)
        for t in range(stop - 1, start - 1, -1):
            a, k = at[t] - at[start], len(beta)
            part, b = ahead[a:a + k], at[t + 1] - at[start + 1]
            np.multiply(emitted[b:b + k], beta, out=part)
            if t + 1 in shares:
                part /= shares[t + 1][:, None]
            beta = behind[a:at[t + 1] - at[start]]
            np.matmul(part, back, out=beta[:k])
            if k < len(beta):
                ahead[a + k:a + len(beta)], beta[k:] = 0, ends[k:len(beta)]
        # Forward weights turn into those of both directions.
        both = alpha[rows]
        moved += both.T @ ahead
        both *= behind
        np.multiply(both.T, 1 / (both @ ones), out=by_state[:, rows])
    if every > 1 and not (scales.min() > SMALLEST and np.isfinite(moved).all()):
        return expected_counts(model, sequences, first, before, after, 1)
    emitted = np.stack([np.bincount(tokens, weights, len(emit)) for weights in by_state], axis=1)
    moved *= model.step
    begun = by_state[:, :n].T.astype(np.float64)
    begun /= begun.sum(1, keepdims=True)
    if before is not None:
        moved += (carried_in.T @ (begun[~begins] / begin[~begins])) * model.step
    return emitted, moved, begun[begins].sum(0), begun[~begins].sum(0), likelihood


def _portions(at: np.ndarray) -> list[tuple[int, int]]:
    """(first time, after the last) of portions of about `PORTION` tokens, or of single times."""
    return _runs(at[:-1] // PORTION)


def text_counts(model: Hmm, texts: list[np.ndarray], direct: int = DIRECT, far: int = FAR_SEGMENT) -> tuple:
    """`expected_counts` of whole texts (none is empty); those beyond `direct` tokens in segments with carried weights."""
    total = None
    short = [t for t in texts if len(t) <= direct]
    if short:
        total = expected_counts(model, short, np.ones(len(short), dtype=bool))
    cut = [segments(t, far) for t in texts if len(t) > direct]
    if cut:
        before, after = carried(model, cut)
        first = np.array([i == 0 for parts in cut for i in range(len(parts))])
        flat = [part for parts in cut for part in parts]
        many = max(1, TOKENS // far)
        for i in range(0, len(flat), many):
            part = slice(i, i + many)
            found = expected_counts(model, flat[part], first[part], before[part], after[part])
            total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
    return total


def carried(model: Hmm, texts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The state weights before, and the backward weights at the last token of, each segment of each cut text."""
    s = len(model.start)
    now = model.start * model.emit[[parts[0][0] for parts in texts]]
    now = (now / now.sum(1, keepdims=True))[:, None, :].astype(np.float32)
    heads, _ = _advance(model, now, [parts[0][1:] for parts in texts])
    rest = [part for parts in texts for part in parts[1:]]
    moves, _ = _advance(model, np.repeat(np.eye(s, dtype=np.float32)[None], len(rest), 0), rest)
    heads, moves = heads.astype(np.float64), moves.astype(np.float64)
    parts = np.array([len(t) for t in texts])
    start = np.cumsum(parts) - parts
    before, after = np.zeros((parts.sum(), s)), np.ones((parts.sum(), s))
    now = _scaled(heads[:, 0])
    for i in range(1, parts.max()):  # of all texts at once
        live = np.flatnonzero(parts > i)
        at = start[live] + i
        before[at] = now[live]
        now[live] = _scaled(np.einsum("ks,ksj->kj", now[live], moves[at - live - 1]))
    for i in range(parts.max() - 1, 0, -1):
        live = np.flatnonzero(parts > i)
        at = start[live] + i
        after[at - 1] = _scaled(np.einsum("ksj,kj->ks", moves[at - live - 1], after[at]))
    return before, after


def _scaled(weights: np.ndarray) -> np.ndarray:
    return weights / weights.sum(1, keepdims=True)


def new_model(counts: tuple, shares: np.ndarray) -> Hmm:
    """The model of expected counts. Emissions lean on the corpus shares, transitions on even ones."""
    emitted, moved, start, inner = (np.asarray(c, dtype=np.float64) for c in counts[:4])
    s = len(start)
    emit = emitted + PRIOR * shares[:, None]
    return Hmm(
        (start + EVEN) / (start + EVEN).sum(), (inner + EVEN) / (inner + EVEN).sum(),
        (moved + EVEN / s) / (moved + EVEN / s).sum(1, keepdims=True), emit / emit.sum(0),
    )


def segments(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [ids[i:i + size] for i in range(0, len(ids), size)]


def random_model(shares: np.ndarray, states: int, seed: int = 7) -> Hmm:
    """Seeded random emissions around the corpus shares, and states that tend to stay."""
    chance = np.random.default_rng(seed)
    emit = shares[:, None] * chance.uniform(0.2, 1.8, (len(shares), states))
    even = np.full(states, 1 / states)
    return Hmm(even, even, 0.6 * np.eye(states) + 0.4 / states, emit / emit.sum(0))


def fit(encoded: DataFrame, words: Vocabulary, states: int, tolerance: float = TOLERANCE) -> Hmm:
    """Passes over all rows of `encoded` from a random model until one gains less than `tolerance` per token."""
    sc, shares = encoded.sparkSession.sparkContext, words.shares()
    model, last = random_model(shares, states), -math.inf
    while words.tokens:
        sent = sc.broadcast(model)
        counts = one_pass(encoded, sent, states, len(shares))
        sent.unpersist()
        model = new_model(counts, shares)
        if counts[4] - last < tolerance * words.tokens:
            break
        last = counts[4]
    return model


def one_pass(encoded: DataFrame, model, states: int, size: int) -> tuple:
    """Expected counts of all rows of `encoded` (ids) under a broadcast model, summed by token over the tasks."""
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for texts in _training_batches(batches):
            found = text_counts(model.value, texts)
            total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        if total is not None:
            emitted, moved, start, inner, likelihood = total
            used = np.flatnonzero(emitted.any(1))
            rest = np.vstack([moved, start, inner, np.append(likelihood, np.zeros(states - 1))])
            out = pd.DataFrame(np.vstack([emitted[used], rest]), columns=names)
            out.insert(0, "token", np.append(used, size + np.arange(len(rest))).astype(np.int64))
            yield out

    sums = (
        encoded.select("ids").mapInPandas(run, "token long, " + ", ".join(f"{n} double" for n in names))
        .groupBy("token").agg(*[F.sum(n).alias(n) for n in names])
    )
    table = np.zeros((size + states + 3, states))
    for r in sums.collect():  # a row for each head word at most
        table[r["token"]] = r[1:]
    rest = table[size:]
    return table[:size], rest[:states], rest[states], rest[states + 1], rest[states + 2][0]


def _training_batches(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    held, tokens = [], 0
    for batch in batches:
        for raw in batch["ids"]:
            held.append(np.frombuffer(raw, dtype="<u2").astype(np.int64))
            tokens += len(held[-1])
            if tokens > TOKENS:
                yield held
                held, tokens = [], 0
    if held:
        yield held


def _advance(model: Hmm, state: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs rows of scaled state weights (sequences x rows x states) on over sequences: (state, log10 of the scale).

    Sequences go in groups whose weights stay in a core's cache, and weights are scaled every few tokens. They have the
    precision of `state`; single precision turns into double where it would not hold them until they are scaled.
    """
    n, rows, s = state.shape
    narrow = state.dtype == np.float32
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    done, logs = np.empty_like(state), np.empty(n)
    emit, most = model.relative if narrow else (model.emit, np.zeros(len(model.emit)))
    step = model.step.astype(state.dtype)
    group = max(1, GROUPED // (rows * s))
    for first in range(0, n, group):
        mine = order[first:first + group]
        _, tokens, running, at = _lanes([sequences[i] for i in mine])
        # Rows by sequences by states: the emissions of a token are read at once and go with each row.
        now = np.ascontiguousarray(state[mine].transpose(1, 0, 2))
        log, ended = np.zeros(len(mine)), np.empty_like(now)
        for t, k in enumerate(running.tolist()):
            if k < now.shape[1]:
                ended[:, k:now.shape[1]] = now[:, k:]
                now = np.ascontiguousarray(now[:, :k])
            now = (now.reshape(-1, s) @ step).reshape(rows, k, s)
            now *= emit.take(tokens[at[t]:at[t + 1]], axis=0)
            if t % RESCALED == RESCALED - 1:
                scale = now.sum(0).sum(1)
                if narrow and not scale.min() > SMALLEST:
                    return _advance(model, state.astype(np.float64), sequences)
                now /= scale[:, None]
                log[:k] += np.log10(scale)
            if narrow:
                log[:k] += most[tokens[at[t]:at[t + 1]]]
        ended[:, :now.shape[1]] = now
        scale = ended.sum(0).sum(1)
        if narrow and not scale.min() > SMALLEST:
            return _advance(model, state.astype(np.float64), sequences)
        done[mine], logs[mine] = (ended / scale[:, None]).transpose(1, 0, 2), log + np.log10(scale)
    return done, logs


def log_likelihoods(model: Hmm, texts: list[np.ndarray], direct: int = DIRECT, far: int = FAR_SEGMENT) -> np.ndarray:
    """log10 probability of each sequence of tokens (none is empty)."""
    s = len(model.start)
    now = model.start * model.emit[[t[0] for t in texts]]
    scale = now.sum(1)
    out = np.log10(scale)
    now, logs = _advance(model, (now / scale[:, None])[:, None, :], [t[1:direct] for t in texts])
    out += logs
    parts = [segments(t[direct:], far) for t in texts]
    cut = [part for of_text in parts for part in of_text]
    if cut:
        moves, logs = _advance(model, np.repeat(np.eye(s)[None], len(cut), 0), cut)
        many = np.array([len(of_text) for of_text in parts])
        start, now = np.cumsum(many) - many, now[:, 0]
        for i in range(many.max()):  # of all texts at once
            live = np.flatnonzero(many > i)
            ahead = np.einsum("ks,ksj->kj", now[live], moves[start[live] + i])
            total = ahead.sum(1)
            now[live] = ahead / total[:, None]
            out[live] += np.log10(total) + logs[start[live] + i]
    return out


# ---- the whole --------------------------------------------------------------------------------------------------


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
    head: int = HEAD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from those not held out."""
    spark = ship(docs.sparkSession)
    sc = spark.sparkContext
    training = docs.filter(~held_out)
    counts = write_and_read(word_counts(training, text_col), "words")
    words = vocabulary(counts, training.count(), head)
    sent_words = sc.broadcast(words)
    # Texts of like lengths side by side: the lanes of a batch then end together.
    coded = encode(docs, sent_words, held_out, id_col, text_col).sortWithinPartitions(F.length("ids"))
    encoded = write_and_read(coded, "encoded")
    model = fit(encoded.filter(~F.col("held_out")), words, states, tolerance)
    sent = sc.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.log10(np.append(sent_words.value.counts, [sent_words.value.texts, 0]) + 1)
        has = np.append(sent_words.value.counts, [sent_words.value.texts, 0]) > 0
        for batch in batches:
            texts = [np.frombuffer(raw, dtype="<u2").astype(np.int64) for raw in batch["ids"]]
            cut = np.cumsum([len(t) for t in texts]) // TOKENS
            parts = [texts[a:b] for a, b in _runs(cut)]
            yield pd.DataFrame({
                "row": batch["row"], "id": batch["id"], "held_out": batch["held_out"],
                "n_tokens": [len(t) for t in texts],
                "head_known": [int(has[t].sum()) for t in texts],
                "head_base": [float(known[t].sum()) for t in texts],
                "path": np.concatenate([log_likelihoods(sent.value, p) for p in parts]) if parts else [],
            })

    scored = encoded.select("row", "id", "held_out", "ids").mapInPandas(
        run, "row long, id string, held_out boolean, n_tokens long, head_known long, head_base double, path double"
    )
    tail = (
        encoded.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
        .groupBy("row").agg(
            F.count(F.lit(1)).alias("n_tail"), F.count("c").alias("tail_known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_base"),
        )
    )
    zero = {"n_tail": 0, "tail_known": 0, "tail_base": 0.0}
    all_mass = math.log10(words.tokens + words.distinct + 1)
    return scored.join(tail, "row", "left").fillna(zero).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("tail_base") - F.col("n_tokens") * all_mass).alias("base_score"),
        (F.col("path") + F.col("tail_base") - F.col("n_tail") * math.log10(words.tail_mass)).alias("score"),
    )


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of runs of equal keys."""
    if not len(keys):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))
