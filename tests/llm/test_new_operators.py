"""Window packing, token alignment and centroid clusters: plain versions, round trips and edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vecframe.llm import (
    centroid_clusters, html_text, language_model, near_dedup, packing, queries, token_alignment, window_packing,
)

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in (queries.WORDS, queries.VOCABULARY, queries.PIECES))
SCHEMA = "doc_id long, text string, length string, task int, nth int, copies int, pairs int, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, special strings, clashing names."""
    texts = [
        "one two three", "one two three", "", None, " ", "  two  blanks ", "ends in a blank ", "line\n\n end\t\x1c x\x85y",
        "<|endoftext|> in <s> text <0x41>", "has ▁ inside", "Ünï ΣΑΣ é ｆﬁ 日本語 🙂", "long " * 30_000, "q" * 20_000, "a'll 12 it's",
    ]
    rows = [(i, t, "x", 1, i, None, 3, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "one two three", *[None] * 6)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def invented(chance, n):
    alpha = list("abcdeé'. \n\t日1") + [" ", " ", " the", "<|endoftext|>", "Σ"]
    return ["".join(chance.choice(alpha) for _ in range(chance.randrange(0, 60))) for _ in range(n)]


# ---- window packing --------------------------------------------------------------------------------------------


def test_words_tokenize_as_the_library_does():
    chance = random.Random(1)
    alpha = list("aAbB 's 1Σ́éÉß\t\n\x0b\x1c\x85\xa0 　<|>日🙂'İ​﻿") + ["<|endoftext|>", " ", " the"]
    texts = ["".join(chance.choice(alpha) for _ in range(chance.randrange(0, 40))) for _ in range(4000)]
    latin = [chr(c) for c in (*range(33, 127), *range(160, 384))] + [" "] * 40 + ["'s", "'LL", "SS"]
    texts += ["".join(chance.choice(latin) for _ in range(chance.randrange(0, 40))) for _ in range(4000)]
    encoder, library = window_packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(2):  # new words, then known ones
        found = encoder.encode(texts)
        assert found == [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def best_fit_decreasing(sizes, capacity):
    """Room left in every window, by trying all of them for each piece."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= size]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def places(counts, capacity):
    """{window: [(offset, length), ...]} of a plan."""
    rows, found = sorted(window_packing.plan(counts, capacity)), collections.defaultdict(list)
    for length, n in counts.items():
        for nth in range(n):
            _, first, window, each, offset = [r for r in rows if r[0] == length and r[1] <= nth][-1]
            found[window + (nth - first) // each].append((offset + (nth - first) % each * length, length))
    return found


def test_plan_is_best_fit_decreasing():
    chance = random.Random(2)
    for _ in range(300):
        capacity = chance.randrange(1, 40)
        sizes = [chance.randrange(1, capacity + 1) for _ in range(chance.randrange(0, 80))]
        windows = places(collections.Counter(sizes), capacity)
        for pieces in windows.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in windows.values()) == best_fit_decreasing(sizes, capacity)
        assert set(windows) == set(range(len(windows)))


def test_plan_does_not_grow_with_the_corpus():
    counts = {n: 1 + n * 7919 % 50 for n in range(1, 2049)}
    few = len(window_packing.plan(counts, 2048))
    assert len(window_packing.plan({n: c * 1_000_000 for n, c in counts.items()}, 2048)) < 4 * few < 100_000


def check_windows(rows, texts, capacity):
    library, sequences = Tokenizer.from_file(WORDS), collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text, times in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, window_packing.END]
        found = collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc])
        wanted = {}
        for start in range(0, len(ids), capacity):
            part = ids[start:start + capacity]
            wanted[start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)] = times
        assert found == wanted
    return sequences


def test_pack_windows(spark, docs, none):
    found = window_packing.pack(window_packing.pieces(docs, WORDS)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    times = collections.Counter(r["doc_id"] for r in docs.collect())
    check_windows(found, [(i, t, times[i]) for i, t in texts.items()], 2048)
    assert window_packing.pack(window_packing.pieces(none, WORDS)).count() == 0
    chance = random.Random(3)
    texts = [(i, "a " * chance.choice([5, 5, 5, 60, chance.randrange(1, 300)])) for i in range(500)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    found = window_packing.pack(window_packing.pieces(table, WORDS, capacity=100), capacity=100).collect()
    windows = check_windows(found, [(i, t, 1) for i, t in texts], 100)
    rooms = sorted(100 - sum(n for _, n in p) for p in windows.values())
    assert rooms == best_fit_decreasing([r["length"] for r in found], 100)


# ---- token alignment -------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Every text on its own, whole, with all pairs of tokens tried."""
    a_library, b_library = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_library.encode_special_tokens = True
    letters = {c: b for b, c in window_packing_letters().items()}
    size = b_library.get_piece_size()
    spelt_b = [
        bytes([int(b_library.id_to_piece(i)[3:-1], 16)]) if b_library.is_byte(i)
        else b_library.id_to_piece(i).replace("▁", " ").encode() for i in range(size)
    ]
    rows, counts = [], collections.Counter()
    for text in texts:
        row = {"a": [], "b": [], "links": [], "groups": []}
        rows.append(row)
        if not text:
            continue
        a, b = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)
        words = [bytes(letters[c] for c in a_library.id_to_token(i)) for i in a], [spelt_b[i] for i in b]
        if any(b"".join(w) != (" " + text).encode() for w in words):
            continue
        spans = [[(sum(map(len, w[:i])), sum(map(len, w[:i + 1]))) for i in range(len(w))] for w in words]
        row["a"], row["b"] = a, b
        row["links"] = [
            (i, j) for i, s in zip(a, spans[0], strict=True) for j, t in zip(b, spans[1], strict=True)
            if s[0] < t[1] and t[0] < s[1]
        ]
        counts.update(row["links"])
        start = 0
        for end in sorted({s[1] for s in spans[0]} & {t[1] for t in spans[1]}):
            inside = [[str(i) for i, s in zip(ids, sp, strict=True) if start < s[1] <= end] for ids, sp in zip((a, b), spans, strict=True)]
            row["groups"].append("|".join(map(",".join, inside)))
            start = end
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (len(r["a"]), len(r["b"]), len(r["groups"]), len(r["links"]), sum(counts[x] == most[x[1]] for x in r["links"]),
         sum(counts[x] for x in r["links"]), hashlib.sha256(";".join(r["groups"]).encode()).hexdigest() if r["a"] else "")
        for r in rows
    ], counts


def window_packing_letters():
    from vecframe.llm.token_counts import byte_letters

    return byte_letters()


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [1, 20, token_alignment.HEAD])
def test_alignment_equals_all_pairs(spark, head):
    chance = random.Random(4)
    texts = invented(chance, 150) * 2 + ["the same"] * 60 + [None, "", " ", "a ▁ b", "c  ", "x  y", "\x1c z"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, pairs = token_alignment.align_documents(table, BYTES, PIECES, head=head, heavy=10)
    wanted, counts = plain_alignment(texts)
    rows = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in found.collect()}
    assert [rows[i] for i in range(len(texts))] == wanted and len(rows) == len(texts)
    assert {(r["id_a"], r["id_b"]): r["n"] for r in pairs.collect()} == counts


def test_segments_forgotten_and_learnt_anew(monkeypatch):
    texts = [t for t in invented(random.Random(5), 60) if t]
    whole = token_alignment.Aligner(BYTES, PIECES).measure(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 10)
    small = token_alignment.Aligner(BYTES, PIECES)
    for i, t in enumerate(texts):
        numbers, digests, pairs, times, n = small.measure([t])
        assert (numbers[0] == whole[0][i]).all() and digests[0] == whole[1][i] and n[0] == whole[4][i]


def test_alignment_edge_cases(docs, none):
    found, _ = token_alignment.align_documents(docs, BYTES, PIECES)
    rows = found.collect()
    assert len(rows) == docs.count() and found.columns == ["doc_id", *NAMES]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_a"] == by_id[3]["n_b"] == by_id[9]["n_links"] == 0 and by_id[9]["groups_sha256"] == ""
    assert by_id[None]["groups_sha256"] == by_id[0]["groups_sha256"] == by_id[1]["groups_sha256"] != ""
    assert by_id[11]["n_a"] == 30_001 and by_id[12]["n_a"] > 0 and by_id[8]["n_a"] > 0
    for r in rows:  # ends in common make one link of two
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
    assert token_alignment.align_documents(none, BYTES, PIECES)[0].count() == 0


# ---- centroid clusters -----------------------------------------------------------------------------------------


def test_nearest_is_the_nearest():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, dims, k = rng.integers(1, 30), rng.integers(1, 6), rng.integers(1, 12)
        x, c = rng.integers(-5, 6, (n, dims)), rng.integers(-5, 6, (k, dims))
        all_pairs = ((x[:, None] - c[None]) ** 2).sum(-1)
        winner, distance, taken = centroid_clusters.nearest(x, c)
        assert (winner == all_pairs.argmin(1)).all() and (distance == all_pairs.min(1)).all() and (taken <= k).all()


def test_walk_ends_early_where_lists_agree():
    """In few dimensions the frontier passes the best distance before all centroids are met."""
    c = np.arange(0, 4000, 100).reshape(-1, 1).repeat(2, axis=1)
    _, _, taken = centroid_clusters.nearest(np.array([[2, 3], [1999, 2001]]), c)
    assert (taken <= 4).all()


def plain_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def placed():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(min(range(len(row)), key=lambda j: (row[j], j)), min(row)) for row in d]

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (c, _), (_, v) in zip(placed(), kept, strict=True):
            members[c].append(v)
        for c, vs in members.items():
            centroids[c] = [sum(xs) // len(vs) for xs in zip(*vs, strict=True)]
    found = placed() if kept else []
    inertia = collections.Counter()
    for c, d in found:
        inertia[c] += d
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                  for (i, _), (c, d) in zip(kept, found, strict=True))


@pytest.mark.parametrize("n", [0, 3, 120])
def test_clusters_equal_a_plain_version(spark, n):
    rng = np.random.default_rng(7)
    bad = [None, [1.0], [], [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [0.0] * 5]
    rows = [(i // 2, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(n)]
    rows += [(1, [0.5] * 4)] * (n // 3) + ([(None, [0.25] * 4)] if n else []) + list(enumerate(bad, 900))
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, vec int, cluster int").repartition(5)
    placed, clusters = centroid_clusters.cluster(table, k=8, rounds=3, dims=4)
    found = centroid_clusters.with_inertia(placed, clusters).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"],
                   r["centroid_sha256"]) for r in found) == plain_clusters(rows, 8, 3, 4)
    assert sum(r["n"] for r in clusters.collect()) == len(found)


def test_component_too_large(spark):
    table = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters.cluster(table, k=2, dims=4)[0].collect()


# ---- language model: memory of mixed lengths ---------------------------------------------------------------------


def test_one_long_text_beside_many_short_ones_takes_its_own_room():
    """Arrays grow with the tokens of a batch, not with its texts times the longest of them."""
    import tracemalloc

    chance = np.random.default_rng(8)
    texts = [chance.integers(0, 50, 10) for _ in range(6000)]
    model = language_model.random_model(np.full(52, 1 / 52), 8)

    def peak(some):
        tracemalloc.start()
        language_model.text_counts(model, some)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    alone, mixed = peak(texts), peak([*texts, chance.integers(0, 50, 2000)])
    assert mixed < 1.3 * alone < 100_000_000
    both = language_model.text_counts(model, [texts[0], texts[1][:3], chance.integers(0, 50, 700)])
    assert both[0].sum() == pytest.approx(713, rel=1e-4)


def test_a_token_takes_few_arrays():
    """Forward weights and emissions of a batch are reused on the way back."""
    import tracemalloc

    chance = np.random.default_rng(8)
    texts = [chance.integers(0, 50, 200) for _ in range(500)]
    model = language_model.random_model(np.full(52, 1 / 52), 8)
    tracemalloc.start()
    counts = language_model.text_counts(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * 100_000
    assert counts[0].sum() == pytest.approx(100_000, rel=1e-4)


def test_training_calls_few_functions_for_each_time():
    """Scaling, lookups and sums are done for many token times at once; only the recursions go time by time."""
    import sys

    chance = np.random.default_rng(8)
    texts = [chance.integers(0, 50, 1000 + i % 3) for i in range(20)]
    model = language_model.random_model(np.full(52, 1 / 52), 8)
    called = []
    sys.setprofile(lambda frame, event, what: called.append(what) if event == "c_call" and what is not len else None)
    try:
        counts = language_model.text_counts(model, texts)
    finally:
        sys.setprofile(None)
    assert len(called) < 1000
    assert counts[0].sum() == pytest.approx(sum(map(len, texts)), rel=1e-4)


def test_training_holds_weights_that_single_precision_would_lose():
    """Each next token is all but impossible in the state that the last one tells."""
    step = np.array([[1 - 1e-9, 1e-9], [1e-9, 1 - 1e-9]])
    emit = np.array([[1, 1e-9], [1e-9, 1], [0.5, 0.5]])
    model = language_model.Hmm(np.full(2, 0.5), np.full(2, 0.5), step, emit / emit.sum(0))
    texts = [np.array([0, 1] * 20 + [2]), np.array([2, 1, 0]), np.array([0, 1] * 90)]
    for direct, far in ((2048, 128), (50, 16)):
        got = language_model.text_counts(model, texts, direct, far)
        assert got[4] == pytest.approx(language_model.log_likelihoods(model, texts).sum(), rel=1e-6)
        assert got[0].sum(1) == pytest.approx(np.bincount(np.concatenate(texts)), rel=1e-4)
        assert got[1].sum() + got[2].sum() == pytest.approx(sum(map(len, texts)), rel=1e-4)


def test_counts_of_mixed_lengths_are_sums_of_single_texts():
    chance = np.random.default_rng(9)
    texts = [chance.integers(0, 20, n) for n in (1, 7, 3, 1, 40, 2, 7)]
    model = language_model.random_model(np.full(22, 1 / 22), 3)
    together = language_model.text_counts(model, texts)
    alone = [language_model.text_counts(model, [t]) for t in texts]
    for got, parts in zip(together, zip(*alone, strict=True), strict=True):
        assert np.allclose(got, sum(parts), rtol=1e-4, atol=1e-5)


# ---- near de-duplication: large buckets --------------------------------------------------------------------------


def crowd(chance, n):
    """Texts around a few originals, many of them just above or just below 0.8 of each other."""
    words = ["w%d" % i for i in range(3000)]
    originals = [chance.choices(words, k=chance.choice([40, 90, 160])) for _ in range(3)]
    rows = []
    for _ in range(n):
        text = list(chance.choice(originals[:1] * 6 + originals))
        for _ in range(chance.randrange(0, 4)):
            text[chance.randrange(len(text))] = chance.choice(words)
        rows.append(" ".join(text + text[:chance.choice([0, 0, 30])]))
    return rows


def test_bulk_similarities_are_those_of_pairs():
    chance = random.Random(10)
    texts = crowd(chance, 60) + ["a b c d e f a b c d e f a b c d e f", "one", "one one one one one one one"]
    counts = near_dedup.Frequencies(np.random.default_rng(1).integers(0, 50, (2, near_dedup.WIDTH)), 60)
    sets = [(h, counts.weights(h, n), n) for h, n in map(near_dedup.shingles, texts)]
    bulk = near_dedup._similarities(sets, sets[:40], counts)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:40]):
            assert bulk[i, j] == pytest.approx(near_dedup.similarity(a, b), abs=1e-12)


@pytest.mark.parametrize("small, tile", [(16, 1024), (2, 17), (10**9, 1024)])
def test_classes_of_a_dense_crowd(spark, monkeypatch, small, tile):
    """Classes by tiles, by listed pairs, and by all pairs of texts that share a bucket are the same."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    chance = random.Random(11)
    texts = crowd(chance, 260)
    texts += [texts[0], texts[0], "", None, "no words like these"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup.link_classes, "__defaults__", (near_dedup.SIMILAR, small))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    found, sampler = near_dedup.frequencies(table), near_dedup.Sampler()
    sets = [(h, found.weights(h, n)) for h, n in map(near_dedup.shingles, texts)]
    drawn = [sampler.sample(*s) if len(s[0]) else None for s in sets]
    keys = [set() if d is None else set(sampler.buckets(d).tolist()) for d in drawn]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = (texts[i] or "") == (texts[j] or "")
            if not near and keys[i] & keys[j] and sum(a >> np.uint64(48) == b >> np.uint64(48) for a, b in zip(drawn[i], drawn[j], strict=True)) >= near_dedup.ALIKE:
                near = near_dedup.similarity(sets[i], sets[j]) >= near_dedup.SIMILAR - near_dedup.ROUNDING
            if near and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(texts))}
    assert 20 < len(set(got.values())) < 250


# ---- pages as browsers read them ---------------------------------------------------------------------------------


@pytest.mark.parametrize("page, wanted", [
    ("<html><head><title>x</title><body><article><p>One two three.</p></article>", ["One two three."]),
    ("<head><meta charset=utf-8><title>x</title><p>No body either.", ["No body either."]),
    ("<head><title>x</title>Plain text at once", ["Plain text at once"]),
    ("<head><style>p > a {}</style><script>if (a < b) {}</script></head><p>Kept", ["Kept"]),
    ('<p class="a"">First<p>Second', ["First", "Second"]),
    ("<p title='it's'>Third</p>", ["Third"]),
    ('<p title="a > b" class=x>Fourth</p>', ["Fourth"]),
    ("<p title='a > b'>Fifth <a href=/x?y=\"z\">link</a></p>", ["Fifth link"]),
    ('<a href="x>Sixth</a> more', ["Sixth more"]),
    ("<p a = \"x>y\" b= 'u>v' c =w =d>Seventh</p>", ["Seventh"]),
    ("<p>Eighth<p class=\"", ["Eighth"]),
])
def test_tags_end_where_browsers_end_them(page, wanted):
    assert [b[0] for b in html_text.blocks(page)] == wanted


def test_many_stray_quotes_take_no_time():
    import time

    start = time.time()
    html_text.blocks("<p a=\"'" * 20_000 + "<p " + "a" * 200_000 + "\"" * 50_000 + ">end")
    assert time.time() - start < 5


# ---- language model and packing: what a worker holds ---------------------------------------------------------------


def test_transfer_matrices_run_on_in_groups():
    """Running many segments on takes their result and a group's arrays, not several copies of all state weights."""
    import tracemalloc

    chance = np.random.default_rng(11)
    model = language_model.random_model(np.full(52, 1 / 52), 8)
    segments = [chance.integers(0, 50, 4) for _ in range(5000)]
    start = np.repeat(np.eye(8)[None], len(segments), 0)
    tracemalloc.start()
    done, logs = language_model._advance(model, start, segments)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * start.nbytes
    plain = np.eye(8)
    for token in segments[7]:
        plain = (plain @ model.step) * model.emit[token]
    assert np.allclose(done[7], plain / plain.sum()) and logs[7] == pytest.approx(np.log10(plain.sum()))


def test_packing_workers_remember_few_chunks():
    """The table of a worker stays small over many portions of unlike texts, and the ids are the same."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing._encoder.cache_clear()
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(120)]
    found = [ids for text in texts for ids in packing.encode([text], path)]
    assert len(packing._encoder(path)[2].known) <= 110_000
    library = Tokenizer.from_file(path)
    for i in (0, 119):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert found[i] == np.array(ids, dtype="<u4").tobytes()
    packing._encoder.cache_clear()


def test_packing_tokenizes_new_chunks_together():
    """Thousands of new words take a few calls of the tokenizer, and texts of any shape have the library's ids."""
    packing._encoder.cache_clear()
    table, library, calls = packing._encoder(BYTES)[2], Tokenizer.from_file(BYTES), []
    tokenize = table.tokenize
    table.tokenize = lambda text: calls.append(text) or tokenize(text)
    plain = " ".join(f"n{i}'s-{i * i}\nLine" for i in range(5000))
    texts = [plain, "", "a\tb c\r d\xa0e", " x", "x ", "\n", "\ny", "z\n", "a  b\n\n", *invented(random.Random(4), 400)]

    def agree(some):
        for text, ids in zip(some, packing.encode(some, BYTES), strict=True):
            assert ids == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text

    agree([plain])
    assert len(calls) <= 3
    agree(texts)
    agree(texts[::-1])
    table.most = 0  # nothing more is remembered
    agree([f"w{i} {t}" for i, t in enumerate(texts)])
    packing._encoder.cache_clear()
    assert packing.encode([], BYTES) == []
    packing._encoder.cache_clear()
