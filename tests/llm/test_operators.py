"""Operators on training data: brute-force versions, round trips and edge cases on small tables."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecframe.llm import (
    decontamination, exact_dedup, html_text, language_model, near_dedup, packing, secret_scan, sharding, token_counts,
    toxicity,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, digest string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "one two three", "x", 1), (2, "one two three", None, 2), (2, "one two three", None, 2), (None, "", "y", 3),
        (None, None, "y", 3), (5, None, None, None), (6, "long " * 30_000, "z", 4), (7, "Ünï\tcode  text\n", "z", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    found = exact_dedup.decide(docs).collect()
    kept = sorted((r["doc_id"] or 0, r["group_size"]) for r in found if r["kept"])
    assert len(found) == 8 and kept == [(2, 3), (5, 3), (6, 1), (7, 1)]
    stays = exact_dedup.drop_copies(docs)
    assert stays.columns == docs.columns and sorted(r["doc_id"] for r in stays.collect()) == [2, 5, 6, 7]
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_sharding(spark, docs, none):
    assert sharding.shard_documents(none).count() == 0
    assert sharding.shard_documents(docs, 3).count() == 8
    chance = random.Random(1)
    rows = [(i, "t%d" % chance.randrange(60) * chance.choice([1, 1, 1, 9])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (5, 100_000):
        got = sharding.shard_documents(table, 7, exact_groups=exact).toPandas()
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    for _ in range(200):
        sizes = [chance.randrange(1, 30) for _ in range(chance.randrange(1, 9))]
        shards = chance.randrange(1, 5)
        best = min(
            max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cut, len(sizes)]))
            for n in range(min(shards, len(sizes))) for cut in itertools.combinations(range(1, len(sizes)), n)
        )
        assert sharding.smallest_capacity(sizes, shards) == best


def test_suffix_automaton_against_brute_force():
    chance = random.Random(1)
    for _ in range(400):
        letters = [b"a", b"b", b"c"][:chance.choice([1, 2, 3])]
        items = [([chance.choice(letters) for _ in range(chance.randint(0, 9))], str(i)) for i in range(4)]
        window = chance.choice([2, 3, 4])
        automaton = decontamination.SuffixAutomaton(window)
        for words, name in items:
            automaton.add(words, name)
        doc = [chance.choice(letters + [b"z"]) for _ in range(chance.randint(0, 25))]
        spans, names = automaton.finish().find(doc)
        hit, want, want_hit = set(), set(), set()
        for a, b in spans:
            hit |= set(range(a, b))
        for words, name in items:
            k = min(len(words), window)
            for i, j in itertools.product(range(len(words) - k + 1 if k else 0), range(len(doc) - k + 1)):
                if doc[j:j + k] == words[i:i + k]:
                    want.add(name)
                    want_hit |= set(range(j, j + k))
        assert (hit, names) == (want_hit, want)


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (None, "code text")], "item_id long, text string")
    marked, name = decontamination.mark(docs, items)
    found = [(r["doc_id"], r[name]["n_words"], list(r[name]["items"])) for r in marked.collect()]
    assert (1, 3, ["1"]) in found and (7, 3, []) in found and (5, 0, []) in found
    chunked, name = decontamination.mark(docs, items, chunk_words=1)
    assert sorted(map(str, chunked.collect())) == sorted(map(str, marked.collect()))
    clean = decontamination.decontaminate(docs, items, max_coverage=0.9)
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[7] == "Ünï\t\n" and clean.columns == docs.columns
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == 8


def test_toxicity(spark, docs, none):
    chance = random.Random(3)
    words = ["w%s" % "abcdefghij"[i] * 2 for i in range(10)]
    rows, labels = [], []
    for i in range(400):
        body = [" ".join(chance.choice(words) for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            body[chance.randrange(5)] += " badword"
        rows.append((i, ". ".join(body)))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(table, marks, usable=F.col("doc_id") < 300))
    scored, name = toxicity.score(table, model)
    held = [(r[name]["score"] >= 0.5, r["doc_id"] % 4 == 0, r) for r in scored.collect() if r["doc_id"] >= 300]
    assert all(a == b for a, b, _ in held)
    _, _, r = next(h for h in held if h[0])
    place = r[name]["sentences"][0]
    assert "badword" in r["text"][place["start"]:place["end"]]
    assert toxicity.reject(docs, model).count() == 8 and toxicity.reject(none, model).count() == 0
    empty = toxicity.fit(toxicity.labelled(none, marks))
    assert empty.score("anything at all") < 1e-6 and empty.score(None) == 0


def test_toxic_words_in_many_forms(spark):
    """Insults whose forms are each too rare to be learnt are known by how they begin, in forms never seen as well."""
    chance = random.Random(8)

    def letters(n):
        return "".join(chance.choice("abcdefgh") for _ in range(n))

    rows, labels = [], []
    for i in range(600):
        body = [" ".join(letters(chance.randrange(2, 8)) for _ in range(6)) for _ in range(4)]
        if i % 5 == 0:
            body[chance.randrange(4)] += " " + chance.choice(["Zwoll", "vrenk"]) + letters(6)
        rows.append((i, ". ".join(body)))
        labels.append((i, int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(table, marks, usable=F.col("doc_id") < 450))
    assert {"zwoll*", "vrenk*"} <= model.weights.keys()
    scored, name = toxicity.score(table, model)
    held = [(r[name]["score"] >= 0.5, r["doc_id"] % 5 == 0) for r in scored.collect() if r["doc_id"] >= 450]
    assert sum(found for found, toxic in held if toxic) >= 29 and sum(found for found, toxic in held if not toxic) <= 1
    assert model.score("zwoll") > 0.5 > model.score("zwo")


def test_secrets(docs):
    text = 'token = "abcdef123" AKIA' + "A" * 16 + " " + "0f" * 12 + ' password: short pwd: xK9$mQ2vLp4! login: aaaaaaaa'
    found = secret_scan.scan(text)
    assert [text[a:b] for k, a, b in found if k == "value"] == ["xK9$mQ2vLp4"]
    assert [k for k, _, _ in found] == ["assign", "access", "hex", "value"]
    assert secret_scan.guess_cost("password2019")[0] < 5 < secret_scan.guess_cost("xK9mQ2vLp4")[0]
    assert secret_scan.guess_cost("qwerty")[0] < 3 and secret_scan.guess_cost("abcabcabcabc")[0] < 6
    spans, name = secret_scan.find_secrets(docs)
    assert spans.filter(F.size(name) > 0).count() == 0 and secret_scan.redact(docs).count() == 8


def test_secrets_of_one_kind_of_characters(spark):
    values = ["kqzxvbtrwmplfhgd", "739182650417", "QZXKVBNWMRTPLH", "well-known", "something"]
    rows = [(i, "a well known thing is something to know") for i in range(9)]
    rows += [(100 + i, f"{w}: {v}") for i, (w, v) in enumerate(zip(("pwd", "pin", "auth", "key", "login"), values))]
    rows += [(200 + i, "pwd: kqzxvbtrwmplfhgd") for i in range(9)]
    spans, name = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [r["text"][x["start"]:x["end"]] for x in r[name]] for r in spans.collect()}
    assert [got[100 + i] for i in range(5)] == [[v] for v in values[:3]] + [[], []]
    assert all(got[200 + i] == values[:1] for i in range(9))


def test_html(spark):
    tree = html_text.train_tree(spark)
    page = (
        "<title>t</title><nav><a href=x>Home</a></nav><div class='ad'>Buy now, this is a nice product</div><article>"
        "<h1>Title &amp; more</h1><p>Short.<p>Some <b>bold</b>\n text<script>var x='<p>';</script></p>"
        "<aside>Read also</aside></article><footer>me</footer><p"
    )
    assert html_text.main_text(page, tree) == "Title & more\nShort.\nSome bold text"
    rows = [[float(x) for x in line.split()] for line in html_text.LABELLED.strip().splitlines()]
    assert all(html_text.is_main(tree, r[:-1]) == (r[-1] > 0) for r in rows)
    table = spark.createDataFrame([(1, None), (2, ""), (3, page)], "page_id long, html string")
    out, name = html_text.extract(table, tree=tree)
    assert [r[name] for r in out.orderBy("page_id").collect()][:2] == ["", ""]


def test_token_counts(docs):
    tokenizer = Tokenizer.from_file(PATH)
    chance = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\xa0", "a", "the", "é", "漢字", "23", "!", "'ll", "<|endoftext|>", "aaaaaaaa", "🙂", "\x1c"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 14))) for _ in range(2000)] + ["a" * 3000]
    assert token_counts.count_tokens(texts, PATH) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    ids = [np.frombuffer(raw, "<u4").tolist() for raw in packing.encode(texts, PATH)]
    assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    counted, name = token_counts.with_token_counts(docs, PATH)
    assert {r["doc_id"]: r[name]["n_tokens"] for r in counted.collect()}[5] == 0


def test_packing(docs, none):
    out = packing.pack(packing.pieces(docs, PATH)).toPandas()
    assert out["length"].max() <= packing.CAPACITY and len(out[out["doc_id"] == 5]) == 1
    assert out["length"].sum() == sum(token_counts.count_tokens([r["text"] for r in docs.collect()], PATH)) + 8
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= packing.CAPACITY
    long = out[out["doc_id"] == 6].sort_values("piece")
    assert (long["length"].iloc[1:] == packing.CAPACITY).all()
    raw = packing.encode(["long " * 30_000], PATH)[0] + b"\0\0\0\0"
    assert list(long["ids_crc32"]) == [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(long["start"], long["length"])]
    assert packing.pack(packing.pieces(none, PATH)).count() == 0
    chance = random.Random(5)
    sizes = [chance.randrange(50, 900) for _ in range(500)]
    live = packing.evolve(sizes, 1000, [], 1, 6, 4)
    assert all(sorted(i for b in p.bins for i in b) == list(range(500)) and max(p.fill) <= 1000 for p in live)
    assert live[0].fitness() >= packing.first_packing(sizes, 1000, chance, 0.0).fitness()


def test_hmm_against_enumeration():
    chance = np.random.default_rng(0)
    rows = lambda a: a / a.sum(1, keepdims=True)
    model = language_model.Hmm(*rows(chance.random((2, 3))), rows(chance.random((3, 3))), rows(chance.random((3, 6))).T)
    texts = [chance.integers(0, 6, n) for n in (1, 2, 7, 5, 3)]
    want = [
        math.log10(sum(
            model.start[p[0]] * model.emit[o[0], p[0]]
            * math.prod(model.step[a, b] * model.emit[w, b] for a, b, w in zip(p, p[1:], o[1:]))
            for p in itertools.product(range(3), repeat=len(o))
        )) for o in texts
    ]
    for direct, far in ((2048, 128), (3, 2)):
        assert np.allclose(language_model.log_likelihoods(model, texts, direct, far), want)


def test_training_counts_are_those_of_uncut_texts():
    chance = np.random.default_rng(1)
    rows = lambda a: a / a.sum(1, keepdims=True)
    model = language_model.Hmm(*rows(chance.random((2, 3))), rows(chance.random((3, 3))), rows(chance.random((3, 6))).T)
    texts = [chance.integers(0, 6, n) for n in (1, 8, 2, 7, 5, 3)]
    emitted, moved, begun, total = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for o in texts:
        paths = list(itertools.product(range(3), repeat=len(o)))
        chances = np.array([
            model.start[p[0]] * model.emit[o[0], p[0]]
            * math.prod(model.step[a, b] * model.emit[w, b] for a, b, w in zip(p, p[1:], o[1:])) for p in paths
        ])
        total += math.log10(chances.sum())
        for p, c in zip(paths, chances / chances.sum()):
            begun[p[0]] += c
            for w, b in zip(o, p):
                emitted[w, b] += c
            for a, b in zip(p, p[1:]):
                moved[a, b] += c
    for direct, far in ((2048, 128), (4, 2), (1, 3), (2, 1)):
        got = language_model.text_counts(model, texts, direct, far)
        for have, want in zip((got[0], got[1], got[2], got[4]), (emitted, moved, begun, total)):
            assert np.allclose(have, want, atol=1e-5)


def test_every_training_pass_reads_all_texts_until_it_levels_off(spark, monkeypatch):
    chance = random.Random(8)
    # What tells the texts apart comes after 300 equal words.
    rows = [
        (i, "same " * 300 + " ".join(chance.choice(("a b c d" if i % 2 else "x y z q").split()) for _ in range(60)))
        for i in range(40)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen, one_pass = [], language_model.one_pass

    def watched(*args):
        counts = one_pass(*args)
        seen.append((counts[0].sum(), counts[2].sum(), counts[4]))
        return counts

    monkeypatch.setattr(language_model, "one_pass", watched)
    language_model.score_texts(table, F.lit(False)).count()
    tokens = 40 * 361
    assert all(n == pytest.approx(tokens, rel=1e-4) and m == pytest.approx(40, rel=1e-4) for n, m, _ in seen)
    gains = np.diff([x for _, _, x in seen]) / tokens
    assert (gains[:-1] >= language_model.TOLERANCE).all() and gains[-1] < language_model.TOLERANCE


def test_language_model(spark, docs, none):
    chance = random.Random(4)
    rows = [(i, " ".join(chance.choice(("a b c d" if i % 2 else "x y z Q").split()) for _ in range(40))) for i in range(300)]
    table = spark.createDataFrame(rows + [(900, None), (901, "unseen")], "doc_id long, text string")
    fold = F.col("doc_id") % 7 == 2
    got = {r["doc_id"]: r for r in language_model.score_texts(table, fold, head=5).collect()}
    counts = collections.Counter()
    for i, t in rows + [(900, None), (901, "unseen")]:
        if i % 7 != 2:
            counts.update([*(t or "").lower().split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows + [(900, None)]:
        words = [*(t or "").lower().split(), "\n"]
        assert got[i]["n_tokens"] == len(words) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score_texts(docs, F.lit(False)).count() == 8
    assert language_model.score_texts(none, F.lit(False)).count() == 0


def test_near_dedup(spark, docs, none):
    chance = random.Random(6)
    rows = []
    for g in range(12):
        base = ["w%d" % chance.randrange(500) for _ in range(120)]
        for _ in range(chance.randrange(1, 9)):
            copy = list(base)
            for _ in range(chance.randrange(0, 6)):
                copy[chance.randrange(120)] = "v%d" % chance.randrange(500)
            rows.append((len(rows), " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.frequencies(table)
    sets = [(s[0], found.weights(*s)) for s in (near_dedup.shingles(t) for _, t in rows)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if label[i] != label[j] and near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    assert [got[i] for i in range(len(rows))] == label
    assert near_dedup.drop_near_copies(table).count() == len(set(label))
    stays = near_dedup.drop_near_copies(docs)
    assert stays.columns == docs.columns and stays.count() == 4
    assert near_dedup.classes(none).count() == 0


def test_weighted_sampling_agrees_with_similarity():
    chance = np.random.default_rng(3)
    sampler = near_dedup.Sampler(200, 4)
    hashes = chance.integers(0, 1 << 63, 800, dtype=np.uint64)
    weights = dict(zip(hashes, chance.uniform(1, 2, 800), strict=True))
    a, b = np.sort(hashes[:400]), np.sort(hashes[50:450])
    a, b = (a, np.array([weights[x] for x in a])), (b, np.array([weights[x] for x in b]))
    shared = (sampler.sample(*a) == sampler.sample(*b)).mean()
    assert abs(shared - near_dedup.similarity(a, b)) < 0.06


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
