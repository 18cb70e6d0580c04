"""Every stage of the pipeline against a plain version of its rule, on a small table with planted cases."""

import random

import numpy as np
import pytest

import corpus_pipeline
from vecframe.llm import decontamination, near_dedup, toxicity

WORDS = ["w%03d" % i for i in range(400)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(documents, folder of the other tables, benchmark passages): clean, toxic, copied, near-copied and leaking rows."""
    chance = random.Random(12)

    def prose(n):
        return " ".join(chance.choices(WORDS, k=n))

    passages = [prose(14) for _ in range(4)]
    texts = [prose(chance.randrange(40, 120)) + "." for _ in range(60)]
    texts += ["You are a vile scoundrel %s. %s." % (prose(2), prose(30)) for _ in range(40)]
    texts += texts[:8] + texts[:3]  # exact copies
    texts += [t[:-1] + " " + prose(2) + "." for t in texts[10:16] if len(t) > 200]  # near copies
    texts += [prose(30) + " " + p + " " + prose(30) for p in passages] + passages[:2]  # a part, and nothing else
    texts += ["", None]
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, 1, int(60 <= i < 100)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(f"b{i}", p) for i, p in enumerate(passages)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder, passages


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def plain_near_classes(texts, found):
    """Classes of all texts by all pairs; of each the least id stays."""
    ids = sorted(texts)
    sets = {i: near_dedup.shingles(texts[i]) for i in ids}
    weighted = {i: (h, found.weights(h, n)) for i, (h, n) in sets.items()}
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j >= i:
                break
            same = (texts[i] or "") == (texts[j] or "")
            if same or near_dedup.similarity(weighted[i], weighted[j]) >= near_dedup.SIMILAR:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i for i in ids if label[i] == i}


def test_each_stage_by_its_rule(spark, corpus):
    docs, folder, passages = corpus
    stage = dict(corpus_pipeline.STAGES)
    given = kept(docs)

    harmless = stage["toxicity"](spark, docs, folder)
    clean = kept(harmless)
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert clean == {i: t for i, t in given.items() if model.score(t) < toxicity.THRESHOLD}
    assert not clean.keys() & set(range(60, 100)) and set(range(60)) <= clean.keys()

    single = stage["exact dedup"](spark, harmless, folder)
    last = {t or "": i for i, t in sorted(clean.items())}
    assert kept(single) == {i: clean[i] for i in last.values()}

    apart = stage["near dedup"](spark, single, folder)
    texts = kept(single)
    want = plain_near_classes(texts, near_dedup.frequencies(single))
    assert kept(apart) == {i: texts[i] for i in want} and len(want) < len(texts)

    without = stage["decontamination"](spark, apart, folder)
    wanted = {}
    for i, t in kept(apart).items():
        inside = [p for p in passages if p in (t or "")]
        if t in passages:
            continue
        for p in inside:
            t = t.replace(p, "")
        wanted[i] = t
    got = kept(without)
    assert got.keys() == wanted.keys()
    for i, t in got.items():
        assert (t or "").split() == (wanted[i] or "").split() and (i in wanted and t == kept(apart)[i] or len(t) < 1200)
    assert without.columns == docs.columns

    packed = stage["packing"](spark, without, folder).toPandas()
    assert set(packed["doc_id"]) == set(got)
    for _, window in packed.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].tolist() == [0, *np.cumsum(window["length"])[:-1]] and window["length"].sum() <= 2048


def test_stages_of_an_empty_table(spark, corpus):
    docs, folder, _ = corpus
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_a_stage_scans_for_passages_once(spark, corpus, capsys):
    """Each Python step within a task is one more worker that stays: one scan for all chunks of items, cutting included."""
    docs, folder, _ = corpus
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    one, many = (decontamination.decontaminate(docs, items, chunk_words=n) for n in (10_000, 20))
    for out in (one, many):
        out.explain()
        assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert kept(one) == kept(many) != kept(docs)
