"""The registered queries of this subpackage, and the SQL of those that SQL can express.

Each query applies an operator to whole tables and derives the contract's columns from its result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.llm import (
    centroid_clusters,
    decontamination,
    exact_dedup,
    html_text,
    language_model,
    near_dedup,
    packing,
    secret_scan,
    sharding,
    token_alignment,
    token_counts,
    toxicity,
    window_packing,
)
from vecframe.llm.common import held_out


# Names of the vocabulary files of the token queries.
VOCABULARY, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    marked, name = decontamination.mark(docs, _table(spark, sf, "benchmark"))
    spans, items = F.col(name)["spans"], F.col(name)["items"]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return marked.select(
        "doc_id",
        F.col(name)["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op2_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return language_model.score_texts(docs, held_out(F.col("doc_id"), 7, 2))


def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages, name = html_text.extract(_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select(
        "page_id", "url", F.col(name).alias("text"), F.char_length(F.col(name)).cast("long").alias("n_chars")
    )


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path(VOCABULARY)))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(toxicity.labelled(docs, _table(spark, sf, "labels"), usable=~fold))
    scored, name = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        fold.alias("held_out"),
        F.col(name)["score"].alias("score"),
        (F.col(name)["score"] >= 0.5).cast("int").alias("predicted"),
        F.col(name)["sentences"].alias("offending"),
    )


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found, name = secret_scan.find_secrets(docs)
    spans, base = F.col(name), F.filter(F.col(name), lambda s: s["kind"] != "value")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def joined(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    counted, name = token_counts.with_token_counts(docs, public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", f"{name}.n_bytes", f"{name}.n_tokens", f"{name}.over_limit")


def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "class_size", "kept")


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf, "documents").select("doc_id", "text"))


def op11_window_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return window_packing.pack(window_packing.pieces(docs, public_tokenizers.path(WORDS)))


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))[0]


def op13_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    return centroid_clusters.with_inertia(*centroid_clusters.cluster(vectors)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_model": op2_language_model,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_window_packing": op11_window_packing,
    "op12_token_alignment": op12_token_alignment,
    "op13_centroid_clusters": op13_centroid_clusters,
}


def _rounds_of_clusters(rounds: int) -> str:
    """Every vector against every centroid, `rounds` times and once more."""

    def assigned(at: int) -> str:
        return f"""
        a{at} AS MATERIALIZED (
            SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
            FROM (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint AS d
                  FROM kept, c{at}) GROUP BY r)"""

    def moved(at: int) -> str:
        return f"""
        s{at} AS MATERIALIZED (
            SELECT c, list(f ORDER BY i) AS m FROM (
                SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f
                FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept JOIN a{at} USING (r)) GROUP BY c, i)
            GROUP BY c),
        c{at + 1} AS MATERIALIZED (
            SELECT c, coalesce(s.m, o.m)::bigint[] AS m FROM c{at} o LEFT JOIN s{at} s USING (c))"""

    steps = [f"{assigned(i)},{moved(i)}" for i in range(rounds)] + [assigned(rounds)]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::varchar) NULLS LAST, v) - 1 AS c, v AS m
            FROM kept ORDER BY sha256('2:' || vec_id::varchar) NULLS LAST, v LIMIT 40),{",".join(steps)}
        SELECT vec_id, a.c::int AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::bigint AS cluster_inertia,
               (sum(a.d) OVER ())::bigint AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} USING (c)
    """


ORACLES = {
    "op13_centroid_clusters": _rounds_of_clusters(centroid_clusters.ROUNDS),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op1_decontamination": """
        WITH iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        grams AS (
            SELECT item_id, least(10, len(w)) AS k,
                   unnest([list_slice(w, i, i + least(10, len(w)) - 1)
                           for i in range(1, len(w) - least(10, len(w)) + 2)]) AS g
            FROM iw WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT k FROM grams),
        dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        places AS (
            SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
        hits AS (SELECT doc_id, item_id, p.k, i FROM places p JOIN grams g ON p.k = g.k AND p.g = g.g),
        marked AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                   FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS names
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT dw.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
