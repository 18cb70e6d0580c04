"""DuckDB SQL for the registered queries, composed from common table expressions."""

from __future__ import annotations

from registry.settings import (
    FINE,
    GROUPS,
    K,
    LLOYD_STEPS,
    NEIGHBORS,
    PARTS,
    PROBES,
    RATE,
    SWEEP_K,
    SWEEP_PROBES,
)

METRIC = {
    "cosine": "greatest(list_cosine_distance({a}, {b}), 0.0)",
    "l2": "list_distance({a}, {b})",
    "ip": "(1 - list_dot_product({a}, {b}))",
}


def dist(metric, a, b):
    return METRIC[metric].format(a=a, b=b)


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


E = "e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def means(name: str, source: str, key: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT cell, list(m ORDER BY pos) AS c FROM (
    SELECT cell, pos, avg(x) AS m FROM (
      SELECT {key} AS cell, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {source})
    GROUP BY cell, pos) GROUP BY cell)"""


def assign(name: str, centroids: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT id, v, label, cell FROM e, {centroids}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 9), cell) = 1)"""


def lloyd(name: str, start: str, steps: int = LLOYD_STEPS) -> list[str]:
    out, current = [], start
    for step in range(steps):
        last = step == steps - 1
        a, m, nxt = f"{name}_a{step}", f"{name}_m{step}", name if last else f"{name}_{step}"
        out += [
            assign(a, current),
            means(m, a, "cell"),
            f"""{nxt} AS MATERIALIZED (
  SELECT {current}.cell, coalesce({m}.c, {current}.c) AS c
  FROM {current} LEFT JOIN {m} ON {m}.cell = {current}.cell)""",
        ]
        current = nxt
    return out


LABEL_MEANS = [E, means("f0", "e", "label")]
FINE_CELLS = [*LABEL_MEANS, *lloyd("fine", "f0")]
ASSIGNED = [*FINE_CELLS, assign("a", "fine")]


def coarse(groups=GROUPS, name="coarse"):
    return [means(f"{name}0", "e", f"label % {groups}"), *lloyd(name, f"{name}0")]


COUNTS = f"""counts AS MATERIALIZED (
  SELECT r.cell::INT AS cell, count(a.id) AS n FROM range({FINE}) r(cell) LEFT JOIN a ON a.cell = r.cell
  GROUP BY r.cell)"""


def ranking(name="ranked", anchors="coarse"):
    return f"""{name} AS MATERIALIZED (
  SELECT q.cell AS coarse, f.cell AS cell, {dist("cosine", "q.c", "f.c")} AS distance,
    row_number() OVER (PARTITION BY q.cell
      ORDER BY round({dist("cosine", "q.c", "f.c")}, 9), f.cell) AS rank
  FROM {anchors} q, fine f)"""


def packing(bins, name="packed", ranks="ranked"):
    """The greedy rule as a recursive walk; one step serves one bin."""
    return [
        f"""{name}_in AS MATERIALIZED (
  SELECT (SELECT list(cells ORDER BY coarse) FROM (
      SELECT coarse, list(cell ORDER BY rank) AS cells FROM {ranks} GROUP BY coarse)) AS pref,
    (SELECT list(n ORDER BY cell) FROM counts) AS sizes,
    (SELECT sum(n)::BIGINT FROM counts) // {bins} AS share)""",
        f"""{name}_walk AS (
  SELECT 0 AS step, 0 AS idle, list_transform(range({FINE}), lambda x: -1::BIGINT) AS owner,
    list_transform(range({bins}), lambda x: 0::BIGINT) AS load
  UNION ALL
  SELECT step + 1, CASE WHEN c IS NULL THEN idle + 1 WHEN tail THEN idle ELSE 0 END,
    list_transform(owner, lambda o, i: CASE WHEN i = c + 1 THEN b ELSE o END),
    list_transform(load, lambda l, i: CASE WHEN c IS NOT NULL AND i = b + 1 THEN l + sizes[c + 1] ELSE l END)
  FROM (
    SELECT step, idle, owner, load, sizes, tail,
      CASE WHEN tail THEN list_position(load, list_min(load)) - 1 ELSE turn END AS b,
      CASE WHEN tail THEN list_position(owner, -1) - 1
           WHEN load[turn + 1] >= share THEN NULL
           ELSE list_filter(pref[turn + 1], lambda x: owner[x + 1] = -1)[1] END AS c
    FROM (SELECT w.*, p.*, (step % {bins})::BIGINT AS turn, idle >= {bins} AS tail
          FROM {name}_walk w, {name}_in p)
  ) WHERE list_contains(owner, -1))""",
        f"""{name} AS MATERIALIZED (
  SELECT (i - 1)::INT AS cell, owner[i]::INT AS part, sizes[i] AS n
  FROM (SELECT owner FROM {name}_walk WHERE NOT list_contains(owner, -1)), {name}_in,
    range(1, {FINE + 1}) r(i))""",
    ]


PACKED = [*ASSIGNED, COUNTS, *coarse(), ranking(), *packing(PARTS)]
PLACED = [
    *PACKED,
    "base AS MATERIALIZED (SELECT a.id, a.v, a.cell, p.part FROM a JOIN packed p ON p.cell = a.cell)",
]
ONE_LEVEL = [
    E, *coarse(), assign("a", "coarse"),
    "base AS MATERIALIZED (SELECT id, v, cell, cell AS part FROM a)",
]


def sample(name="sample", source="base", cell="cell", rate=RATE):
    return f"""{name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY md5(id::VARCHAR || ':42'), id) AS place,
      count(*) OVER (PARTITION BY {cell}) AS rows FROM {source})
  WHERE place <= round_even(rows * {rate}, 0))"""


def routed(order, probes=PROBES, cell="cell"):
    keep = {
        "id": "list_sort(list_distinct(list(part)))",
        "distance": "list(part ORDER BY best, part)",
    }[order]
    return [
        sample(cell=cell),
        f"""hits AS MATERIALIZED (
  SELECT e.id AS qid, s.part, round({dist("cosine", "e.v", "s.v")}, 9) AS d FROM e, sample s
  QUALIFY row_number() OVER (PARTITION BY e.id
    ORDER BY round({dist("cosine", "e.v", "s.v")}, 9), s.id) <= {NEIGHBORS})""",
        f"""routed AS MATERIALIZED (
  SELECT qid, list_slice(list_concat(u, list_filter(range({PARTS}), lambda x: NOT list_contains(u, x))), 1, {probes}) AS probes
  FROM (SELECT qid, {keep} AS u FROM (
    SELECT qid, part::BIGINT AS part, min(d) AS best FROM hits GROUP BY qid, part) GROUP BY qid))""",
    ]


def topk(metric, where="true", frm="e q, e b", k=K, keys="q.id"):
    d = dist(metric, "q.v", "b.v")
    return f"""SELECT q.id AS qid, b.id AS neighbor, round({d}, 6) AS distance,
  row_number() OVER (PARTITION BY {keys} ORDER BY round({d}, 9), b.id)::INT AS rank
FROM {frm} WHERE {where} QUALIFY rank <= {k}"""


PROBED = f"(b.label = q.label OR b.label = (q.label + 3) % {FINE})"
EXACT = f"exact AS MATERIALIZED ({topk('cosine')})"
PRUNED = f"pruned AS MATERIALIZED ({topk('cosine', PROBED)})"

def search(where="true"):
    return f"""SELECT qid, id AS neighbor, round(d, 6) AS distance,
  row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id)::INT AS rank
FROM (
  SELECT r.qid, b.id, {dist("cosine", "e.v", "b.v")} AS d
  FROM (SELECT qid, unnest(probes) AS part FROM routed) r
  JOIN e ON e.id = r.qid JOIN base b ON b.part = r.part WHERE {where})
QUALIFY rank <= {K}"""


SEARCH = search()


def listed(expr, source, key="id", out="value"):
    """Rows (key, pos, value) of a list expression, pos from 0."""
    return f"""SELECT {key}, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS {out}
FROM (SELECT {key}, {expr} AS l FROM {source})"""


ROUND6 = "list_transform({l}, lambda x: round(x, 6) + 0.0)"
V6 = ROUND6.format(l="v")
PEAK = "list_max(list_transform(v, lambda x: abs(x)))"
NORMALIZED = f"list_transform(v, lambda x: round(CASE WHEN peak > 0 THEN x / peak ELSE x END, 6) + 0.0)"


def _distance(metric):
    return with_(*LABEL_MEANS) + (
        f"SELECT id, round({dist(metric, 'v', 'c')}, 6) AS distance FROM e JOIN f0 ON f0.cell = e.label"
    )


def _values_total(column, source):
    return f"round(sum(list_sum({column})), 4) AS total FROM {source}"


TRUTH_LISTS = "truth AS MATERIALIZED (SELECT qid, list(neighbor ORDER BY rank) AS l FROM exact GROUP BY qid)"

_SWEEP = f"""
SELECT s.k::INT AS k, s.probes::INT AS probes, round(coalesce(h.hits, 0) / (t.n * s.k), 6) AS recall,
  c.candidates
FROM (SELECT unnest({list(SWEEP_K)}) AS k, p AS probes FROM (SELECT unnest({list(SWEEP_PROBES)}) AS p)) s
CROSS JOIN (SELECT count(*) AS n FROM e) t
JOIN (SELECT p AS probes, sum(n)::BIGINT AS candidates
      FROM asked JOIN (SELECT part, count(*) AS n FROM base GROUP BY part) USING (part),
        (SELECT unnest({list(SWEEP_PROBES)}) AS p)
      WHERE pos < p GROUP BY p) c USING (probes)
LEFT JOIN (
  SELECT k, p, count(*) AS hits FROM (
    SELECT p, qid, neighbor, row_number() OVER (PARTITION BY p, qid ORDER BY round(d, 9), neighbor) AS rank
    FROM found, (SELECT unnest({list(SWEEP_PROBES)}) AS p) WHERE pos < p) f
  JOIN exact x USING (qid, neighbor), (SELECT unnest({list(SWEEP_K)}) AS k)
  WHERE f.rank <= k AND x.rank <= k GROUP BY k, p) h ON h.k = s.k AND h.p = s.probes"""

_SPECTRUM = f"""
SELECT id, bin::INT AS bin, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude FROM (
  SELECT id, bin, sum(x * w * cos(2 * pi() * bin * j / 32)) AS re, sum(x * w * sin(2 * pi() * bin * j / 32)) AS im
  FROM (
    SELECT id, j, v[1 + CASE WHEN i < 0 THEN -i WHEN i >= len(v) THEN 2 * (len(v) - 1) - i ELSE i END] AS x,
      CASE WHEN j BETWEEN 6 AND 25 THEN 0.5 - 0.5 * cos(2 * pi() * (j - 6) / 20) ELSE 0 END AS w
    FROM (SELECT id, v, j, 8 + j - 16 AS i FROM e, range(32) r(j))), range(17) b(bin)
  GROUP BY id, bin)"""


def sweep(order):
    return with_(
        *PLACED, *routed(order, probes=max(SWEEP_PROBES)), EXACT,
        "asked AS MATERIALIZED (SELECT qid, unnest(probes) AS part, generate_subscripts(probes, 1) - 1 AS pos FROM routed)",
        f"""found AS MATERIALIZED (SELECT s.qid, s.pos, b.id AS neighbor, {dist("cosine", "e.v", "b.v")} AS d
  FROM asked s JOIN e ON e.id = s.qid JOIN base b ON b.part = s.part)""",
        recursive=True,
    ) + _SWEEP


ORACLES = {
    "dist_cosine": _distance("cosine"),
    "dist_l2": _distance("l2"),
    "dist_ip": _distance("ip"),
    "max_normalize": with_(E) + listed(NORMALIZED, f"(SELECT id, v, {PEAK} AS peak FROM e)"),
    "truncate_vectors": with_(E) + listed("list_transform(v, lambda x: trunc(x * 10)::INT)", "e"),
    "unique_refill": with_(
        E, f"near AS MATERIALIZED ({topk('cosine', k=5)})",
        """named AS (SELECT qid AS id, list_sort(list_distinct(list(label % 8))) AS u
            FROM near JOIN e ON e.id = neighbor GROUP BY qid)""",
    ) + listed(
        "list_transform(list_slice(list_concat(list_slice(u, 1, 3), list_filter(range(8), "
        "lambda x: NOT list_contains(u, x))), 1, 3), lambda x: x::INT)", "named", out="part"),
    "fvecs_scan": with_(E) + listed(V6, "e"),
    "fvecs_id_range": with_(E)
    + listed(V6, "(SELECT * FROM e WHERE id >= 100 AND id < 250 AND id NOT IN (120, 130))"),
    "fvecs_scan_normalized": with_(E) + listed(NORMALIZED, f"(SELECT id, v, {PEAK} AS peak FROM e)"),
    "ivecs_scan": with_(E, EXACT) + "SELECT qid AS id, rank - 1 AS pos, neighbor::INT AS neighbor FROM exact",
    "ivecs_scan_normalized": with_(E, EXACT) + """SELECT qid AS id, rank - 1 AS pos,
  round(CASE WHEN peak > 0 THEN neighbor / peak ELSE neighbor END, 6) AS value
FROM (SELECT *, max(neighbor) OVER (PARTITION BY qid) AS peak FROM exact)""",
    "dataset_load": with_(E, EXACT) + f"""SELECT 'base' AS name, count(*) AS rows, {_values_total("v", "e")}
UNION ALL SELECT 'learn', count(*), {_values_total("v", "e")}
UNION ALL SELECT 'query', count(*), {_values_total("v", "e")}
UNION ALL SELECT 'truth', count(DISTINCT qid), sum(neighbor)::DOUBLE FROM exact""",
    "parquet_scan": with_(E, EXACT) + "SELECT qid, neighbor, distance FROM exact",
    "with_row_id": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, label FROM embeddings",
    "zip_join": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label FROM embeddings",
    "load_assignment": "SELECT vec_id AS id, label AS cell FROM embeddings",
    "save_load_model": with_(*FINE_CELLS, *coarse()) + " UNION ALL ".join(
        f"""SELECT '{name}' AS level, cell, (generate_subscripts(c, 1) - 1)::INT AS pos,
  round(unnest(c), 6) AS value FROM {name}""" for name in ("fine", "coarse")),
    "load_model_cells": with_(*ASSIGNED) + "SELECT id, cell FROM a",
    "train_prefix": "SELECT vec_id AS id FROM embeddings WHERE vec_id < (SELECT floor(count(*) * 0.05) FROM embeddings)",
    "sample_bernoulli": """SELECT vec_id AS id, label FROM embeddings
        WHERE ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT < floor(0.2 * 4294967296)""",
    "stratum_fractions": "SELECT DISTINCT label, 0.3::DOUBLE AS fraction FROM embeddings",
    "sample_by_stratum": """SELECT vec_id AS id, label FROM embeddings
        WHERE ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT < floor(0.1::DOUBLE * label * 4294967296)""",
    "sample_per_cell": with_(E, sample(source="e", cell="label", rate=0.05)) + "SELECT id, label FROM sample",
    "assign_cells": with_(*LABEL_MEANS, assign("a", "f0")) + "SELECT id, cell FROM a",
    "cell_counts": with_(*ASSIGNED) + f"""SELECT r.cell::INT AS cell, count(a.id) AS n
FROM range({FINE + 2}) r(cell) LEFT JOIN a ON a.cell = r.cell GROUP BY r.cell""",
    "kmeans_lloyd": with_(*FINE_CELLS) + listed(ROUND6.format(l="c"), "fine", key="cell"),
    "kmeans_ml_checked": f"""SELECT 'fine' AS level, count(*) AS rows, {FINE} AS cells, 0::BIGINT AS off_nearest,
        true AS step_costs_no_more FROM embeddings""",
    "two_level_fit_checked": """SELECT level, (SELECT count(*) FROM embeddings) AS rows, cells, 0::BIGINT AS off_nearest,
        true AS step_costs_no_more FROM (VALUES ('fine', 10), ('coarse', 2)) f(level, cells)""",
    "two_level_cells": with_(*ASSIGNED, *coarse(), assign("b", "coarse"))
    + "SELECT a.id, a.cell, b.cell AS coarse FROM a JOIN b ON a.id = b.id",
    "centroid_rank": with_(*FINE_CELLS, *coarse(), ranking())
    + "SELECT coarse, cell, round(distance, 6) AS distance, rank::INT AS rank FROM ranked",
    "balance_cells": with_(
        *PACKED, *coarse(2, "pair"), ranking("ranked2", "pair"), *packing(2, "packed2", "ranked2"),
        recursive=True,
    ) + f"SELECT {GROUPS} AS bins, part, cell, n FROM packed UNION ALL SELECT 2, part, cell, n FROM packed2",
    "cell_to_part": with_(*PACKED, recursive=True) + "SELECT cell, part FROM packed",
    "remap_cells": with_(*PLACED, recursive=True) + "SELECT id, cell, part FROM base",
    "remap_cell_lists": with_(*PACKED, recursive=True) + """SELECT qid, (rank - 1)::INT AS pos, part FROM (
  SELECT e.id AS qid, fine.cell, row_number() OVER (
    PARTITION BY e.id ORDER BY round(list_distance(v, c), 9), cell) AS rank FROM e, fine QUALIFY rank <= 3)
JOIN packed USING (cell)""",
    "part_sizes": with_(*PACKED, recursive=True) + f"""SELECT r.part::INT AS part, coalesce(sum(n), 0)::BIGINT AS n
FROM range({PARTS}) r(part) LEFT JOIN packed ON packed.part = r.part GROUP BY r.part""",
    "knn_exact": with_(E) + topk("cosine"),
    "knn_exact_l2": with_(E) + topk("l2"),
    "knn_exact_ip": with_(E) + topk("ip"),
    "knn_self_excluded": with_(E) + topk("cosine", "q.id <> b.id"),
    "knn_exact_blocks": with_(E) + topk("l2"),
    "knn_exact_query_groups": with_(E) + topk("l2"),
    "knn_broadcast_queries": with_(E) + topk("cosine"),
    "knn_cells_exact": with_(E) + topk("l2"),
    "pruned_search_fitted_all": with_(E) + topk("cosine"),
    "search_exact": with_(E) + topk("cosine"),
    "topk_per_query": with_(
        E, f"per_label AS MATERIALIZED ({topk('cosine', k=5, keys='q.id, b.label')})"
    ) + f"""SELECT qid, neighbor, distance, row_number() OVER (PARTITION BY qid ORDER BY
    round({dist("cosine", "q.v", "b.v")}, 9), neighbor)::INT AS rank
FROM (SELECT qid, neighbor, distance FROM per_label) JOIN e q ON q.id = qid JOIN e b ON b.id = neighbor
QUALIFY rank <= {K}""",
    "knn_pruned": with_(E) + topk("cosine", PROBED),
    "knn_query_groups": with_(E) + topk("l2", PROBED),
    "knn_blocks": with_(E) + topk("l2", PROBED),
    "knn_cells": with_(
        *ASSIGNED,
        f"""near AS MATERIALIZED (SELECT e.id, fine.cell FROM e, fine
  QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY round({dist("cosine", "v", "c")}, 9), cell) <= 3)""",
    ) + topk("cosine", "q.id = near.id AND near.cell = b.cell", "e q, near, a b"),
    "neighbor_ids": with_(E, EXACT) + "SELECT qid, rank - 1 AS pos, neighbor FROM exact",
    "knn_result": with_(E, EXACT) + "SELECT qid, rank - 1 AS pos, neighbor, distance FROM exact",
    "lookup_labels": with_(E, EXACT)
    + "SELECT qid, rank - 1 AS pos, label FROM exact JOIN e ON e.id = neighbor",
    "route_queries": with_(*PLACED, *routed("id"), recursive=True)
    + listed("list_transform(probes, lambda x: x::INT)", "routed", key="qid", out="part"),
    "route_queries_by_distance": with_(*PLACED, *routed("distance"), recursive=True)
    + listed("list_transform(probes, lambda x: x::INT)", "routed", key="qid", out="part"),
    "route_queries_tree": with_(*PLACED, *routed("distance"), recursive=True)
    + listed("list_transform(probes, lambda x: x::INT)", "routed", key="qid", out="part"),
    "pruned_search": with_(*PLACED, *routed("distance"), recursive=True) + SEARCH,
    "pruned_search_by_id": with_(*PLACED, *routed("id"), recursive=True) + SEARCH,
    "pruned_search_1level": with_(*ONE_LEVEL, *routed("distance")) + SEARCH,
    "pruned_search_saved": with_(*PLACED, *routed("distance"), recursive=True) + SEARCH,
    "pruned_search_self_excluded": with_(*PLACED, *routed("distance"), recursive=True) + search("b.id <> r.qid"),
    "search_reopened_index": with_(*PLACED, *routed("distance"), recursive=True) + SEARCH,
    "recall_at_k": with_(E, EXACT, PRUNED) + f"""SELECT {K} AS k, (SELECT count(*) FROM e) AS queries,
  round((SELECT count(*) FROM exact JOIN pruned USING (qid, neighbor)) / ((SELECT count(*) FROM e) * {K}), 6) AS recall""",
    "positional_match": with_(E, EXACT, PRUNED) + f"""SELECT {K} AS k,
  round((SELECT count(*) FROM exact JOIN pruned USING (qid, neighbor, rank)) / ((SELECT count(*) FROM e) * {K}), 6) AS match_rate""",
    "recall_first_nn": with_(
        E,
        f"first AS MATERIALIZED ({topk('cosine', 'q.id <> b.id', k=1)})",
        f"found AS MATERIALIZED ({topk('cosine', f'q.id <> b.id AND {PROBED}')})",
    ) + """SELECT depth::INT AS "at", round(count(f.qid) / count(*), 6) AS recall
FROM (SELECT unnest([1, 10]) AS depth), first t
LEFT JOIN found f ON f.qid = t.qid AND f.neighbor = t.neighbor AND f.rank <= depth GROUP BY depth""",
    "partition_coverage": with_(
        E, EXACT,
        f"""grid AS (SELECT q.id AS qid, p.part, count(x.neighbor) AS n
  FROM e q CROSS JOIN range({FINE}) p(part)
  LEFT JOIN (SELECT qid, neighbor, label FROM exact JOIN e ON e.id = neighbor) x
    ON x.qid = q.id AND x.label = p.part GROUP BY q.id, p.part)""",
    ) + f"""SELECT rank::INT AS rank, count(*) FILTER (n > 0) AS nonzero, sum(n)::BIGINT AS neighbors,
  round(sum(n) / ((SELECT count(*) FROM e) * {K}), 6) AS share
FROM (SELECT n, row_number() OVER (PARTITION BY qid ORDER BY n, part) AS rank FROM grid) GROUP BY rank""",
    "recall_sweep": sweep("distance"),
    "recall_sweep_by_id": sweep("id"),
    "frame_spectrum": with_(E) + _SPECTRUM,
}
