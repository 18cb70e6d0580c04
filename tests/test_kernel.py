import numpy as np
from conftest import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.operators.kernel import METRICS, TopK, list_matrix, nearest


def run(queries, base, k, metric, exclude_self=False, step=37, order=None, bound=None):
    lists = TopK(np.arange(len(queries)), queries, k, metric, exclude_self, bound)
    ids = np.arange(len(base)) if order is None else order
    for s in range(0, len(base), step):
        at = ids[s:s + step]
        lists.update(None, at.astype(np.int64), base[at])
    return {i: lists.neighbor[i][np.isfinite(lists.distance[i])].tolist() for i in range(len(queries))}


@settings(max_examples=60, deadline=None)
@given(
    seed=st.integers(0, 10_000), rows=st.integers(1, 300), queries=st.integers(1, 40),
    width=st.integers(1, 24), k=st.integers(1, 12), metric=st.sampled_from(METRICS),
    scale=st.sampled_from([1e-3, 1.0, 1e3]), grid=st.booleans(), copies=st.booleans(),
    exclude_self=st.booleans(),
)
def test_matches_brute_force(seed, rows, queries, width, k, metric, scale, grid, copies, exclude_self):
    rng = np.random.default_rng(seed)
    draw = (lambda n: rng.integers(-3, 4, (n, width)) + 0.0) if grid else (lambda n: rng.normal(size=(n, width)))
    base, asked = (draw(n).astype(np.float32) * np.float32(scale) for n in (rows, queries))
    if copies:
        base[: rows // 2], asked[: queries // 3] = base[0], base[0]
    expected = brute(asked, base, k, metric, exclude_self=exclude_self)
    order = rng.permutation(rows)
    assert run(asked, base, k, metric, exclude_self, order=order) == expected


def test_copies_beyond_one_tile():
    base = np.ones((9000, 4), dtype=np.float32)
    base[::3] = np.random.default_rng(0).normal(size=(3000, 4))
    asked = np.ones((3, 4), dtype=np.float32)
    order = np.random.default_rng(1).permutation(9000)
    for metric in METRICS:
        assert run(asked, base, 7, metric, step=5000, order=order) == brute(asked, base, 7, metric)


def test_bound_never_drops_a_neighbour():
    rng = np.random.default_rng(2)
    base, asked = rng.normal(size=(500, 8)).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32)
    for metric in METRICS:
        plain = TopK(np.arange(20), asked, 5, metric)
        plain.update(None, np.arange(500), base)
        bound = plain.distance[:, -1]
        assert run(asked, base, 5, metric, bound=bound) == brute(asked, base, 5, metric)


def test_unusable_rows():
    base = np.array([[0, 0], [1, 0], [np.nan, 1], [np.inf, 0], [0, 1]], dtype=np.float32)
    asked = np.array([[1, 0], [0, 0]], dtype=np.float32)
    assert run(asked, base, 5, "cosine") == {0: [1, 4], 1: []}
    assert run(asked, base, 5, "l2") == {0: [1, 0, 4], 1: [0, 1, 4]}


def test_nearest_prefers_lower_cell():
    cells, centers = np.array([3, 5]), np.array([[0.0, 1.0], [0.0, -1.0]])
    assert nearest(np.array([[4.0, 0.0], [0.0, -2.0]]), cells, centers).tolist() == [3, 5]


def test_ragged_vectors_are_refused():
    import pyarrow as pa
    import pytest

    with pytest.raises(ValueError, match="differ in length"):
        list_matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_tags_travel_with_rows():
    rng = np.random.default_rng(6)
    base, asked = rng.normal(size=(300, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32)
    lists = TopK(np.arange(9), asked, 4)
    for s in range(0, 300, 50):
        ids = np.arange(s, s + 50)
        lists.update(None, ids, base[ids], ids * 10)
    _, neighbor, _, _, tag = lists.result()
    assert (tag == neighbor * 10).all() and len(tag) == 36
