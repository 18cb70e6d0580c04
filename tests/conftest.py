import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A table of vectors: make([[1, 2], [3, 4]]) or make({7: [1, 2]}), ids from 0 or as given."""

    def build(vectors, id_col="id", **columns):
        items = vectors.items() if isinstance(vectors, dict) else enumerate(vectors)
        names = list(columns)
        rows = [
            (int(i), None if v is None else [float(x) for x in v], *[columns[n][at] for n in names])
            for at, (i, v) in enumerate(items)
        ]
        kinds = {int: "int", list: "array<int>", float: "double"}
        extra = "".join(f", {n} {kinds[type(columns[n][0])]}" for n in names)
        return spark.createDataFrame(rows, f"{id_col} long, features array<float>{extra}")

    return build


@pytest.fixture(scope="session")
def blobs():
    """Eight seeded Gaussian blobs: (base vectors, query vectors)."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16)) * 4

    def draw(n):
        return (centers[rng.integers(0, 8, n)] + rng.normal(size=(n, 16)) * 1.5).astype(np.float32)

    return draw(1500), draw(60)


def brute(queries, base, k, metric="cosine", allowed=None, exclude_self=False):
    """Reference answer by plain numpy: {query row: [base row, ...]}."""
    q, b = np.asarray(queries, dtype=np.float64), np.asarray(base, dtype=np.float64)
    out = {}
    for i in range(len(q)):
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1 - (b @ q[i]) / (np.linalg.norm(b, axis=1) * np.linalg.norm(q[i]))
            d = np.maximum(d, 0)
        elif metric == "l2":
            d = np.linalg.norm(b - q[i], axis=1)
        else:
            d = 1 - b @ q[i]
        ids = np.flatnonzero(np.isfinite(d))
        if allowed is not None:
            ids = ids[[bool(allowed(i, j)) for j in ids]] if len(ids) else ids
        if exclude_self:
            ids = ids[ids != i]
        out[i] = ids[np.lexsort((ids, np.round(d[ids], 9)))][:k].tolist()
    return out


def as_lists(neighbors):
    """{qid: [neighbor, ...]} of a result table, checking that ranks run from 1."""
    out = {}
    for r in sorted(neighbors.collect(), key=lambda r: (r["qid"], r["rank"])):
        found = out.setdefault(r["qid"], [])
        found.append(r["neighbor"])
        assert r["rank"] == len(found)
    return out
