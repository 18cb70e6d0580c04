"""Numpy helpers that run inside Spark tasks: running top-k of a block of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distances that agree to this many decimals count as equal; the lower id then goes first.
DECIMALS = 9
_TIE = 2.0 * 10.0**-DECIMALS
_NO_ID = np.iinfo(np.int64).max
_QUERY_TILE = 1024
_BASE_TILE = 4096

METRICS = ("cosine", "l2", "ip")


def list_matrix(column: pa.Array) -> np.ndarray:
    """A numeric list column without nulls as an (n, d) matrix; float32 stays float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    length = pc.min_max(pc.list_value_length(column)).as_py()
    if length["min"] != length["max"]:
        raise ValueError(f"vectors differ in length: {length['min']} to {length['max']}")
    values = column.flatten().to_numpy(zero_copy_only=False)
    if values.dtype != np.float32:
        values = values.astype(np.float64, copy=False)
    return values.reshape(n, length["max"])


def squares(vectors: np.ndarray) -> np.ndarray:
    """Squared length of every row, in double precision."""
    return np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64, casting="safe")


def usable(square: np.ndarray, metric: str) -> np.ndarray:
    """Rows that have a distance at all: finite, and not of zero length under cosine."""
    return np.isfinite(square) & ((square > 0) | (metric != "cosine"))


def rounded(distance: np.ndarray) -> np.ndarray:
    """Distances as they are ranked."""
    return np.round(distance, DECIMALS) + 0.0


def groups(keys: np.ndarray):
    """(key, row numbers) for every distinct key, rows in their given order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], len(keys)]):
        yield ordered[start], order[start:stop]


class TopK:
    """The k nearest base rows seen so far for each row of a query matrix.

    Base rows arrive in batches. A single-precision matrix product scores a tile of pairs, larger
    meaning nearer. Its rounding error has a proven bound, so every pair that could enter a list
    is found; only those get their distance computed, in double precision, and merged.
    """

    def __init__(self, ids, vectors, k, metric="cosine", exclude_self=False, bound=None, member=None):
        """`member` lets several lists share a vector: list i belongs to vector member[i]."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        n = len(ids)
        self.of = np.arange(n) if member is None else member
        self.query_ids = np.asarray(ids, dtype=np.int64)
        self.metric, self.k, self.exclude_self = metric, k, exclude_self
        self.vectors = vectors
        self.square = squares(vectors) if len(vectors) else np.zeros(0)
        self.length = np.sqrt(self.square)
        self.live = usable(self.square, metric)[self.of]
        self.scoring = self._scoring(vectors, self.square, query=True) if len(vectors) else vectors
        self.bound = np.full(n, np.inf) if bound is None else np.asarray(bound) + _TIE
        self.distance = np.full((n, k), np.inf)
        self.neighbor = np.full((n, k), _NO_ID, dtype=np.int64)
        self.tag = np.zeros((n, k), dtype=np.int64)

    def _scoring(self, vectors, square, query):
        """Rows prepared so that a product of both sides is the score."""
        if self.metric == "cosine":
            length = np.sqrt(np.where(square > 0, square, 1.0))
            return (vectors / length[:, None]).astype(np.float32)
        dtype = np.float32 if not len(square) or np.nanmax(square) < 1e30 else np.float64
        if self.metric == "ip":
            return vectors.astype(dtype, copy=False)
        extra = np.ones(len(vectors)) if query else -square / 2
        return np.concatenate([vectors, extra[:, None]], axis=1, dtype=dtype, casting="same_kind")

    def update(self, rows, ids, vectors, tags=None):
        """Offer base rows (`ids`, `vectors`) to the queries numbered `rows` (None: all).

        `tags` are integers that travel with the rows into the lists.
        """
        rows = np.flatnonzero(self.live) if rows is None else rows[self.live[rows]]
        if not len(ids) or not len(rows):
            return
        square = squares(vectors)
        tags = np.zeros(len(ids), dtype=np.int64) if tags is None else tags
        ok = usable(square, self.metric)
        if not ok.all():
            ids, vectors, square, tags = ids[ok], vectors[ok], square[ok], tags[ok]
        if not len(ids):
            return
        base = (ids, vectors, np.sqrt(square), self._scoring(vectors, square, query=False), tags)
        for b in range(0, len(ids), _BASE_TILE):
            tile = tuple(x[b:b + _BASE_TILE] for x in base)
            for q in range(0, len(rows), _QUERY_TILE):
                self._tile(rows[q:q + _QUERY_TILE], tile)

    def _tile(self, rows, tile, distinct=False):
        ids, base, length, scoring, tags = tile
        score = self.scoring[self.of[rows]] @ scoring.T
        slack = self._slack(rows, length.max(), score.dtype)
        limit = np.minimum(rounded(self.distance[rows, -1]), self.bound[rows])
        floor = self._floor(rows, limit) - slack
        need = self.k + int(self.exclude_self)
        unbounded = np.flatnonzero(np.isinf(limit))
        if len(unbounded) and len(ids) > need:
            # Twice the error: the k-th best score and the scores compared with it are both off.
            floor[unbounded] = _kth_largest(score[unbounded], need) - 2 * slack[unbounded]
        hits = np.flatnonzero(score >= floor.astype(score.dtype)[:, None])
        if not distinct and len(hits) > 16 * need * len(rows):
            return self._tile(rows, self._without_copies(tile, need), distinct=True)
        hit_row, hit_base = np.divmod(hits, len(ids))
        query, ids = rows[hit_row], ids[hit_base]
        distance = self._distance(query, base, length, hit_base)
        rank = rounded(distance)
        worst = rounded(self.distance[query, -1])
        keep = (rank < worst) | ((rank == worst) & (ids < self.neighbor[query, -1]))
        keep &= rank <= self.bound[query]
        if self.exclude_self:
            keep &= self.query_ids[query] != ids
        self._merge(query[keep], ids[keep], distance[keep], tags[hit_base[keep]])

    @staticmethod
    def _without_copies(tile, need):
        """Of equal vectors only the `need` lowest ids can make a list; leave out the others."""
        ids, base = tile[:2]
        order = np.argsort(ids, kind="stable")
        rows = np.ascontiguousarray(base[order] + 0.0)
        key = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).reshape(-1)
        _, copy_of = np.unique(key, return_inverse=True)
        kept = np.sort(np.concatenate([members[:need] for _, members in groups(copy_of)]))
        return tuple(x[order[kept]] for x in tile)

    def _slack(self, rows, longest, dtype):
        """A bound on the error of a score, and room for distances that round to the same value."""
        size = self.vectors.shape[1] + 8
        unit = np.finfo(dtype).eps * size + np.finfo(np.float64).eps * size
        if self.metric == "cosine":
            return np.full(len(rows), unit + _TIE)
        if self.metric == "ip":
            return self.length[self.of[rows]] * longest * unit + _TIE
        reach = self.length[self.of[rows]] + longest
        return reach * reach * unit + 2 * reach * _TIE + _TIE

    def _floor(self, rows, limit):
        """The lowest score whose distance is still within `limit`."""
        if self.metric == "l2":
            return (self.square[self.of[rows]] - limit**2) / 2
        return 1 - limit

    def _distance(self, query, base, length, hit_base):
        out = np.empty(len(query))
        for s in range(0, len(query), 32768):
            at = slice(s, s + 32768)
            asked = self.of[query[at]]
            left = self.vectors[asked].astype(np.float64, copy=False)
            right = base[hit_base[at]].astype(np.float64, copy=False)
            if self.metric == "l2":
                gap = left - right
                out[at] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                continue
            product = np.einsum("ij,ij->i", left, right)
            if self.metric == "cosine":
                product /= self.length[asked] * length[hit_base[at]]
            out[at] = 1 - product
        return np.maximum(out, 0.0) if self.metric == "cosine" else out

    def _merge(self, query, ids, distance, tags):
        if not len(query):
            return
        touched = np.unique(query)
        old = np.isfinite(self.distance[touched])
        query = np.concatenate([np.repeat(touched, old.sum(axis=1)), query])
        ids = np.concatenate([self.neighbor[touched][old], ids])
        tags = np.concatenate([self.tag[touched][old], tags])
        distance = np.concatenate([self.distance[touched][old], distance])
        order = np.lexsort((ids, rounded(distance), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        at, order = (query[top], place[top]), order[top]
        self.distance[touched], self.neighbor[touched] = np.inf, _NO_ID
        self.distance[at], self.neighbor[at], self.tag[at] = distance[order], ids[order], tags[order]

    def result(self, start=0, stop=None):
        """Arrays (query row, neighbour id, distance, rank from 1, tag) of all entries held, or of some query rows."""
        row, place = np.nonzero(np.isfinite(self.distance[start:stop]))
        row += start
        at = (row, place)
        return row, self.neighbor[at], self.distance[at], place + 1, self.tag[at]


def _kth_largest(score: np.ndarray, k: int) -> np.ndarray:
    if k == 1:
        return score.max(axis=1)
    at = score.shape[1] - k
    return np.partition(score, at, axis=1)[:, at]


def nearest(vectors, cells, centers) -> np.ndarray:
    """Cell of the nearest centroid per row, the lower cell on a tie; -1 for unusable rows."""
    lists = TopK(np.arange(len(vectors)), vectors, 1, "l2")
    lists.update(None, cells, centers)
    return np.where(np.isfinite(lists.distance[:, 0]), lists.neighbor[:, 0], -1)


class CellSums:
    """Number of vectors and their component sums per cell."""

    def __init__(self):
        self.total: dict[int, list] = {}

    def add(self, cells, vectors):
        ok = usable(squares(vectors), "l2") & (cells >= 0)
        for cell, rows in groups(np.where(ok, cells, -1)):
            if cell < 0:
                continue
            held = self.total.setdefault(int(cell), [0, np.zeros(vectors.shape[1])])
            held[0] += len(rows)
            held[1] += vectors[rows].sum(axis=0, dtype=np.float64)

    def merge(self, batch):
        """Adds rows of `batch()`."""
        if not batch.num_rows:
            return
        sums, n = list_matrix(batch.column("sums")), batch.column("n").to_numpy(zero_copy_only=False)
        for cell, rows in groups(batch.column("cell").to_numpy(zero_copy_only=False)):
            held = self.total.setdefault(int(cell), [0, np.zeros(sums.shape[1])])
            held[0] += int(n[rows].sum())
            held[1] += sums[rows].sum(axis=0)

    def bytes(self):
        return sum(v.nbytes for _, v in self.total.values())

    def means(self):
        cells = sorted(self.total)
        return pa.RecordBatch.from_pydict({
            "cell": pa.array(cells, pa.int32()),
            "centroid": pa.array([self.total[c][1] / self.total[c][0] for c in cells], pa.list_(pa.float64())),
        })

    def batch(self):
        cells = sorted(self.total)
        return pa.RecordBatch.from_pydict({
            "cell": pa.array(cells, pa.int32()),
            "n": pa.array([self.total[c][0] for c in cells], pa.int64()),
            "sums": pa.array([self.total[c][1] for c in cells], pa.list_(pa.float64())),
        })
