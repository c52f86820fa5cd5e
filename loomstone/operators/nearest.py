"""The best rows of a block of vectors for a block of query vectors, exactly.

A matrix product discards what is far from a query's k-th best by more than rounding can explain; what is
left gets its score by a plain sum in the order of the dimensions, as SQL engines make it, so that equal
vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

METRICS = ("cosine_similarity", "cosine_distance", "dot_product", "l2_distance")
#: Scores held at once.
SCORES = 1 << 20


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors by dimension; without rows of nulls, of null elements and of no dimensions."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    numbers = pc.cast(values, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    starts, usable = np.cumsum(lengths) - lengths, lengths > 0
    if values.null_count:
        usable[np.repeat(np.arange(len(lengths)), lengths)[values.is_null().to_numpy(zero_copy_only=False)]] = False
    out = {}
    for d in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == d))
        out[d] = rows, numbers[starts[rows, None] + np.arange(d)]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products by rows, from the first dimension to the last."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _scaled(m: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, which change no digit of a cosine but keep squares in range."""
    top = np.abs(m).max(axis=1)
    shift = np.where(np.isfinite(top), np.frexp(np.where(np.isfinite(top), top, 0))[1], 0)
    return np.ldexp(m, -shift[:, None])


def _first_copies(m: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Positions of all vectors but those with k equal ones of lower ranks, which no query can want."""
    mixed = (np.ascontiguousarray(m).view(np.uint64) * (np.arange(1, m.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    _, of, n = np.unique(mixed, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(n[of] > k)
    if not len(crowded):
        return np.arange(len(m))
    same = np.unique(np.ascontiguousarray(m[crowded]).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)[1]
    order = np.lexsort((rank[crowded], same))
    keep = np.ones(len(m), bool)
    keep[crowded[order[_place(same[order]) >= k]]] = False
    return np.flatnonzero(keep)


def _place(sorted_groups: np.ndarray) -> np.ndarray:
    """The place of each item in its run of equal ones."""
    at = np.arange(len(sorted_groups))
    new = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]][: len(at)]
    return at - np.maximum.accumulate(np.where(new, at, 0))


class _Scores:
    """Scores of one dimension's vectors (``table``) for queries of the same dimension."""

    def __init__(self, table: np.ndarray, queries: np.ndarray, metric: str):
        self.metric = metric
        self.cosine = metric.startswith("cosine")
        self.e, self.q = (_scaled(m) if self.cosine else m for m in (table, queries))
        self.ee, self.qq = _dots(self.e, self.e), _dots(self.q, self.q)
        fine = lambda s: np.isfinite(s) & (s > 0) if self.cosine else np.isfinite(s)
        self.fine_e, self.fine_q = fine(self.ee), fine(self.qq)
        self.top = np.sqrt(self.ee[self.fine_e].max(initial=0))
        self.eps = 4 * (table.shape[1] + 8) * np.finfo(float).eps

    def rough(self, q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries by vectors a number that is higher the better they are, and a bound of its error by query."""
        if self.cosine:
            a, b = (m[i] / np.sqrt(s[i])[:, None] for m, s, i in ((self.q, self.qq, q), (self.e, self.ee, e)))
            return a @ b.T, np.full(len(q), self.eps)
        dots = self.q[q] @ self.e[e].T
        if self.metric == "dot_product":
            return dots, self.eps * np.sqrt(self.qq[q]) * self.top
        return 2 * dots - self.qq[q, None] - self.ee[e], self.eps * (np.sqrt(self.qq[q]) + self.top) ** 2

    def exact(self, q: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        step = max(1, SCORES // self.e.shape[1])
        for i in range(0, len(q), step):
            a, b = q[i : i + step], e[i : i + step]
            if self.metric == "l2_distance":
                d = self.q[a] - self.e[b]
                out[i : i + step] = np.sqrt(_dots(d, d))
            else:
                out[i : i + step] = _dots(self.q[a], self.e[b])
                if self.cosine:
                    s = np.clip(out[i : i + step] / np.sqrt(self.qq[a] * self.ee[b]), -1, 1)
                    out[i : i + step] = 1 - s if self.metric == "cosine_distance" else s
        return out

    def candidates(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vector), among them the k best vectors of each query; all of a query come at once."""
        every, fine, odd = np.arange(len(self.e)), np.flatnonzero(self.fine_e), np.flatnonzero(~self.fine_e)
        step = max(1, SCORES // max(len(self.e), 1))
        for i in range(0, len(self.q), step):
            q = np.arange(i, min(i + step, len(self.q)))
            good, bad = q[self.fine_q[q]], q[~self.fine_q[q]]
            pairs = [(np.repeat(bad, len(every)), np.tile(every, len(bad))), (np.repeat(good, len(odd)), np.tile(odd, len(good)))]
            if len(good) and len(fine):
                near, off = self.rough(good, fine)
                if len(fine) > k:
                    least = np.partition(near, len(fine) - k, axis=1)[:, len(fine) - k] - 2 * off
                    a, b = np.nonzero(near >= least[:, None])
                else:
                    a, b = np.indices(near.shape).reshape(2, -1)
                pairs.append((good[a], fine[b]))
            yield tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def best(table: pa.Table, queries: pa.Table, k: int, metric: str) -> pa.Table:
    """The k best rows (query_id, id, score) of a table (id, vector) for each query (query_id, query), ties by id.

    Rows without a score (nulls, other dimensions) come last.
    """
    ids = pc.sort_indices(table.select(["id"]), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[ids] = np.arange(len(ids))
    parts, done = [], np.zeros(len(queries), bool)
    found = _matrices(table["vector"])
    scored = np.zeros(len(ids), bool)
    with np.errstate(all="ignore"):
        for d, (q_rows, q) in _matrices(queries["query"]).items():
            rows, e = found.get(d, (np.empty(0, np.int64), np.empty((0, d))))
            if len(rows):
                kept = _first_copies(e, rank[rows], k)
                of, s = rows[kept], _Scores(e[kept], q, metric)
                for a, b in s.candidates(k):
                    score = s.exact(a, b)
                    nan = np.isnan(score)
                    order = np.lexsort((rank[of[b]], score, nan, a) if "distance" in metric else (rank[of[b]], -score, ~nan, a))
                    order = order[_place(a[order]) < k]
                    parts.append((q_rows[a[order]], of[b[order]], score[order]))
            scored[:] = False
            scored[rows] = True
            rest = ids[~scored[ids]][:k]
            parts.append((np.repeat(q_rows, len(rest)), np.tile(rest, len(q_rows)), None))
            done[q_rows] = True
    without, first = np.flatnonzero(~done), ids[:k]
    parts.append((np.repeat(without, len(first)), np.tile(first, len(without)), None))
    at, of = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    scores = pa.concat_arrays([pa.nulls(len(p[0]), pa.float64()) if p[2] is None else pa.array(p[2], pa.float64()) for p in parts])
    return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "id": table["id"].take(pa.array(of)), "score": scores})
