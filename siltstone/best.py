"""The best rows of many queries within a task: what cannot be among a query's best is dropped before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows that a task holds before it drops those that are no query's best any more.
POOL = 1 << 20


class Best:
    """Rows (query, cost, key) of a task, of which each query's k least costs are wanted, ties to the lesser key. `margin` is a difference of costs that a later rounding may turn into a tie: rows within it of the k-th stay."""

    def __init__(self, queries: int, k: int, key_type: pa.DataType, margin: float = 0.0, pool: int = POOL):
        self.k, self.margin, self.limit, self.pool, self.type = k, margin, pool, pool, key_type
        self.most = np.full(queries, np.inf)  # no row of a query above it is wanted
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, query: np.ndarray, cost: np.ndarray, keys: pa.Array, at: np.ndarray) -> None:
        """Rows of queries (numbers from 0) and costs; keys.take(at) are their keys."""
        ok = cost <= self.most[query]
        if not ok.all():
            query, cost, at = query[ok], cost[ok], at[ok]
        if len(query):
            self.parts.append((query.astype(np.int32), cost, keys.take(pa.array(at, pa.int64()))))
            self.n += len(query)
            if self.n > self.limit:
                self._drop()

    def _drop(self) -> None:
        query = np.concatenate([p[0] for p in self.parts])
        cost = np.concatenate([p[1] for p in self.parts])
        keys = pa.concat_arrays([p[2] for p in self.parts])
        # what is far from the best needs no order by keys
        order = np.lexsort((cost, query))
        k_th = order[_runs(query[order]) == self.k - 1]
        self.most[query[k_th]] = np.minimum(self.most[query[k_th]], cost[k_th] + self.margin)
        kept = np.flatnonzero(cost <= self.most[query])
        query, cost, keys = query[kept], cost[kept], keys.take(pa.array(kept, pa.int64()))
        by = pa.table({"q": query, "c": cost, "k": keys}).sort_by([("q", "ascending"), ("c", "ascending"), ("k", "ascending")])
        query, cost, keys = by["q"].to_numpy(), by["c"].to_numpy(), by["k"].combine_chunks()
        # of a query's rows of one cost only the first k can be among its best
        kept = _runs(query, cost) < self.k
        self.parts = [(query[kept], cost[kept], keys.filter(pa.array(kept)))]
        self.n = int(kept.sum())
        self.limit = max(self.pool, 2 * self.n)

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        if not self.parts:
            return np.empty(0, np.int32), np.empty(0), pa.array([], self.type)
        self._drop()
        return self.parts[0]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Each row's place (from 0) in its run of equal rows of sorted columns."""
    n = len(columns[0])
    first = np.ones(n, bool)
    if n:
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(first)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that lie one after the other (list i from starts[i] to starts[i + 1]) and numbers of lists: for each element of each named list, which of the names it is of, and where it lies."""
    size = starts[of + 1] - starts[of]
    which = np.repeat(np.arange(len(of)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + starts[of][which]
