"""The numpy kernel of exact search: the k nearest keys of each query among vectors that come in blocks.

A block meets the queries in single precision, which only has to tell what may
still be among the k nearest: each query has a floor that its k-th nearest
reaches already, and pairs within the rounding error of it are computed again in
double precision. State is k hits a query, however many rows go by.

Where a query has many vectors its floor is high, and two things spare work: a
first pass over vectors that share random hyperplanes tells floors beforehand
(``guess``, any k hits give one; those below ``HIGH`` help little), and above ``HIGH`` the vectors meet in the order of
one axis, in which near ones are near, by a few components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

DIGITS = 9
#: Corpus rows of one product (which stays in the cache), pairs computed again at once, hits beyond which they are cut to k a query.
COLUMNS, PAIRS, MOST_HITS = 1024, 1 << 16, 1 << 21
#: Times k corpus rows that give the first floor.
FIRST = 64
#: Above this floor, as queries of very many vectors reach it, so many leading components and the length of the rest tell enough.
HIGH, LEADING = 0.9, 16
#: Sets of hyperplanes of the first pass, hyperplanes of one, and queries that a corpus row meets in one.
TABLES, PLANES, MET = 8, 16, 16


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix, in the precision it has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))


def lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths in double precision, 1 for a zero vector."""
    size = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    return np.where(size == 0, 1, size)


def _unit(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    return m.astype(np.float64) / size[:, None]


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


class Queries(NamedTuple):
    """Query vectors, sorted by tag and query. A query may have several; it counts by the nearest of them."""

    names: np.ndarray  # query ids
    query: np.ndarray  # index into names, a vector
    vectors: np.ndarray
    size: np.ndarray
    tags: np.ndarray | None  # tag values
    tag: np.ndarray  # index into tags, a vector
    axes: np.ndarray  # orthonormal, those along which the vectors differ most first
    floor: np.ndarray  # what the k-th nearest of a query reaches at least

    @classmethod
    def of(cls, held: pa.Table, tagged: bool) -> Queries:
        query, names = pd.factorize(held["query_id"].to_pandas().to_numpy())
        tag, tags = pd.factorize(held["tag"].to_pandas().to_numpy()) if tagged else (np.zeros(len(query), np.int64), None)
        order = np.lexsort((query, tag))
        order = order[tag[order] >= 0]
        vectors = matrix(held["vector"])[order]
        size = lengths(vectors)
        some = _unit(vectors[:: max(1, len(vectors) >> 14)], size[:: max(1, len(vectors) >> 14)])
        axes = np.linalg.eigh(some.T @ some)[1][:, ::-1] if np.isfinite(some).all() else np.eye(vectors.shape[1])
        return cls(names, query[order], vectors, size, tags, tag[order], axes, np.full(len(names), -np.inf))


class Nearest:
    """The k nearest keys (assets if ``grouped``, else ids) of each query so far; equal similarities go to the smaller key."""

    def __init__(self, asked: Queries, k: int, grouped: bool, rows: int):
        self.asked, self.k, self.grouped, self.rows = asked, k, grouped, rows
        self.floor = asked.floor.copy()
        self.margin = 2 * (asked.vectors.shape[1] + 4) * 2.0**-24  # more than a product of unit vectors in single precision is off
        self.held: list[tuple[np.ndarray, ...]] = []
        self.fresh = self.kept = 0
        n, dim = asked.vectors.shape
        self.single, self.short = np.empty((n, dim), np.float32), np.empty((n, min(dim, LEADING) + 1), np.float32)
        for p in range(0, n, PAIRS):
            unit = _unit(asked.vectors[p : p + PAIRS], asked.size[p : p + PAIRS])
            self.single[p : p + PAIRS], self.short[p : p + PAIRS] = unit, self._short(unit)
        self.along = np.lexsort((self.short[:, 0], asked.tag))
        self.buckets: list[tuple[np.ndarray, np.ndarray]] = []

    def _taken(self, ids: np.ndarray, vectors: np.ndarray, assets: np.ndarray, tags: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Tags, unit vectors, keys, the keys' names and assets of a block, sorted by tag and key."""
        tag = np.zeros(len(ids), np.int64) if tags is None else pd.Index(self.asked.tags).get_indexer(tags)
        key, names = pd.factorize(assets if self.grouped else ids)
        size = lengths(vectors)
        order = np.lexsort((key, tag))
        order = order[(tag[order] >= 0) & np.isfinite(size[order])]
        return tag[order], _unit(vectors[order], size[order]), key[order], names, assets[order]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, assets: np.ndarray, tags: np.ndarray | None) -> None:
        """Take in a block of the corpus."""
        tag, unit, key, names, payload = self._taken(ids, vectors, assets, tags)
        single, short = unit.astype(np.float32), self._short(unit)
        for t in np.unique(tag):
            c = slice(*np.searchsorted(tag, (t, t + 1)))
            low, high = np.searchsorted(self.asked.tag, (t, t + 1))
            far = np.arange(low, high)[self.floor[self.asked.query[low:high]] - self.margin <= HIGH]
            for a in range(0, len(far), self.rows):
                self._far(far[a : a + self.rows], unit[c], single[c], key[c], names, payload[c])
            if len(far) < high - low:
                self._near(self.along[low:high], unit[c], short[c], key[c], names, payload[c])
        if self.fresh > max(self.kept // 2, 1 << 16):
            self._cut()

    def guess(self, ids: np.ndarray, vectors: np.ndarray, assets: np.ndarray, tags: np.ndarray | None) -> None:
        """Take in of a block of the corpus some pairs that lie on the same sides of random hyperplanes: hits that tell a floor, not all there are."""
        tag, unit, key, names, payload = self._taken(ids, vectors, assets, tags)
        if not self.buckets:
            codes = self._codes(self.single, self.asked.tag)
            self.buckets = [(code[order], order) for code in codes for order in (np.argsort(code),)]
        single = unit.astype(np.float32)
        for code, (sorted_codes, order) in zip(self._codes(single, tag), self.buckets, strict=True):
            start, end = (np.searchsorted(sorted_codes, code, side) for side in ("left", "right"))
            count = np.minimum(end - start, MET)
            j = np.repeat(np.arange(len(code)), count)
            i = order[np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(j))]
            high = np.einsum("ij,ij->i", self.single[i], single[j]) >= np.maximum(self.floor[self.asked.query[i]], HIGH) - self.margin
            self._exact([(i[high], j[high])], unit, key, names, payload)
        if self.fresh > max(self.kept // 2, 1 << 16):
            self._cut()

    @staticmethod
    def _codes(single: np.ndarray, tag: np.ndarray) -> list[np.ndarray]:
        """Of each vector its tag and its sides of the hyperplanes, for each set of them."""
        planes = np.random.default_rng(0).normal(size=(single.shape[1], TABLES * PLANES)).astype(np.float32)
        out = np.empty((TABLES, len(single)), np.int64)
        for p in range(0, len(single), PAIRS):
            sides = ((single[p : p + PAIRS] @ planes) > 0).reshape(-1, TABLES, PLANES) @ (1 << np.arange(PLANES))
            out[:, p : p + PAIRS] = sides.T + (tag[p : p + PAIRS] << PLANES)
        return list(out)

    def _short(self, unit: np.ndarray) -> np.ndarray:
        """Vectors whose products are never below those of the whole ones (Cauchy-Schwarz for the components left out)."""
        lead = unit @ self.asked.axes[:, :LEADING]
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead)) + 1e-15)
        return np.column_stack((lead, rest)).astype(np.float32)

    def _far(self, r: np.ndarray, unit: np.ndarray, single: np.ndarray, key: np.ndarray, names: np.ndarray, payload: np.ndarray) -> None:
        """Query vectors, those of a query together, against rows sorted by key."""
        query, q_single = self.asked.query[r], self.single[r]
        # Some rows from all over the keys, and all if those have too few keys.
        for step in (1 + len(key) // (FIRST * self.k), 1) if np.isneginf(self.floor[query]).any() else ():
            best = self._best(q_single @ single[::step].T, query, key[::step])
            if best.shape[1] >= self.k:
                at = query[_starts(query)]
                self.floor[at] = np.maximum(self.floor[at], np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k] - self.margin)
                break
        low = self.floor[query] - self.margin
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(key), COLUMNS):
            sims, keys = q_single @ single[s : s + COLUMNS].T, key[s : s + COLUMNS]
            near = np.flatnonzero(sims.max(axis=1) >= low)
            if not len(near):
                continue
            sims = sims[near]
            i, j = np.nonzero(sims >= low[near, None])
            if len(i) > self.k * len(near):
                # Of one query and one key only the nearest pairs count.
                best = self._best(sims, query[near], keys)
                of_query, of_key = (np.repeat(np.arange(len(x)), np.diff(np.r_[x, n])) for x, n in ((_starts(query[near]), len(near)), (_starts(keys), len(keys))))
                own = sims[i, j] >= best[of_query[i], of_key[j]] - 2 * self.margin
                i, j = i[own], j[own]
            found.append((r[near[i]], s + j))
            if sum(len(x) for x, _ in found) > PAIRS:
                self._exact(found, unit, key, names, payload)
                low = self.floor[query] - self.margin
        self._exact(found, unit, key, names, payload)

    def _near(self, rows: np.ndarray, unit: np.ndarray, short: np.ndarray, key: np.ndarray, names: np.ndarray, payload: np.ndarray) -> None:
        """Of these query vectors, sorted along the first axis, those with a high floor: unit vectors of a similarity s are at most sqrt(2 - 2s) apart on it."""
        low = self.floor[self.asked.query[rows]] - self.margin
        high = (low > HIGH) & np.isfinite(self.asked.size[rows])
        rows, low = rows[high], low[high]
        # Floors of one kind together, still along the axis.
        order = np.argsort(-np.log2(np.maximum(1 - low, 2.0**-30)).astype(np.int8), kind="stable")
        rows, low = rows[order], low[order]
        line = np.argsort(short[:, 0])
        short, place = short[line], short[line, 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(rows), self.rows):
            r, least = rows[a : a + self.rows], low[a : a + self.rows]
            q_short, apart = self.short[r], np.sqrt(2 - 2 * min(1, least.min())) + 1e-6
            start, end = np.searchsorted(place, (q_short[:, 0].min() - apart, q_short[:, 0].max() + apart))
            for s in range(start, end, COLUMNS):
                sims = q_short @ short[s : min(s + COLUMNS, end)].T
                near = np.flatnonzero(sims.max(axis=1) >= least)
                if len(near):
                    i, j = np.nonzero(sims[near] >= least[near, None])
                    found.append((r[near[i]], line[s + j]))
            if sum(len(x) for x, _ in found) > PAIRS:
                self._exact(found, unit, key, names, payload)
        self._exact(found, unit, key, names, payload)

    def _exact(self, found: list[tuple[np.ndarray, np.ndarray]], unit: np.ndarray, key: np.ndarray, names: np.ndarray, payload: np.ndarray) -> None:
        """Keep of the pairs found (query vectors, corpus rows) those that reach the floor."""
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            exact = np.rint(np.einsum("ij,ij->i", _unit(self.asked.vectors[x], self.asked.size[x]), unit[y]) * 10**DIGITS)
            query = self.asked.query[x]
            fits = exact / 10**DIGITS >= self.floor[query]
            query, y = query[fits], y[fits]
            self.held.append((query, names[key[y]], payload[y], exact[fits].astype(np.int64)))
            self.fresh += len(y)
        if self.fresh > max(self.kept, MOST_HITS):
            self._cut()

    @staticmethod
    def _best(sims: np.ndarray, query: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The largest similarity of each query (rows) and key (columns), whose runs are together."""
        q, c = _starts(query), _starts(key)
        if len(q) < len(query):
            sims = np.maximum.reduceat(sims, q, axis=0)
        return np.maximum.reduceat(sims, c, axis=1) if len(c) < len(key) else sims

    def _cut(self) -> None:
        """Each key once for a query, and k a query; their least is the new floor."""
        if not self.fresh:
            return
        query, key, asset, sim = (np.concatenate(x) for x in zip(*self.held, strict=True))
        code, _ = pd.factorize(key, sort=True)
        order = np.argsort(query * (int(code.max()) + 1) + code)
        query, key, asset, sim, code = query[order], key[order], asset[order], sim[order], code[order]
        once = _starts(query, code)
        if len(once) < len(query):
            sim = np.maximum.reduceat(sim, once)
            query, key, asset = query[once], key[once], asset[once]
        order = np.argsort((query << 32) - sim, kind="stable")  # of equal ones the smaller key stays first
        query = query[order]
        start = _starts(query)
        count = np.diff(np.r_[start, len(query)])
        place = np.arange(len(query)) - np.repeat(start, count)
        full = start[count >= self.k]
        self.floor[query[full]] = np.maximum(self.floor[query[full]], sim[order[full + self.k - 1]] / 10**DIGITS)
        order, query = order[place < self.k], query[place < self.k]
        self.held = [(query, key[order], asset[order], sim[order])]
        self.fresh, self.kept = 0, len(query)

    def hits(self, most: int = 1 << 16) -> Iterator[pd.DataFrame]:
        """(query_id, [id,] asset_id, similarity), in parts."""
        self._cut()
        for query, key, asset, sim in self.held:
            for p in range(0, len(query), most):
                q, k, a, s = (x[p : p + most] for x in (query, key, asset, sim))
                yield pd.DataFrame({"query_id": self.asked.names[q]} | ({} if self.grouped else {"id": k}) | {"asset_id": a, "similarity": s / 10**DIGITS})
