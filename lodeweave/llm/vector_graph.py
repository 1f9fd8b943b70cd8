"""The most similar vectors of every vector, by NN-descent.

The neighbour graph starts from coarse cells: each vector joins the cells of its
two nearest pivots, and vectors that share a cell are compared. From there on
NN-descent improves it. In a round, the join of neighbours of neighbours, every
vector u meets what it lists and what lists it (at most ``2 x degree``, new ones
first); each two of these of which one is new are compared, and both keep what is
better than their farthest neighbour. Entries are flagged new until they have
taken part. The rounds end when fewer than ``SETTLED`` of all entries change.

The join is one shuffle a round. Its key is the cell in which u lives: a vector
is sent once to each other cell in which new neighbours of it live, not once for
each of them, and meets all of them there. What a vector gains away from home
is sent to its home cell with the next round's messages. A cell that very many
visit is dealt to several tasks.

Vectors travel as 16-bit integers scaled to each vector's largest component;
the cosine similarity of two of them is within 0.00001 of the exact one.

Pivots are fitted on a bounded sample of ``SAMPLE`` vectors; every vector is
indexed. Where the pivots are too few for the number of vectors, a cell is cut by
random hyperplanes at the medians of its part of the sample, so that near vectors
mostly stay together. Of many copies of one vector within a task a few stand for
all, and the others take over the list of the first.

Null, zero, non-finite vectors and those of another length have no neighbours
and are nobody's. Repeated rows count once; if one id comes with
several vectors its similarity is the largest of them. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.near_duplicates import whole_keys
from lodeweave.runtime import cut_lineage, forget, written

#: Vectors that the pivots are fitted on, members of a cell aimed at, and those above which a cell is cut.
SAMPLE, CELL, MAX_BLOCK = 32768, 800, 4000
#: Part of all entries of the lists that may still change in the last round.
SETTLED = 0.01
#: Visitors of a cell that one task takes.
MAX_VISITORS = 20000
SPILL = 2
#: What a message to a cell is: a vector at home, a visitor, better neighbours for a vector at home, a second row of one at home;
#: and a copy of a vector that follows another.
HOME, VISIT, GAIN, COPY, FOLLOW = range(5)
_NONE = -2.0


def _unit(codes: np.ndarray) -> np.ndarray:
    v = codes.astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _codes(column: pa.Array, dim: int) -> np.ndarray:
    """int16 matrix of a binary column without nulls."""
    return _bytes(column).view(np.int16).reshape(-1, dim)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy() if ends[-1] > ends[0] else np.empty(0, np.uint8)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    offsets = pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32) if len(matrix) else np.zeros(1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(matrix.tobytes())])


def _usable(table: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))


def _encode(batches, dim: int):
    """(ids, codes) of the usable vectors of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, vectors = batch.column(0).to_numpy(), batch.column(1)
        values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
        top = np.abs(values).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        ids, values, top = ids[ok], values[ok].astype(np.float64), top[ok]
        if len(ids):
            yield ids, np.rint(values / top[:, None] * 32767).astype(np.int16)


class Pivots:
    """Cell centres fitted on a sample, and the hyperplanes that cut large cells."""

    def __init__(self, centres: np.ndarray, planes: np.ndarray, bits: np.ndarray, medians: np.ndarray) -> None:
        self.centres, self.planes, self.bits, self.medians = centres, planes, bits, medians
        self.first = np.cumsum(1 << bits) - (1 << bits)

    def nearest(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the nearest pivots, nearest first."""
        return _nearest(self.centres, vectors, most)

    def blocks(self, vectors: np.ndarray) -> np.ndarray:
        """The blocks (cells, or parts of cut cells) of the two nearest pivots; in a cut home cell also the part beyond each of the two nearest planes. -1 for none."""
        cells = self.nearest(vectors, SPILL)
        out = self.first[cells]
        if not self.bits.any():
            return out
        side = vectors @ self.planes.T
        place = np.arange(len(self.planes))
        for k in range(cells.shape[1]):
            c = cells[:, k]
            margin, cut = side - self.medians[c], place < self.bits[c][:, None]
            out[:, k] += (((margin > 0) & cut) << place).sum(axis=1)
            if k == 0:
                near = np.argsort(np.where(cut, np.abs(margin), np.inf), axis=1, kind="stable")[:, :2]
                code = out[:, :1] - self.first[c][:, None]
                beyond = np.where(np.take_along_axis(cut, near, 1), self.first[c][:, None] + (code ^ (1 << near)), -1)
        return np.concatenate([out, beyond], axis=1)


def _nearest(centres: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    most = min(most, len(centres))
    out = np.empty((len(vectors), most), np.int64)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for a in range(0, len(vectors), step):
        s = vectors[a : a + step] @ centres.T
        if most == 1:
            out[a : a + step, 0] = s.argmax(axis=1)
            continue
        p = np.argpartition(-s, most - 1, axis=1)[:, :most]
        out[a : a + step] = np.take_along_axis(p, np.argsort(-np.take_along_axis(s, p, 1), axis=1, kind="stable"), 1)
    return out


def fit(table: DataFrame, key: str, vector: str, dim: int, seed: int = 11) -> Pivots:
    """Spherical k-means on the sample; the number of cells follows the number of vectors, at most one for eight of the sample."""
    n = table.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    chosen = _usable(table.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))), key, vector, dim).limit(SAMPLE)
    picked = [codes for _, codes in _encode(chosen.toArrow().to_batches(), dim)] if n else []
    if not picked:
        return Pivots(np.zeros((1, dim), np.float32), np.zeros((0, dim), np.float32), np.zeros(1, np.int64), np.zeros((1, 0), np.float32))
    every = np.concatenate(picked)
    sample = _unit(np.unique(every, axis=0))
    every = _unit(every)
    count = int(max(1, min(len(sample) // 8, round(n / CELL))))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), count, replace=False)].copy()
    few = sample[rng.permutation(len(sample))[: max(32 * count, 4096)]]
    for _ in range(4):
        home = _nearest(centres, few, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, home, few)
        size = np.linalg.norm(total, axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0][:, None]
    members = np.bincount(_nearest(centres, every, SPILL).ravel(), minlength=count) * (n / len(every))
    bits = np.where(members > MAX_BLOCK, np.ceil(np.log2(np.maximum(1, members / min(MAX_BLOCK, SPILL * CELL)))), 0).astype(np.int64)
    planes = rng.normal(size=(int(bits.max()), dim)).astype(np.float32)
    medians = np.zeros((count, len(planes)), np.float32)
    home = _nearest(centres, sample, 1)[:, 0]
    for c in np.flatnonzero(bits):
        own = sample[home == c]
        medians[c] = np.median(own @ planes.T, axis=0) if len(own) else 0
    return Pivots(centres, planes, bits, medians)


def _entry(degree: int) -> np.dtype:
    """A list of neighbours; ``new``: 2 until the vector has been sent to the neighbour, 1 until they have met others there."""
    return np.dtype([("id", "<i8", degree), ("sim", "<f4", degree), ("home", "<i4", degree), ("new", "u1", degree)])


def _blank(n: int, degree: int) -> np.ndarray:
    out = np.zeros(n, _entry(degree))
    out["id"], out["sim"] = -1, _NONE
    return out


_MESSAGE = "block int, kind byte, id long, home int, vec binary, near binary, fresh int"
_SHAPE = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("id", pa.int64()), ("home", pa.int32()), ("vec", pa.binary()), ("near", pa.binary()), ("fresh", pa.int32())])


def _messages(block, kind: int, ids, home, vec, near, fresh=None) -> pa.Table:
    n = len(ids)
    return pa.table([
        pa.array(np.broadcast_to(np.asarray(block, np.int32), n)), pa.array(np.full(n, kind, np.int8)), pa.array(ids), pa.array(np.broadcast_to(np.asarray(home, np.int32), n)),
        pa.nulls(n, pa.binary()) if vec is None else _binary(vec), _binary(near.view(np.uint8).reshape(n, -1)) if n else pa.array([], pa.binary()),
        pa.array(np.zeros(n, np.int32) if fresh is None else fresh.astype(np.int32)),
    ], schema=_SHAPE)


def _assigned(table: DataFrame, key: str, vector: str, dim: int, degree: int, shared) -> DataFrame:
    """(block, home, id, vec, own, leader): each vector in its two blocks; of a copy only the id that stands for it, in blocks below zero."""

    def assign(batches):
        pivots = shared.value
        leaders: dict[bytes, int] = {}
        odd = (np.random.default_rng(5).integers(1, 1 << 62, size=-(-dim // 4)) * 2 + 1).astype(np.uint64)
        for ids, codes in _encode(batches, dim):
            # Copies: all but a few of each vector that is frequent in this task follow the first.
            wide = np.zeros((len(codes), -(-dim // 4) * 4), np.int16)
            wide[:, :dim] = codes
            mixed = wide.view(np.uint64) * odd
            hashed = (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64)
            order = np.lexsort((ids, hashed))
            group = np.cumsum(np.r_[True, hashed[order][1:] != hashed[order][:-1]]) - 1
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(order)) - start[group]
            follow = np.full(len(ids), -1, np.int64)
            for g in np.unique(group[place > degree]):
                rows = order[start[g] : start[g] + np.count_nonzero(group == g)]
                rows = rows[(codes[rows] == codes[rows[0]]).all(axis=1)]
                name = codes[rows[0]].tobytes()
                if name not in leaders:
                    leaders[name] = int(ids[rows[0]])
                    rows = rows[degree + 1 :]
                follow[rows] = np.where(ids[rows] == leaders[name], -1, leaders[name])
            kept = np.flatnonzero(follow < 0)
            copies = np.flatnonzero(follow >= 0)
            blocks = pivots.blocks(_unit(codes[kept])) if len(kept) else np.empty((0, 1), np.int64)
            for k in range(blocks.shape[1]):
                r = np.flatnonzero(blocks[:, k] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[r, k].astype(np.int32)), pa.array(blocks[r, 0].astype(np.int32)), pa.array(ids[kept][r]), _binary(codes[kept][r]), pa.array(np.full(len(r), k == 0)), pa.nulls(len(r), pa.int64())], ["block", "home", "id", "vec", "own", "leader"])
            if len(copies):
                none = pa.array((-1 - ((ids[copies].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[copies]), pa.nulls(len(copies), pa.binary()), pa.nulls(len(copies), pa.bool_()), pa.array(follow[copies])], ["block", "home", "id", "vec", "own", "leader"])

    return _usable(table, key, vector, dim).mapInArrow(assign, "block int, home int, id long, vec binary, own boolean, leader long")


def _best(sims: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and similarities of the largest of each row, ties to the smaller column."""
    degree = min(degree, sims.shape[1])
    p = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
    s = np.take_along_axis(sims, p, 1)
    o = np.lexsort((p, -s), axis=-1)
    return np.take_along_axis(p, o, 1), np.take_along_axis(s, o, 1)


def _start(degree: int, dim: int):
    """Compare all vectors of a block: the first lists, kept by those at home and sent to the homes of the others."""

    def compare(table: pa.Table) -> pa.Table:
        ids, block = table["id"].to_numpy(), table["block"][0].as_py()
        if block < 0:
            follow = _blank(len(ids), degree)
            follow["id"][:, 0] = table["leader"].to_numpy()
            return _messages(block, FOLLOW, ids, block, None, follow)
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], _codes(table["vec"], dim)[order]
        homes, own = table["home"].to_numpy()[order], table["own"].to_numpy(zero_copy_only=False)[order].astype(bool)
        same = np.r_[False, (ids[1:] == ids[:-1]) & (codes[1:] == codes[:-1]).all(axis=1)]
        ids, codes, homes, own = ids[~same], codes[~same], homes[~same], own[~same]
        unit, m = _unit(codes), len(ids)
        out = _blank(m, degree)
        repeated = bool((ids[1:] == ids[:-1]).any())
        for a in range(0, m, 1024):
            sims = unit[a : a + 1024] @ unit.T
            rows = np.arange(len(sims))
            sims[rows, a + rows] = _NONE
            if repeated:
                sims[ids[a : a + 1024, None] == ids[None, :]] = _NONE
            p, s = _best(sims, degree)
            k, part = p.shape[1], out[a : a + 1024]
            part["id"][:, :k], part["sim"][:, :k], part["home"][:, :k] = np.where(s > _NONE, ids[p], -1), s, homes[p]
        out["new"] = np.where(out["id"] >= 0, 2, 0)
        at_home = _messages(block, HOME, ids[own], block, codes[own], out[own], (out["new"][own] == 2).sum(axis=1))
        return pa.concat_tables([at_home, _messages(homes[~own], GAIN, ids[~own], homes[~own], None, out[~own])])

    return compare


def _merged(lists: np.ndarray, row, nid, sim, home, new, degree: int) -> np.ndarray:
    """Lists with further entries: each neighbour once (an entry that is there keeps its flag), the best kept."""
    n = len(lists)
    have = np.flatnonzero(lists["id"].ravel() >= 0)
    row = np.concatenate([have // degree, row])
    old = np.arange(len(row)) >= len(have)
    nid, sim, home, new = (np.concatenate([lists[c].ravel()[have], x]) for c, x in (("id", nid), ("sim", sim), ("home", home), ("new", new)))
    order = np.lexsort((old, nid, row))
    row, nid, sim, home, new = row[order], nid[order], sim[order], home[order], new[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (nid[1:] != nid[:-1])] if len(row) else np.zeros(0, bool)
    row, nid, sim, home, new = row[keep], nid[keep], sim[keep], home[keep], new[keep]
    order = np.lexsort((nid, -sim, row))
    row, nid, sim, home, new = row[order], nid[order], sim[order], home[order], new[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] if len(row) else row
    keep = place < degree
    at = row[keep], place[keep]
    out = _blank(n, degree)
    out["id"][at], out["sim"][at], out["home"][at], out["new"][at] = nid[keep], sim[keep], home[keep], new[keep]
    return out


def _meetings(ids, lists, at_home, unit, far, here, block: int, degree: int, width: int):
    """(owner, other, similarity) of what the join of neighbours of neighbours finds in a block, rows of ``ids`` (sorted).

    ``at_home`` marks the vectors u whose neighbours meet; ``here`` those that were compared with one another at the start.
    """
    n = len(ids)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    entry = np.flatnonzero(lists["id"].ravel() >= 0)
    who, to = entry // degree, lists["id"].ravel()[entry]
    new = lists["new"].ravel()[entry] > 0
    guests, hosts = np.flatnonzero(~at_home), np.flatnonzero(at_home)
    seen = np.zeros(n, bool)
    seen[who[~new & (lists["home"].ravel()[entry] == block)]] = True
    guests = guests[~seen[guests]]
    at = np.minimum(np.searchsorted(ids, to), n - 1)
    present = ids[at] == to
    who, to, new = who[present], at[present], new[present]
    known = np.sort(who * n + to)
    u, v, new = np.concatenate([who, to]), np.concatenate([to, who]), np.concatenate([new, new])
    keep = at_home[u]
    u, v, new = u[keep], v[keep], new[keep]
    lively = np.zeros(n, bool)
    lively[u[new]] = True
    keep = lively[u]
    u, v, new = u[keep], v[keep], new[keep]
    found = []
    for a in range(0, len(guests) if len(hosts) else 0, 1024):
        g = guests[a : a + 1024]
        sims = unit[g] @ unit[hosts].T
        i, j = np.nonzero(sims > np.minimum(far[g][:, None], far[hosts][None, :]))
        found.append((g[i], hosts[j], sims[i, j]))
    if len(u):
        found += _common(ids, u, v, new, unit, far, here, width)
    if not found:
        return none
    a, b, s = (np.concatenate(x) for x in zip(*found))
    owner, other, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    keep = (s > far[owner]) & (ids[owner] != ids[other])
    owner, other, s = owner[keep], other[keep], s[keep]
    if not len(owner):
        return none
    code, first = np.unique(owner * n + other, return_index=True)
    known = known[np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))] == code if len(known) else np.zeros(len(code), bool)
    first = first[~known]
    owner, other, s = owner[first], other[first], s[first]
    order = np.lexsort((other, -s, owner))
    owner, other, s = owner[order], other[order], s[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = place < degree
    return owner[keep], other[keep], s[keep]


def _common(ids, u, v, new, unit, far, here, width: int) -> list:
    """Pairs of vectors that have a neighbour u in common, one of them new to it, and that are better than what one of them has."""
    order = np.lexsort((~new, v, u))
    u, v, new = u[order], v[order], new[order]
    keep = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    u, v, new = u[keep], v[keep], new[keep]
    # What lists a hub is sampled by a hash, new entries first.
    order = np.lexsort(((ids[v].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), ~new, u))
    u, v, new = u[order], v[order], new[order]
    who, first = np.unique(u, return_index=True)
    row = np.searchsorted(who, u)
    place = np.arange(len(u)) - first[row]
    keep = place < width
    row, place, v, new = row[keep], place[keep], v[keep], new[keep]
    width = int(place.max()) + 1
    members, fresh = np.full((len(who), width), -1, np.int64), np.zeros((len(who), width), bool)
    members[row, place], fresh[row, place] = v, new
    upper = np.triu(np.ones((width, width), bool), 1)
    found = []
    for a in range(0, len(who), 512):
        m, f = members[a : a + 512], fresh[a : a + 512]
        ok, local, reach = m >= 0, here[m], np.where(m >= 0, far[m], 9.0)
        some = unit[m]
        sims = np.matmul(some, some.transpose(0, 2, 1))
        hit = sims > np.minimum(reach[:, :, None], reach[:, None, :])
        hit &= upper & (f[:, :, None] | f[:, None, :]) & ~(local[:, :, None] & local[:, None, :]) & (ok[:, :, None] & ok[:, None, :])
        r, i, j = np.nonzero(hit)
        found.append((m[r, i], m[r, j], sims[r, i, j]))
    return found


def _round(degree: int, dim: int, meet: bool):
    """One block's round: take in what was gained elsewhere, let neighbours of neighbours meet, send on."""

    def turn(table: pa.Table) -> pa.Table:
        kind, ids, homes = (table[c].to_numpy() for c in ("kind", "id", "home"))
        block = table["block"][0].as_py()
        lists = _bytes(table["near"]).view(_entry(degree))
        there = np.flatnonzero(kind != GAIN)
        there = there[np.lexsort((kind[there], ids[there]))]
        there = there[np.r_[True, ids[there][1:] != ids[there][:-1]]] if len(there) else there
        if not len(there):
            return _SHAPE.empty_table()
        gain = np.flatnonzero(kind == GAIN)
        codes = _codes(table["vec"].take(pa.array(there)), dim)
        own_ids, own_kind, own_homes, own = ids[there], kind[there], homes[there], lists[there]
        if len(gain):
            at = np.minimum(np.searchsorted(own_ids, ids[gain]), len(own_ids) - 1)
            e = np.flatnonzero((lists["id"][gain].ravel() >= 0) & np.repeat((own_ids[at] == ids[gain]) & (own_kind[at] == HOME), degree))
            g = lists[gain]
            own = _merged(own, np.repeat(at, degree)[e], g["id"].ravel()[e], g["sim"].ravel()[e], g["home"].ravel()[e], np.full(len(e), 2, np.uint8), degree)
        out = []
        at_home = own_kind != VISIT
        if meet:
            far = own["sim"][:, degree - 1]
            owner, other, s = _meetings(own_ids, own, at_home, _unit(codes), far, own_homes == block, block, degree, 2 * degree)
            own["new"] = np.where(own["new"] == 2, 2, 0)
            mine = own_kind[owner] == HOME
            if mine.any():
                own = _merged(own, owner[mine], own_ids[other[mine]], s[mine], own_homes[other[mine]], np.full(mine.sum(), 2, np.uint8), degree)
            owner, other, s = owner[~mine], other[~mine], s[~mine]
            if len(owner):
                who = np.unique(owner)
                row = np.searchsorted(who, owner)
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                sent = _blank(len(who), degree)
                sent["id"][row, place], sent["sim"][row, place], sent["home"][row, place], sent["new"][row, place] = own_ids[other], s, own_homes[other], 2
                out.append(_messages(own_homes[who], GAIN, own_ids[who], own_homes[who], None, sent))
        stay = np.flatnonzero(own_kind == HOME)
        near = own[stay]
        r, c = np.nonzero((near["new"] == 2) & (near["home"] != block))
        to = np.unique(np.stack([r, near["home"][r, c].astype(np.int64)]), axis=1)
        fresh = (near["new"] == 2).sum(axis=1)
        near["new"] = np.minimum(near["new"], 1)
        out.append(_messages(block, HOME, own_ids[stay], block, codes[stay], near, fresh))
        out.append(_messages(to[1], VISIT, own_ids[stay][to[0]], block, codes[stay][to[0]], near[to[0]]))
        return pa.concat_tables(out)

    return turn


def _dealt(messages: DataFrame) -> DataFrame:
    """Messages with ``turn``: cells with very many visitors are dealt to several tasks, each with a copy of those at home."""
    crowds = messages.where(F.col("kind") == VISIT).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > MAX_VISITORS)
    parts = [(r["block"], -(-r["n"] // MAX_VISITORS)) for r in crowds.collect()]  # at most one cell for MAX_VISITORS messages
    if not parts:
        return messages.withColumn("turn", F.lit(0))
    many = F.broadcast(messages.sparkSession.createDataFrame(parts, "block int, _parts int"))
    rows = messages.join(many, "block", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    every = F.when(F.col("kind") == HOME, F.sequence(F.lit(0), F.col("_parts") - 1)).when(F.col("kind") == VISIT, F.array(F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("turn", F.explode(every)).drop("_parts")
    return rows.withColumn("kind", F.when((F.col("turn") > 0) & (F.col("kind") == HOME), F.lit(COPY)).otherwise(F.col("kind")).cast("byte"))


class Graph:
    """The settled graph: the lists at home and what is still on its way, and (id, leader) of the copies that follow others, if any."""

    def __init__(self, messages: DataFrame, copies: DataFrame | None, degree: int, rounds: int, pivots) -> None:
        self.messages, self.copies, self.degree, self.rounds, self.pivots = messages, copies, degree, rounds, pivots

    def lists(self) -> DataFrame:
        """(id, near): one merged list for each id but the copies."""
        degree = self.degree

        def merge(batches):
            for table in whole_keys(batches):
                ids = table["id"].to_numpy()
                lists = _bytes(table["near"]).view(_entry(degree))
                who, first = np.unique(ids, return_index=True)
                if len(who) < len(ids):
                    e = np.flatnonzero(lists["id"].ravel() >= 0)
                    row = np.repeat(np.searchsorted(who, ids), degree)[e]
                    lists = _merged(_blank(len(who), degree), row, *(lists[c].ravel()[e] for c in ("id", "sim", "home", "new")), degree)
                yield pa.RecordBatch.from_arrays([pa.array(who), _binary(lists.view(np.uint8).reshape(len(who), -1))], ["id", "near"])

        rows = self.messages.where(F.col("kind").isin(HOME, GAIN)).select("id", "near")
        return rows.repartition("id").sortWithinPartitions("id").mapInArrow(merge, "id long, near binary")

    def vectors(self) -> DataFrame:
        """(id, vec, home) of each vector but the copies."""
        return self.messages.where(F.col("kind") == HOME).select("id", "vec", "home")


def _unpacked(degree: int, k: int, at_least: float = -1.0):
    """Lists to (id, rank, neighbour, similarity) of their k first."""

    def unpack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0).to_numpy(), _bytes(batch.column(1)).view(_entry(degree))
            nid, sim = lists["id"][:, :k], lists["sim"][:, :k]
            r, c = np.nonzero((nid >= 0) & (sim >= at_least))
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array((c + 1).astype(np.int32)), pa.array(nid[r, c]), pa.array(sim[r, c].astype(np.float64))], ["id", "rank", "neighbour", "similarity"])

    return unpack


_LINKS = "id long, rank int, neighbour long, similarity double"


def neighbour_graph(table: DataFrame, key: str = "id", vector: str = "vector", dim: int = 64, degree: int = 8, most_rounds: int = 30) -> Graph:
    """The neighbour graph, materialised after each round in the shared folder; rounds go on until it has settled."""
    pivots = table.sparkSession.sparkContext.broadcast(fit(table, key, vector, dim))
    assigned = _assigned(table, key, vector, dim, degree, pivots)
    messages = written(assigned.groupBy("block").applyInArrow(_start(degree, dim), _MESSAGE))
    copies, rounds = None, 0
    while True:
        of = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0))
        state = messages.agg(of(HOME).alias("n"), of(FOLLOW).alias("copies"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh")).first()
        if state["copies"]:
            follow = messages.where(F.col("kind") == FOLLOW).select("id", "near").mapInArrow(_unpacked(degree, 1, _NONE), _LINKS)
            copies = written(follow.select("id", F.col("neighbour").alias("leader")).distinct())
        if rounds and state["fresh"] <= SETTLED * degree * state["n"] or rounds >= most_rounds:
            return Graph(messages, copies, degree, rounds, pivots)
        turns = _dealt(messages.where(F.col("kind") != FOLLOW))
        after = written(turns.groupBy("block", "turn").applyInArrow(_round(degree, dim, rounds > 0), _MESSAGE))
        forget(messages)
        messages, rounds = after, rounds + 1


def edges(graph: Graph, k: int, at_least: float = -1.0) -> DataFrame:
    """(id, rank, neighbour, similarity) of the k nearest in the lists, rank from 1; copies take over the list of the one they follow."""
    if graph.copies is None:
        return graph.lists().mapInArrow(_unpacked(graph.degree, k, at_least), _LINKS)
    own = cut_lineage(graph.lists().mapInArrow(_unpacked(graph.degree, k, at_least), _LINKS))
    # The one that is followed is as near as can be; then its list, without the copy itself.
    leader = graph.copies.select("id", F.col("leader").alias("neighbour"), F.lit(1.0).alias("similarity"))
    taken = graph.copies.join(own.withColumnRenamed("id", "leader"), "leader").where("id <> neighbour").select("id", "neighbour", "similarity")
    w = Window.partitionBy("id").orderBy(F.round(-F.col("similarity"), 5), "neighbour")
    followed = leader.unionByName(taken).dropDuplicates(["id", "neighbour"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return own.unionByName(followed.select("id", "rank", "neighbour", "similarity"))


def nearest(table: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", dim: int = 64, degree: int | None = None) -> DataFrame:
    """(id, rank, neighbour, distance) of the k most similar vectors of every usable vector; distance is 1 - cosine."""
    found = edges(neighbour_graph(table, key, vector, dim, degree or k + 3), k)
    return found.select("id", "rank", "neighbour", (1 - F.col("similarity")).alias("distance"))


def similar_pairs(table: DataFrame, at_least: float = 0.9, k: int = 5, key: str = "id", vector: str = "vector", dim: int = 64, degree: int | None = None) -> DataFrame:
    """(id_a, id_b) of at least the given similarity, one among the k most similar of the other."""
    found = edges(neighbour_graph(table, key, vector, dim, degree or k + 3), k, at_least)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).where("id_a <> id_b").distinct()


def greedy_search(links: DataFrame, points: DataFrame, queries: DataFrame, k: int = 5, beam: int = 48, dim: int = 64) -> DataFrame:
    """(query, rank, neighbour, distance): walk the graph from each query's entries, best first.

    ``links`` is (id, neighbour), ``points`` (id, vec) and ``queries`` (query, vec,
    entry). Each hop expands the not yet expanded of the ``beam`` best vectors
    found so far, and the walk goes on until every vector of every beam has been
    expanded. A query is never its own neighbour. The queries are a stated set, so
    every hop is a join of that set's frontier with the graph, on the vector's id.
    """
    around = links.groupBy("id").agg(F.collect_list("neighbour").alias("out"))  # bounded: twice the lists' length
    points = points.select(F.col("id").alias("neighbour"), F.col("vec").alias("v"))

    @F.arrow_udf("float")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.float32())
        return pa.array((_unit(_codes(a, dim)) * _unit(_codes(b, dim))).sum(axis=1).astype(np.float32))

    asked = written(queries.select("query", "vec").dropDuplicates(["query"]))
    starts = queries.select("query", F.col("entry").alias("neighbour")).distinct().join(points, "neighbour").join(asked, "query")
    best = Window.partitionBy("query").orderBy(F.col("sim").desc(), "neighbour")
    top = lambda rows: rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).drop("_r")
    state = written(top(starts.select("query", "neighbour", cosine("vec", "v").alias("sim"), F.lit(False).alias("done"))))
    around = written(around)
    while True:  # the beam only improves, so what has left it never comes back
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        steps = open_.select("query", F.col("neighbour").alias("id")).join(around, "id").select("query", F.explode("out").alias("neighbour")).distinct()
        new = steps.join(state, ["query", "neighbour"], "left_anti").where("query <> neighbour")
        scored = new.join(points, "neighbour").join(asked, "query").select("query", "neighbour", cosine("vec", "v").alias("sim"), F.lit(False).alias("done"))
        after = written(top(state.withColumn("done", F.lit(True)).unionByName(scored)))
        forget(state)
        state = after
    ranked = state.where("query <> neighbour").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "neighbour", (1 - F.col("sim").cast("double")).alias("distance"))


def walkable(graph: Graph) -> DataFrame:
    """(id, neighbour) of the lists both ways; a hub's incoming links are sampled to the lists' length by a hash."""
    links = edges(graph, graph.degree).select("id", "neighbour")
    turned = Window.partitionBy("id").orderBy(F.xxhash64("neighbour"), "neighbour")
    back = links.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    back = back.withColumn("_r", F.row_number().over(turned)).where(F.col("_r") <= graph.degree).drop("_r")
    return links.unionByName(back).distinct()


def entered(graph: Graph, queries: DataFrame, dim: int = 64, doors: int = 48) -> DataFrame:
    """(query, vec, entry) of (query, vec): each query enters at ``doors`` vectors of each of its two nearest cells, spread over the cell by a hash."""
    pivots = graph.pivots

    def find(batches):
        for batch in batches:
            if batch.num_rows:
                blocks = pivots.value.blocks(_unit(_codes(batch.column(1), dim)))
                for k in range(blocks.shape[1]):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks[:, k].astype(np.int32))], ["query", "vec", "home"])

    spread = Window.partitionBy("home").orderBy(F.xxhash64("entry"), "entry")
    open_ = graph.vectors().select("home", F.col("id").alias("entry")).withColumn("_r", F.row_number().over(spread)).where(F.col("_r") <= doors).select("home", "entry")
    return queries.select("query", "vec").mapInArrow(find, "query long, vec binary, home int").join(open_, "home").where("query <> entry").select("query", "vec", "entry")


def search(table: DataFrame, every: int = 50, k: int = 5, key: str = "id", vector: str = "vector", dim: int = 64, degree: int = 10, held_out: bool = True, **how) -> DataFrame:
    """Greedy search for every row whose id is divisible by ``every``, against all rows.

    With ``held_out`` the graph is built without the queries, which are then met among
    themselves apart, so that what comes out is what the walk finds and not what the lists held.
    """
    asks = F.coalesce(F.col(key) % every == 0, F.lit(False))

    def encode(batches):
        for ids, codes in _encode(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(codes)], ["query", "vec"])

    queries = _usable(table.where(asks), key, vector, dim).mapInArrow(encode, "query long, vec binary").dropDuplicates(["query"])
    graph = neighbour_graph(table.where(~asks) if held_out else table, key, vector, dim, degree)
    found = greedy_search(walkable(graph), graph.vectors(), entered(graph, queries, dim), k, dim=dim, **how)
    if not held_out:
        return found
    among = edges(neighbour_graph(table.where(asks), key, vector, dim, degree), k).select(F.col("id").alias("query"), "neighbour", (1 - F.col("similarity")).alias("distance"))
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    both = found.select("query", "neighbour", "distance").unionByName(among)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "distance")
