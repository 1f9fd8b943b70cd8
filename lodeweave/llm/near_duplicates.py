"""Near-duplicate records by generalised pigeonhole.

A record is a bit vector: one bit per word shingle of the whole collection
(48-bit hashes; no shingle is left out). If the larger of two records y is similar to
the smaller one x by J or more, at most t = n - ceil(2J / (1 + J) n) of the n bits
of x are missing in y. The dimensions are grouped into partitions of correlated
bits. For each x a dynamic program gives every partition its own threshold, -1 or
more, so that the thresholds and their number sum to t + 1; then y misses in at
least one partition no more of x's bits than its threshold allows.

Correlation is estimated on a bounded sample of records (``SAMPLE``): bits that
several of them hold go to one partition if the same two records are the first of
the sample to hold them, up to 16 bits a partition. Bits that the sample does not
show twice are rare, and each is a partition of its own. How many candidates a
threshold gives is estimated from a histogram of all bits of all records: bits of
one partition mostly occur together, so a threshold that asks for c of x's bits in
it finds about as many records as hold the c-th most frequent of these bits.

Each record is indexed under its partitions with its bits there as a mask and its
threshold. What meets in a partition is compared by mask, size and threshold;
candidates are verified by a 512-bit parity sketch (whose Hamming distance never
exceeds that of the full vectors) and at last by the similarity of all their
bits. No step can lose a pair, whatever partitions and thresholds are chosen.

Equal texts are one class: they are worked once and joined again at the end.
A class or group of any size is never gathered in one task, and no step
takes pairs within a group of copies. A partition that very many records share is cut
into blocks, and pairs of blocks meet in tasks of their own.

Null names count as empty; records with null, empty or too short
descriptions have no partner.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.splitting import plain_text
from lodeweave.runtime import cut_lineage, dropping_shuffles, forget, written

#: Buckets of the histogram of bit counts, and of a block in which it travels: 16 MB whatever the data.
BUCKETS, BLOCK = 1 << 22, 1 << 15
#: Records that the partitions are fitted on and the bits of them that are looked at; bits of a partition.
SAMPLE, SAMPLE_BITS, WIDEST = 4096, 1 << 21, 16
SKETCH_WORDS = 8
#: Entries of a partition that meet in one block, and pairs looked at in one step.
HOT, STEP = 16384, 1 << 22
#: Credits on either side of the price at which a record's need is met that the dynamic program settles.
CORE = 24
_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Sorted distinct 48-bit shingle hashes of texts."""

    def __init__(self, width: int, least_words: int) -> None:
        self.width, self.least = width, least_words
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > 1 << 19:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            return np.array([known[w] for w in words], np.uint64)

    def words(self, name: str | None, text: str | None) -> list[str] | None:
        """Words of a record, or None if its text has too few."""
        body = _WORD.findall(text.lower()) if text else []
        return (_WORD.findall(name.lower()) if name else []) + body if len(body) >= self.least else None

    def many(self, words: list[list[str]]) -> list[np.ndarray]:
        """Bits of each list of words."""
        sizes = np.array([len(w) for w in words])
        hashed = self._hashes([w for x in words for w in x])
        n = max(0, len(hashed) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            out = (out ^ hashed[k : k + n]) * _M1
            out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
        out >>= np.uint64(16)
        bits, at = [], 0
        for size in sizes:  # what reaches over the end of a record is left out
            own = np.sort(out[at : at + max(0, size - self.width + 1)])
            bits.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
            at += size
        return bits

    def one(self, name: str | None, text: str | None) -> np.ndarray | None:
        """Bits of a record, or None if its text has too few words."""
        words = self.words(name, text)
        return None if words is None else self.many([words])[0]


def records(table: DataFrame, key: str, name: str, text) -> DataFrame:
    """(key, rid, name, text): rid is one number per distinct name and text."""
    out = table.select(F.col(key).alias("key"), F.coalesce(F.col(name), F.lit("")).alias("name"), text.alias("text")).where("key is not null and text is not null")
    return out.withColumn("rid", F.xxhash64("name", "text"))


def _rows(parts: list[np.ndarray]) -> pa.Array:
    """Arrays as the values of a binary column."""
    width = parts[0].dtype.itemsize if parts else 1
    ends = np.cumsum([0] + [len(p) * width for p in parts]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts).tobytes() if parts else b"")])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(kind) if ends[-1] > ends[0] else np.empty(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
_VECTORS = "rid long, n int, high binary, low binary, " + ", ".join(f"{c} long" for c in _SKETCH)


def vectors(base: DataFrame, width: int, least: int) -> DataFrame:
    """(rid, n, high, low, s0..): size, bits (upper 32 binary digits, in ascending order, and lower 16) and parity sketch of each distinct record; written out once.

    The upper digits alone verify pairs: two different shingles of a pair agree there once in 4 billion.
    """

    def shingle(batches):
        shingler, seen = Shingler(width, least), set()

        def made(rids, words):
            every = [(r, b) for r, b in zip(rids, shingler.many(words)) if len(b)]
            if not every:
                return
            bits = [b for _, b in every]
            flat, sizes = np.concatenate(bits), np.array([len(b) for b in bits])
            at = ((flat * _M3) >> np.uint64(55)).astype(np.int64) + np.repeat(np.arange(len(bits)) * 64 * SKETCH_WORDS, sizes)
            parity = (np.bincount(at, minlength=len(bits) * 64 * SKETCH_WORDS) & 1).astype(np.uint8)
            sketch = np.packbits(parity.reshape(len(bits), -1), axis=1).view(np.int64)
            halves = [_rows([(b >> np.uint64(16)).astype(np.uint32) for b in bits]), _rows([b.astype(np.uint16) for b in bits])]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in every], pa.int64()), pa.array(sizes, pa.int32()), *halves, *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_WORDS)]], ["rid", "n", "high", "low", *_SKETCH])

        for batch in batches:
            rids, words, size = [], [], 0
            for rid, name, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if rid in seen:
                    continue
                seen.add(rid)
                own = shingler.words(name, text)
                if own is not None:
                    rids.append(rid)
                    words.append(own)
                    size += len(own)
                if size > 1 << 18:
                    yield from made(rids, words)
                    rids, words, size = [], [], 0
            yield from made(rids, words)

    def once(batches):
        seen = set()
        for batch in batches:
            take = []
            for k, rid in enumerate(batch.column(0).to_pylist()):
                if rid not in seen:
                    seen.add(rid)
                    take.append(k)
            yield batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))

    return written(base.select("rid", "name", "text").mapInArrow(shingle, _VECTORS).repartition("rid").mapInArrow(once, _VECTORS))


def _bits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bits of a batch (columns high, low last), and how many each record has."""
    high, sizes = _flat(batch.column("high"), np.uint32)
    low, _ = _flat(batch.column("low"), np.uint16)
    return high.astype(np.uint64) << np.uint64(16) | low, sizes


def histogram(table: DataFrame) -> np.ndarray:
    """Records per bucket of bits, over all records (an upper estimate of each bit's count)."""

    def count(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            if batch.num_rows:
                at, often = np.unique(_flat(batch.column(0), np.uint32)[0] & np.uint32(BUCKETS - 1), return_counts=True)
                counts[at] += often.astype(np.uint32)
        blocks = counts.reshape(-1, BLOCK)
        full = [k for k in range(len(blocks)) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in full], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for blob in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    rows = table.select("high").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    with dropping_shuffles(table.sparkSession):
        for r in rows.collect():  # at most 128 rows, 16 MB
            out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


class Partitions:
    """The partitions of correlated bits, as the sample shows them: sorted ``bits`` with their partition and place in its mask."""

    def __init__(self, bits: np.ndarray, part: np.ndarray, place: np.ndarray) -> None:
        self.bits, self.part, self.place = bits, part, place

    @classmethod
    def fit(cls, sample: list[np.ndarray]) -> Partitions:
        if not sample:
            return cls(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        row = np.repeat(np.arange(len(sample)), [len(b) for b in sample])
        flat = np.concatenate(sample)
        order = np.lexsort((row, flat))
        flat, row = flat[order], row[order]
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        often = np.diff(np.r_[start, len(flat)])
        start = start[often > 1]
        bits, first, second = flat[start], row[start], row[np.minimum(start + 1, len(row) - 1)]
        order = np.lexsort((bits, second, first))
        bits, first, second = bits[order], first[order], second[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])] if len(bits) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        place = np.arange(len(bits)) - np.flatnonzero(new)[group] if len(bits) else np.empty(0, np.int64)
        part = np.cumsum(new | (place % WIDEST == 0)) - 1
        order = np.argsort(bits)
        return cls(bits[order], part[order], (place % WIDEST)[order])

    def find(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partition (-1: the bit is one of its own) and place of each bit."""
        if not len(self.bits):
            return np.full(len(bits), -1), np.zeros(len(bits), np.int64)
        at = np.minimum(np.searchsorted(self.bits, bits), len(self.bits) - 1)
        known = self.bits[at] == bits
        return np.where(known, self.part[at], -1), np.where(known, self.place[at], 0)


def credits(n: np.ndarray, similarity: float) -> np.ndarray:
    """One more than the number of its bits that a record may miss in a partner of at least its size."""
    return n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1


def _options(row, freq):
    """Of each partition of a record, the thresholds that the program chooses from: (credits, candidates) of the cheapest a credit, of half and of all."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[start, len(row)])
    order = np.lexsort((freq, row))
    table = np.full((len(start), WIDEST), np.inf)
    table[np.repeat(np.arange(len(start)), size), np.arange(len(row)) - np.repeat(start, size)] = freq[order]
    ratio = table / np.arange(1, WIDEST + 1)
    best = WIDEST - np.argmin(ratio[:, ::-1], axis=1)
    credit = np.stack([best, (size + 1) // 2, size], axis=1)
    return start, credit, np.take_along_axis(table, credit - 1, 1), np.min(ratio, axis=1)


def allocate(need: np.ndarray, single_row: np.ndarray, single_cost: np.ndarray, group_row: np.ndarray, credit: np.ndarray, cost: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Credits of each group, and how many of each record's single bits are probed (cheapest first), at the least sum of estimated candidates.

    ``single_*`` are sorted by record and cost; ``group_*`` by record. The credits of
    a record sum to what it needs at least. The program settles what lies within
    ``CORE`` credits of the price at which the need is met; what is cheaper still is taken.
    """
    n = len(need)
    have = np.bincount(single_row, minlength=n)
    scarce = (have + np.bincount(group_row, credit[:, 0], minlength=n) < need + CORE)[group_row]
    step = np.where(scarce, credit[:, 2], credit[:, 0])  # where little can be left out, groups count with all their bits
    rows = np.concatenate([single_row, group_row])
    gives = np.concatenate([np.ones(len(single_row), np.int64), step])
    order = np.lexsort((np.concatenate([single_cost, np.where(scarce, cost[:, 2] / np.maximum(1, step), ratio)]), rows))
    rows, upto = rows[order], np.cumsum(gives[order])
    upto -= (np.concatenate([[0], upto])[np.searchsorted(rows, np.arange(n))])[rows]
    sure = np.zeros(len(order), bool)
    sure[order] = upto <= need[rows] - CORE
    core = np.zeros(len(order), bool)
    core[order] = upto - gives[order] < need[rows] + CORE
    taken, core = sure[len(single_row) :], (core & ~sure)[len(single_row) :]
    got = np.where(taken, step, 0)
    paid = np.bincount(single_row[sure[: len(single_row)]], minlength=n)
    left = need - paid - np.bincount(group_row, got, minlength=n).astype(np.int64)
    first = np.cumsum(have) - have + paid
    have = have - paid
    total = np.concatenate([[0.0], np.cumsum(single_cost)])
    singles = paid.copy()
    index = np.flatnonzero(core)
    begin = np.searchsorted(group_row[index], np.arange(n))
    groups = np.bincount(group_row[index], minlength=n)
    todo = np.argsort(groups, kind="stable")
    for a in range(0, n, 512):
        rows = todo[a : a + 512]
        top, many = int(left[rows].max()), int(groups[rows].max())
        reach = np.arange(top + 1)
        least = np.where(reach == 0, 0.0, np.inf) * np.ones((len(rows), 1))
        chosen = np.zeros((many, len(rows), top + 1), np.int8)
        for g in range(many):
            live = np.flatnonzero(groups[rows] > g)
            at = index[begin[rows[live]] + g]
            before = least[live]
            now, pick, line = before.copy(), np.zeros(before.shape, np.int8), np.arange(len(live))[:, None]
            for o in range(credit.shape[1]):
                c = credit[at, o][:, None]
                price = before[line, np.maximum(reach - c, 0)] + cost[at, o][:, None]
                better = price < now
                np.copyto(now, price, where=better)
                np.copyto(pick, c.astype(np.int8), where=better)
            least[live], chosen[g][live] = now, pick
        rest = left[rows][:, None] - reach
        fits = (rest >= 0) & (rest <= have[rows][:, None])
        upto = first[rows][:, None] + np.clip(rest, 0, None)
        price = np.where(fits, least + total[np.minimum(upto, len(total) - 1)] - total[first[rows]][:, None], np.inf)
        k = np.argmin(price, axis=1)
        singles[rows] += left[rows] - k
        for g in range(many - 1, -1, -1):
            live = np.flatnonzero(groups[rows] > g)
            c = chosen[g, live, k[live]].astype(np.int64)
            got[index[begin[rows[live]] + g]] = c
            k[live] = np.maximum(0, k[live] - c)
    return got, singles


def _entries(bits: np.ndarray, sizes: np.ndarray, rids: np.ndarray, counts: np.ndarray, partitions: Partitions, similarity: float):
    """(key, rid, n, mask, threshold, estimate) of the partitions of a batch of records; threshold -1: not probed."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    freq = counts[(bits >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
    part, place = partitions.find(bits)
    alone = np.flatnonzero(part < 0)
    alone = alone[np.lexsort((bits[alone], freq[alone], row[alone]))]
    grouped = np.flatnonzero(part >= 0)
    grouped = grouped[np.lexsort((part[grouped], row[grouped]))]
    code = row[grouped] * (int(partitions.part.max()) + 1 if len(partitions.part) else 1) + part[grouped]
    if len(grouped):
        start, credit, cost, ratio = _options(code, freq[grouped])
        group_row, group_part = row[grouped][start], part[grouped][start]
        mask = np.bitwise_or.reduceat(1 << place[grouped], start)
        often = np.maximum.reduceat(freq[grouped], start)
    else:
        credit, cost, ratio = np.empty((0, 3), np.int64), np.empty((0, 3)), np.empty(0)
        group_row = group_part = mask = np.empty(0, np.int64)
        often = np.empty(0)
    need = credits(sizes.astype(np.int64), similarity)
    got, singles = allocate(need, row[alone], freq[alone] - 1, group_row, credit, cost, ratio)
    have = np.bincount(row[alone], minlength=n)
    rank = np.arange(len(alone)) - np.repeat(np.cumsum(have) - have, have)
    probed = rank < singles[row[alone]]
    shared = freq[alone] > 1  # a bit that one record holds finds nobody
    alone, probed = alone[shared], probed[shared]
    key = np.concatenate([bits[alone] * _M1, (group_part.astype(np.uint64) + np.uint64(1)) * _M2 ^ _M3])
    at = np.concatenate([row[alone], group_row])
    mask = np.concatenate([np.ones(len(alone), np.int64), mask])
    threshold = np.concatenate([probed.astype(np.int64) - 1, got - 1])
    return key, rids[at], sizes[at].astype(np.int32), mask.astype(np.int32), threshold.astype(np.int8), np.concatenate([freq[alone], often])


#: Roles of an entry: it asks and is asked, it only asks, it is only asked.
_BOTH, _ASKS, _ASKED = 0, 1, 2


def _blocked(key, rid, n, mask, threshold, often):
    """Entries with their role; those of a partition of several blocks under each pair of blocks that theirs is in."""
    role = np.zeros(len(key), np.int8)
    hot = np.flatnonzero(often > HOT)
    if not len(hot):
        return [key, rid, n, mask, threshold, role]
    blocks = np.ceil(often[hot] / HOT).astype(np.int64)
    own = ((rid[hot].view(np.uint64) * _M1) >> np.uint64(33)) % blocks.astype(np.uint64)
    out = [[np.delete(x, hot) for x in (key, rid, n, mask, threshold, role)]]
    every = np.repeat(np.arange(len(hot)), blocks)
    other = (np.arange(len(every)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
    for kind in (_ASKS, _ASKED):
        take = np.flatnonzero(threshold[hot][every] >= 0) if kind == _ASKS else np.arange(len(every))
        e, o = every[take], other[take]
        asking, asked = (own[e], o) if kind == _ASKS else (o, own[e])
        h = hot[e]
        salted = (key[h] ^ ((asking + np.uint64(1)) * _M2)) * _M1 ^ ((asked + np.uint64(1)) * _M3)
        out.append([salted, rid[h], n[h], mask[h], threshold[h], np.full(len(h), kind, np.int8)])
    return [np.concatenate(c) for c in zip(*out)]


def _index(table: DataFrame, counts: np.ndarray, partitions: Partitions, similarity: float) -> DataFrame:
    """(key, rid, what): each record under its partitions; ``what`` packs size, mask, threshold and role (see ``_packed``)."""
    shared = table.sparkSession.sparkContext.broadcast((counts, partitions))

    def emit(batches):
        counts, partitions = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                bits, sizes = _bits(part)
                key, rid, *rest = _blocked(*_entries(bits, sizes, part.column(0).to_numpy(), counts, partitions, similarity))
                made = key.view(np.int64), rid, _packed(*rest)
                for b in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[b : b + (1 << 16)]) for c in made], ["key", "rid", "what"])

    return table.select("rid", "high", "low").mapInArrow(emit, "key long, rid long, what long")


def _packed(n, mask, threshold, role) -> np.ndarray:
    """Size (31 bits), mask (16), threshold + 1 (6) and role (2) in one number."""
    return n.astype(np.int64) << 24 | mask.astype(np.int64) << 8 | (threshold.astype(np.int64) + 1) << 2 | role


def _unpacked(what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (what >> 24).astype(np.int32), (what >> 8 & 0xFFFF).astype(np.int32), (what >> 2 & 0x3F).astype(np.int8) - np.int8(1), (what & 3).astype(np.int8)


def _probe(entries: DataFrame, similarity: float) -> DataFrame:
    """(x_rid, y_rid): records y of at least the size of x that miss in a partition no more of its bits than x's threshold allows.

    One shuffle; the pairs of a sorted partition are made a bounded step at a time.
    """

    def probe(batches):
        for table in whole_keys(batches):
            key, rid, what = (table[c].to_numpy() for c in ("key", "rid", "what"))
            n, mask, threshold, role = _unpacked(what)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            first, members = np.repeat(start, size), np.repeat(size, size)
            asks = np.flatnonzero((members > 1) & (threshold >= 0) & (role != _ASKED))
            upto = np.cumsum(members[asks])
            a = 0
            while a < len(asks):
                done = upto[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(upto, done + STEP, side="right")))
                mine = asks[a:b]
                reach = members[mine]
                x = np.repeat(mine, reach)
                y = np.arange(len(x)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first[mine], reach)
                a = b
                nx, ny = n[x], n[y]
                ok = (nx < ny) | ((nx == ny) & (rid[x] < rid[y]))
                ok &= (nx >= similarity * ny) & (role[y] != _ASKS)
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(mask[x] & ~mask[y]) <= threshold[x]
                p, q = rid[x[ok]], rid[y[ok]]
                if len(p):
                    order = np.lexsort((q, p))
                    p, q = p[order], q[order]
                    new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(p[new]), pa.array(q[new])], ["x_rid", "y_rid"])

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(probe, "x_rid long, y_rid long")


def whole_keys(batches):
    """Tables of whole groups from batches sorted by their first column; the last group waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def sampled(table: DataFrame, seed: int = 3) -> list[np.ndarray]:
    """Bits of the records that the partitions are fitted on: at most ``SAMPLE`` records and ``SAMPLE_BITS`` bits."""
    n = table.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    chosen = table.where(F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("rid", "n", "high", "low")
    out, size = [], 0
    for batch in chosen.where(F.col("n") <= SAMPLE_BITS // 64).limit(SAMPLE).toArrow().to_batches():
        bits, sizes = _bits(batch)
        for own in np.split(bits, np.cumsum(sizes)[:-1]):
            if size + len(own) <= SAMPLE_BITS:
                out.append(own)
                size += len(own)
    return out


def class_pairs(table: DataFrame, similarity: float) -> DataFrame:
    """(rid_a, rid_b, similarity) of the classes of equal text that are at least so similar; ``table`` is the result of ``vectors``."""
    entries = _index(table, histogram(table), Partitions.fit(sampled(table)), similarity)
    candidates = written(_probe(entries, similarity).distinct())
    a, b = (table.select(*[F.col(c).alias(f"{side}_{c}") for c in ("rid", "n", *_SKETCH)]) for side in "xy")
    differ = sum(F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _SKETCH)
    near = candidates.join(a, "x_rid").join(b, "y_rid").where(differ <= F.lit((1 - similarity) / (1 + similarity) + 1e-9) * (F.col("x_n") + F.col("y_n"))).select("x_rid", "y_rid")
    near = written(near)
    forget(candidates)
    both = near.join(table.select(F.col("rid").alias("x_rid"), F.col("high").alias("x_bits")), "x_rid")
    both = both.join(table.select(F.col("rid").alias("y_rid"), F.col("high").alias("y_bits")), "y_rid")

    @F.arrow_udf("double")
    def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
        (p, p_sizes), (q, q_sizes) = _flat(x, np.uint32), _flat(y, np.uint32)
        # Number of the pair and bit in one number: two ascending runs, which a stable sort merges.
        code = lambda v, sizes: np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | v
        merged = np.sort(np.concatenate([code(p, p_sizes), code(q, q_sizes)]), kind="stable")
        twice = merged[1:][merged[1:] == merged[:-1]]
        common = np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=len(p_sizes))
        return pa.array(common / np.maximum(1, p_sizes + q_sizes - common))

    scored = both.select("x_rid", "y_rid", jaccard("x_bits", "y_bits").alias("similarity")).where(F.col("similarity") >= similarity)
    links = written(scored.select(F.least("x_rid", "y_rid").alias("rid_a"), F.greatest("x_rid", "y_rid").alias("rid_b"), "similarity"))
    forget(near)
    return links


class NearDuplicates:
    """Classes of equal text, links between them, and the groups they form.

    ``members`` is (key, rid) of every record that has bits, ``links`` is
    (rid_a, rid_b, similarity) between classes. Both are materialised.
    """

    def __init__(self, table: DataFrame, key: str, name: str, text, similarity: float = 0.5, width: int = 3, least: int = 20) -> None:
        base = records(table, key, name, text)
        table = vectors(base, width, least)
        self.members = written(base.select("key", "rid").distinct().join(table.select("rid"), "rid", "left_semi").select("key", "rid"))
        self.links = class_pairs(table, similarity)
        forget(table)

    def pairs(self, expand: int = 64) -> DataFrame:
        """(key_a, key_b) of records, smaller first.

        Members of classes of at most ``expand`` records give every pair. A
        larger class is given as a star around its smallest member, which alone
        stands for it towards other classes; no link between different texts is lost.
        """
        sizes = self.members.groupBy("rid").agg(F.count("*").alias("m"), F.min("key").alias("low"))
        several = sizes.where("m > 1")
        small = self.members.join(several.where(F.col("m") <= expand).select("rid"), "rid", "left_semi")
        inside = small.withColumnRenamed("key", "a").join(small.withColumnRenamed("key", "b"), "rid").select("a", "b").where("a < b")
        star = self.members.join(several.where(F.col("m") > expand).select("rid", "low"), "rid").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
        speak = self.members.join(sizes, "rid").where((F.col("m") <= expand) | (F.col("key") == F.col("low"))).select("rid", "key")
        across = self.links.select("rid_a", "rid_b").join(speak.select(F.col("rid").alias("rid_a"), F.col("key").alias("k")), "rid_a").join(speak.select(F.col("rid").alias("rid_b"), F.col("key").alias("l")), "rid_b")
        across = across.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b")).where("a <> b")
        return inside.unionByName(star).unionByName(across).select(F.col("a").alias("key_a"), F.col("b").alias("key_b")).distinct()

    def groups(self) -> DataFrame:
        """(key, class_id, group, class_size, links): equal texts share a class; group is the smallest class it is connected to; links go to other classes."""
        labels = components(self.links.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
        ends = self.links.select(F.col("rid_a").alias("rid")).unionByName(self.links.select(F.col("rid_b").alias("rid")))
        degree = ends.groupBy("rid").agg(F.count("*").alias("links"))
        sizes = self.members.groupBy("rid").agg(F.count("*").alias("class_size"))
        out = self.members.join(sizes, "rid").join(degree, "rid", "left").join(labels.withColumnRenamed("node", "rid"), "rid", "left")
        return out.select("key", F.col("rid").alias("class_id"), F.coalesce("label", "rid").alias("group"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of the component.

    Large-star and small-star rounds: each is two aggregations over the edges, which
    lose no connection; the number of rounds grows with the logarithm of
    the longest chain. Every round is materialised in the checkpoint folder.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = cut_lineage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def asset_duplicates(assets: DataFrame, similarity: float = 0.5, width: int = 3, least: int = 20) -> NearDuplicates:
    """Near-duplicates of catalogue records by name and description."""
    return NearDuplicates(assets, "identifier", "name", plain_text("description"), similarity, width, least)
