"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens; pieces are dealt into groups by a hash, a
fixed number of pieces a group, and each group is packed on its own: best fit in decreasing order,
then local search among the bins that are not full. A group wastes at most what its last bins leave,
so the loss does not grow with the group's share of the corpus, and no task sees more than its group.

Local search takes a step if it raises the sum of squared fills: moving a piece, exchanging one piece
for one, or one for two. Such steps fill the fuller bin and drain the other; drained bins vanish.

Defined cases: a null or empty text is the end id alone. Rows equal in id and text are packed each.
Only texts over ``capacity`` tokens are cut, the first piece taking what is left over. An empty table
gives no sequence. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, keyed, map_arrow, staged
from areaflow.llm.tokens import encoder, vocabulary_path

PIECES = f"doc_id long, {KEY} long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2,
           with_ids: bool = False) -> DataFrame:
    """Token pieces of every document, with their ids if wanted."""
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        code = encoder(path)
        out = defaultdict(list)
        for doc, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", KEY, "text")], strict=True):
            ids = code(text) + end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            for k, lo in enumerate([0, *range(first, n, capacity)]):
                hi = first if k == 0 else lo + capacity
                raw = ids[4 * lo:4 * hi]
                for name, v in zip(("doc_id", KEY, "piece", "start", "length", "ids_crc32", "ids"),
                                   (doc, key, k, lo, hi - lo, zlib.crc32(raw), raw), strict=True):
                    out[name].append(v)
        return out

    return map_arrow(keyed(docs), run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it.

    Bins stand in stacks by free space, and the bits of an integer say which stacks hold any.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        fits = free >> lengths[i]
        if fits:
            space = lengths[i] + (fits & -fits).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                free ^= 1 << space
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = space - lengths[i]
        if left:
            stacks[left].append(b)
            free |= 1 << left
    return bins


class _Takers:
    """Open bins by free space and by what they can give back: nothing, a piece or two, by total length.

    Entries are left behind when a bin changes and dropped when they come up; the bits of an integer say which
    free spaces may have one.
    """

    def __init__(self, lengths: list[int]):
        self.lengths, self.bits, self.stacks, self.version = lengths, {}, defaultdict(list), defaultdict(int)

    def put(self, b: int, pieces: list[int], free: int) -> None:
        self.version[b] += 1
        if not free or not pieces:
            return
        back = {0: ()} | {self.lengths[y]: (y,) for y in pieces}
        for k, y in enumerate(pieces):
            for z in pieces[:k]:
                back.setdefault(self.lengths[y] + self.lengths[z], (y, z))
        for total, some in back.items():
            self.stacks[total, free].append((b, self.version[b], some))
            self.bits[total] = self.bits.get(total, 0) | 1 << free

    def fullest(self, total: int, least: int, giver: int) -> tuple[int, int, tuple] | None:
        """Free space, bin and pieces of the fullest bin, not the giver, that has ``least`` free and gives back ``total``."""
        fits = self.bits[total] >> least
        while fits:
            step = (fits & -fits).bit_length() - 1
            stack = self.stacks[total, least + step]
            while stack and self.version[stack[-1][0]] != stack[-1][1]:
                stack.pop()
            if not stack:
                self.bits[total] ^= 1 << least + step
            for b, version, some in reversed(stack):
                if b != giver and self.version[b] == version:
                    return least + step, b, some
            fits &= fits - 1
        return None


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fill bins from emptier ones by moves and exchanges while the sum of squared fills grows.

    Only bins with space take part. Each gives in turn, the emptiest first, to any other: of its moves and its
    exchanges of a piece for a shorter one or for two shorter ones, the one that leaves the least space in the
    taker. The search ends when a whole pass over the open bins found no step.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [b for b in range(len(bins)) if fill[b] < capacity]
    takers = _Takers(lengths)
    for b in open_:
        takers.put(b, bins[b], capacity - fill[b])

    def step(giver: int) -> bool:
        best = (capacity + 1, 0, 0, 0, ())
        for need, x in sorted({lengths[x]: x for x in bins[giver]}.items(), reverse=True):
            for total in takers.bits:
                gain = need - total
                if gain <= 0 or not takers.bits[total] >> gain:
                    continue
                found = takers.fullest(total, gain, giver)
                # The taker must end fuller than the giver was for the squares to grow.
                if found and found[0] - gain < capacity - fill[giver] and (found[0] - gain, -gain) < best[:2]:
                    best = (found[0] - gain, -gain, x, found[1], found[2])
            if not best[0]:
                break
        if best[0] > capacity:
            return False
        _, gain, x, taker, back = best
        bins[giver].remove(x)
        bins[taker].append(x)
        for y in back:
            bins[taker].remove(y)
            bins[giver].append(y)
        fill[giver] += gain
        fill[taker] -= gain
        for b in (giver, taker):
            takers.put(b, bins[b], capacity - fill[b])
        return True

    moved = True
    while moved:
        moved = False
        open_ = sorted((b for b in open_ if 0 < fill[b] < capacity), key=fill.__getitem__)
        for giver in open_:
            while 0 < fill[giver] < capacity and step(giver):
                moved = True
    return [b for b in bins if b]


def pack(items: DataFrame, capacity: int = 1024, group_size: int = 20_000) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``.

    ``items`` is a written table, so its rows are counted from file footers. Groups are hashed from
    row key, piece and start; copies of one row differ by nothing, so a random salt spreads them.
    """
    groups = max(1, -(-items.count() // group_size))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].tolist()
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for number, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += lengths[i]
        return rows.drop(columns="packing_group").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    salted = items.withColumn("packing_group", F.floor(F.rand(7) * groups).cast("long"))
    return staged(salted, "pieces").groupBy("packing_group").applyInPandas(run, schema)


def packed(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Pieces of every document and their places in sequences of ``capacity`` tokens."""
    return pack(staged(pieces(docs, capacity, **options), "lengths"), capacity)
