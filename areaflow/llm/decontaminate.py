"""Benchmark decontamination by the q-gram lemma.

Two texts that differ by at most ``e`` edits over ``m`` characters share at least ``m + 1 - (e + 1) q`` of
their q-grams, on diagonals at most ``e`` apart. Every position of every document is looked up among the
benchmark's q-grams; hits of one item are counted in bands of diagonals that are twice as wide as the edit
budget and overlap by half, so that any match lies whole in one band; bands where enough different places of the item
are hit to reach the bound are verified by an alignment kept within the band.

Texts are compared with the case of all letters folded, with each run of ASCII white space and punctuation as one
space.

Defined cases: a null or empty text matches nothing, a null or empty item is matched by nothing. Every item has
its stated edit budget; items too short for a guarantee by 8-grams are looked up by the longest grams that give
one. Items shorter than 8 bytes are found as exact words. Rows equal in id and text get equal results each. Repeated items are
reported each. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, back_to, keyed, map_arrow

Q = 8
#: Bytes of benchmark text that one scan of the documents carries to the workers.
BLOCK_BYTES = 8 << 20
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.arange(256, dtype=np.uint8)
for _b in [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_b] = 32


def folded(text: str) -> np.ndarray:
    """Comparable bytes of a text: case folded, words set apart by single spaces."""
    x = _FOLD[np.frombuffer(text.casefold().encode(), np.uint8)]
    blank = x == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    x = x[keep]
    lo, hi = (x[:1] == 32).sum(), len(x) - (x[-1:] == 32).sum()
    return x[lo:max(lo, hi)]


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Every run of ``q`` bytes, at most eight, as one number."""
    if len(x) < q:
        return np.empty(0, np.uint64)
    x = np.append(x, np.zeros(Q - q, np.uint8))
    each = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, Q)).view("<u8").ravel()
    return each & np.uint64((1 << 8 * q) - 1)


def budget(m: int, rate: float) -> tuple[int, int, int]:
    """Edits allowed for an item of ``m`` bytes, the length of its grams and how many a match is then sure to share."""
    e = min(int(rate * m), m - 1)
    q = min(Q, m // (e + 1))
    return e, q, m + 1 - (e + 1) * q


def distance(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int, int] | None:
    """Fewest edits, if within ``limit``, that turn the item into a run of the text along the diagonals ``low`` to ``high``.

    Returns edits, start and end. A diagonal is a place in the text less the place in the item; no cell outside the band is
    looked at. For each number of edits every diagonal of the band keeps how far into the item it reaches; equal bytes are
    run through by a table of the next unequal one. Beyond the text's ends stand bytes that equal none, so a step
    over them costs what leaving out the item's byte does.
    """
    m, width = len(item), high - low + 1
    part = np.full(m + width - 1, 255, np.uint8)
    lo, hi = max(0, low), min(len(text), m + high)
    part[lo - low:hi - low] = text[lo:hi]
    stop = np.full((width, m + 1), m, np.int32)
    unequal = np.lib.stride_tricks.sliding_window_view(part, m) != item
    stop[:, :m] = np.where(unequal, np.arange(m, dtype=np.int32), m)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    each = np.arange(width)
    origin = each.copy()
    reach = stop[:, 0]
    for edits in range(limit + 1):
        if edits:
            ways = np.full((3, width), -1, np.int32)
            ways[0] = reach + 1
            ways[1, :-1] = reach[1:] + 1
            ways[2, 1:] = reach[:-1]
            way = ways.argmax(0)
            reach = np.minimum(ways[way, each], m)
            origin = origin[each + np.array([0, 1, -1])[way]]
            reach = stop[each, reach]
        done = np.flatnonzero(reach == m)
        if len(done):
            d = int(done[0])
            start = min(max(0, low + int(origin[d])), len(text))
            return edits, start, max(start, min(len(text), low + d + m))
    return None


class Grams:
    """The grams of one length of some items: a bit table for all positions of a text, then exact postings."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]):
        self.q = q
        values = [grams(x, q) for _, x in items]
        self.value = np.concatenate(values)
        self.item = np.concatenate([np.full(len(v), k) for (k, _), v in zip(items, values, strict=True)])
        self.place = np.concatenate([np.arange(len(v)) for v in values])
        order = np.argsort(self.value, kind="stable")
        self.value, self.item, self.place = self.value[order], self.item[order], self.place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.slot(self.value)] = True

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return (values * _MIX) >> np.uint64(64 - _BITS)

    def hits(self, x: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Item, diagonal and place in the item of every gram that a text shares, in order; of items that can reach ``need``."""
        g = grams(x, self.q)
        at = np.flatnonzero(self.table[self.slot(g)])
        lo = np.searchsorted(self.value, g[at], "left")
        n = np.searchsorted(self.value, g[at], "right") - lo
        if not n.sum():
            return None
        each = np.repeat(np.arange(len(at)), n)
        posting = np.repeat(lo, n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[posting]
        able = np.flatnonzero((np.bincount(item, minlength=len(need)) >= need)[item])
        if not len(able):
            return None
        item, place = item[able], self.place[posting[able]]
        diagonal = at[each[able]] - place
        order = np.lexsort((diagonal, item))
        return item[order], diagonal[order], place[order]


class Items:
    """A block of items, with their grams by length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float):
        self.items = items
        self.budgets = [budget(len(x), rate) if len(x) else (0, Q, 1) for _, x in items]
        self.need = np.array([need for _, _, need in self.budgets], np.int64)
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for k, (_, x) in enumerate(items):
            if len(x) >= Q:
                by[self.budgets[k][1]].append((k, x))
        self.grams = [Grams(q, some) for q, some in sorted(by.items())]
        self.short = [(k, x.tobytes()) for k, (_, x) in enumerate(items) if 0 < len(x) < Q]

    def bands(self, x: np.ndarray):
        """Item and first and last diagonal of each band whose hits reach the bound, each place of the item counted once."""
        for some in self.grams:
            hits = some.hits(x, self.need)
            if hits is None:
                continue
            item, diagonal, place = hits
            edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                k = int(item[lo])
                e, _, need = self.budgets[k]
                d, width = diagonal[lo:hi], e + 1
                for shift in (0, width):
                    band = (d + shift) // (2 * width)
                    starts = np.flatnonzero(np.diff(band, prepend=-(1 << 60)))
                    ends = np.append(starts[1:], len(d))
                    enough = ends - starts >= need
                    for s, t in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
                        if len(np.unique(place[lo + s:lo + t])) >= need:
                            low = int(band[s]) * 2 * width - shift
                            yield k, low, low + 2 * width - 1

    def regions(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified regions: item id, edits, start and end in the folded text; overlapping ones of an item once."""
        x = folded(text)
        best: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, low, high in self.bands(x):
            # A band may hold several copies one after the other only if they overlap; one is enough.
            hit = distance(self.items[k][1], x, low, high, self.budgets[k][0])
            if hit:
                best[k].append(hit)
        out = []
        for k, hits in best.items():
            taken: list[tuple[int, int, int]] = []
            for cost, s, t in sorted(hits):
                if all(t <= a or s >= b for _, a, b in taken):
                    taken.append((cost, s, t))
            out += [(self.items[k][0], *h) for h in taken]
        if self.short:
            padded = b" " + x.tobytes() + b" "
            for k, word in self.short:
                at = padded.find(b" " + word + b" ")
                while at >= 0:
                    out.append((self.items[k][0], 0, at, at + len(word)))
                    at = padded.find(b" " + word + b" ", at + 1)
        return sorted(out, key=lambda r: (r[0] is None, r))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_BYTES``, one at a time on the driver; at least one block.

    The stated query set is compared with all documents block by block, so a block, not the benchmark, is
    what a scan broadcasts.
    """
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if size and size + len(row["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """Regions of documents that repeat an item with at most ``rate`` edits a byte.

    Columns: ``doc_id``, row key, ``item_id``, ``edits``, ``start``, ``stop`` (bytes of the folded text). The
    documents are scanned where they lie; nothing is shuffled.
    """
    spark = docs.sparkSession
    found = None
    for block in _blocks(benchmark):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batch, sent=sent, name=name):
            if _READY.get("name") != name:
                _READY.update(name=name, items=Items([(i, folded(t)) for i, t in sent.value], rate))
            items = _READY["items"]
            out = {k: [] for k in ("doc_id", KEY, "item_id", "edits", "start", "stop")}
            for doc, row, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", KEY, "text")], strict=True):
                for hit in items.regions(text):
                    for k, v in zip(out, (doc, row, *hit), strict=True):
                        out[k].append(v)
            return out

        part = map_arrow(keyed(docs), run, f"doc_id long, {KEY} long, item_id long, edits int, start long, stop long")
        found = part if found is None else found.unionByName(part)
    return found


#: The items a worker has prepared for the task at hand.
_READY: dict = {}


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The documents without a leak, all columns as they came."""
    hit = leaks(docs, benchmark, rate).select("doc_id", KEY).distinct()
    return back_to(docs, hit, "left_anti").select("d.*")
