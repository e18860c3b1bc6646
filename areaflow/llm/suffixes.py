"""Removal of repeated substrings by merging sorted suffix runs.

A byte is removed if it is covered by a string of ``SPAN`` bytes that also starts earlier: in a document
with a smaller ``doc_id``, or at an earlier place of the same one. Strings are judged on the input, and
matches never cross documents.

Sorting every suffix of a corpus moves each byte a hundred times. Two equal strings of ``SPAN`` bytes hold
equal ``GRAM``-byte grams, and both choose the same one of them: the leftmost with the least hash. So starts
that choose the same gram form a run, and only the suffix at its anchor is sorted, with the bytes that the
run's strings need on either side:

1. Copies of whole texts are settled by digest; the first goes on.
2. Hashes of anchor grams are exchanged to find those that occur more than once.
3. For these, each task sorts the suffixes at its anchors into runs, drops suffixes equal in all their context
   but the first, front-codes what is left (bytes shared with the one before, then the rest), and sends each
   range of the order to one place.
4. There the runs meet in a loser tree that keeps for every loser how many bytes it shares with the winner, so
   known prefixes are never compared again. Suffixes with the same gram come out side by side; their
   strings are looked up in order of position, and a string seen before is a repeat.
5. Repeats go back to their documents as spans, and the bytes outside are hashed.

The order of suffixes is that of the hash of the first ``GRAM`` bytes, then the bytes: how anchors spread over the hash is
known, so even ranges need no sampling. What a context shares with its neighbours in this order bounds which of its strings can occur
again, and only those are looked up, a few left lengths at a time in large groups. Contexts of one gram beyond ``GROUP_CONTEXTS`` leave the
merge as a row each and are cut into strings that meet again in an aggregation that combines per task.

Defined cases: a null text is empty; texts under ``SPAN`` bytes keep everything. A null ``doc_id`` comes first.
Rows of one ``doc_id`` are ordered by row key; rows equal in id and text are one document and get the same
result. An empty table gives an empty result. Other columns are not read. A long text is taken in
segments, so memory does not follow its length beyond the text itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, arrow_schema, batches, keyed, map_arrow, partitions, same_row, staged

SPAN, GRAM = 100, 32
WINDOW = SPAN - GRAM + 1
SEGMENT = 1 << 18
GROUP_CONTEXTS = 1 << 16
#: Run starts whose spans share a row for each range.
STARTS_A_BUCKET = 1 << 20
#: Contexts of which all strings are held at once.
HELD_CONTEXTS = 2_000
LOOSE_ROWS = 20_000
#: Records a reducing task should see.
ANCHORS_A_TASK, CONTEXTS_A_TASK = 1 << 17, 1 << 16
#: Beyond as many ranges, a task takes several in turn.
MOST_TASKS = 50_000
#: Bytes a map task collects before it sends a run.
RUN_BYTES = 4 << 20
_NULL = -(1 << 63)
_ANCHOR = np.dtype([("h", "<u8"), ("key", "<i8"), ("start", "<u4"), ("twice", "?")])
_TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64)
_ODD = np.random.default_rng(20240102).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` bytes, by doubling."""
    h, size, k = _TABLE[x], 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[k] + h[size:]
        size, k = 2 * size, k + 1
    h ^= h >> np.uint64(29)
    h *= _ODD[6]
    return h ^ (h >> np.uint64(32))


def _shares() -> np.ndarray:
    """At each of 4,097 even steps of the hash, the share of anchors below it, of 2^31.

    An anchor is the least of a window, so low hashes are far more frequent. A hash ``x`` of 1 is chosen when at least
    ``n = WINDOW - 1`` of its neighbours in a row are above it: with ``q = 1 - x`` by ``q^n (1 + n x)``, whose integral is
    below. Whole numbers only, so that all machines agree.
    """
    n, size = WINDOW - 1, 4096
    return np.array([(1 << 31) - ((size - i) ** (n + 1) * ((n + 2) * size - n * (size - i)) << 30) // size ** (n + 2)
                     for i in range(size + 1)], np.uint64)


_SHARES = _shares()


def ranges_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of each anchor's hash, in the order of hashes, when ``parts`` ranges hold equal shares of anchors."""
    at, rest = (h >> np.uint64(52)).astype(np.int64), (h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)
    below = _SHARES[at] + ((_SHARES[at + 1] - _SHARES[at]) * rest >> np.uint64(32))
    return np.minimum((below * np.uint64(parts) >> np.uint64(31)).astype(np.int64), parts - 1)


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in every window of ``width`` values, by doubling."""
    value, index, size = h, np.arange(len(h), dtype=np.int64), 1

    def merged(shift: int):
        later = value[shift:] < value[:-shift]
        return np.where(later, value[shift:], value[:-shift]), np.where(later, index[shift:], index[:-shift])

    while 2 * size <= width:
        value, index = merged(size)
        size *= 2
    return merged(width - size)[1] if size < width else index


def runs(raw: bytes):
    """Runs of starts of a text: hash of the anchor's gram, first start, last start, anchor; as arrays."""
    out = []
    for lo in range(0, max(0, len(raw) - SPAN + 1), SEGMENT):
        x = np.frombuffer(raw, np.uint8, min(len(raw) - lo, SEGMENT + SPAN - 1), lo)
        h = gram_hashes(x)
        least = leftmost_least(h, WINDOW)
        first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        anchor = least[first]
        out.append((h[anchor], first + lo, np.append(first[1:], len(least)) - 1 + lo, anchor + lo))
    if not out:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _pieces(rec: np.ndarray, part: np.ndarray, column: str):
    """Packed records by part, as a batch."""
    order = np.argsort(part, kind="stable")
    rec, part = rec[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return pa.RecordBatch.from_pydict({
        "part": pa.array(part[np.append(0, cuts)].astype(np.int32)),
        column: pa.array([zlib.compress(r.tobytes(), 1) for r in np.split(rec, cuts)], pa.binary())})


def _anchors(first: DataFrame, parts: int) -> DataFrame:
    """Anchor hashes by range, one record for each hash and task, marked if the task has it twice.

    Later places of a hash in the same task are known to be repeats; they are marked and dealt out by
    document, so a hash in a third of all documents does not fill its range.
    """

    def run(it):
        held, size = [], 0

        def send():
            rec = np.concatenate(held)
            rec = rec[np.argsort(rec["h"], kind="stable")]
            again = np.append(False, rec["h"][1:] == rec["h"][:-1])
            rec["twice"] = again
            rec["twice"][:-1] |= again[1:]
            part = ranges_of(rec["h"], parts)
            part[again] = rec["key"][again] % parts
            return _pieces(rec, part, "records")

        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, start, _, _ = runs(text.encode())
                if len(h):
                    rec = np.zeros(len(h), _ANCHOR)
                    rec["h"], rec["key"], rec["start"] = h, key, start
                    held.append(rec)
                    size += rec.nbytes
            if size >= RUN_BYTES:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return first.select(KEY, "text").mapInArrow(run, "part int, records binary")


def _unpack(blobs, kind=_ANCHOR) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(zlib.decompress(b), kind) for b in blobs]])


def _repeated(anchors: DataFrame) -> DataFrame:
    """Per document the starts of its runs whose gram occurs more than once.

    Ranges of hashes hold starts of all documents, so each start is a row of its own until the rows of a document
    meet: their number follows the repeats in the input, not the number of ranges.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rec = _unpack(rows["records"])
        rec = rec[np.argsort(rec["h"], kind="stable")]
        same = rec["h"][1:] == rec["h"][:-1]
        rec = rec[rec["twice"] | np.append(same, False) | np.append(False, same)]
        return pd.DataFrame({"anchor_key": rec["key"], "start": rec["start"].astype(np.int64)})

    met = anchors.groupBy("part").applyInPandas(meet, "anchor_key long, start long")
    return met.groupBy("anchor_key").agg(F.collect_list("start").alias("starts"))


def shared(a: bytes, b: bytes, known: int) -> int:
    """Bytes that two suffixes share, when ``known`` of them are known to be."""
    n = min(len(a), len(b))
    lo, step = known, 16
    while lo < n and a[lo:lo + step] == b[lo:lo + step]:
        lo += step
        step *= 2
    while step > 1:
        step //= 2
        if a[lo:lo + step] == b[lo:lo + step]:
            lo += step
    return min(lo, n)


def merged(sources: list):
    """Merge sorted ``(suffix, shared with the one before, record)`` streams by a loser tree.

    Yields ``(suffix, shared with the last one yielded, record)``. A node keeps the loser of its match with the
    bytes it shares with that winner. On the next way up the candidate also knows what it shares
    with the last winner: the one that shares more is the smaller, and only equal numbers need bytes.
    """
    heads = [next(s, None) for s in sources]
    size = 1
    while size < max(1, len(sources)):
        size *= 2
    heads += [None] * (size - len(sources))
    streams = [*sources, *[iter(())] * (size - len(sources))]
    common = [0] * size
    tree = [0] * size

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's ``common`` becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        k = shared(x[0], y[0], common[a])
        first = a if x[0][k:k + 1] <= y[0][k:k + 1] else b
        last = b if first == a else a
        common[last] = k
        return first, last

    level = list(range(size))
    at = size // 2
    while len(level) > 1:
        winners = []
        for k in range(0, len(level), 2):
            w, tree[at + k // 2] = match(level[k], level[k + 1])
            winners.append(w)
        level, at = winners, at // 2
    top = level[0]
    while heads[top] is not None:
        suffix, _, record = heads[top]
        yield suffix, common[top], record
        heads[top] = following = next(streams[top], None)
        common[top] = following[1] if following else 0
        at = (top + size) // 2
        while at:
            top, tree[at] = match(top, tree[at])
            at //= 2


_SPANS = np.dtype([("doc", "<i8"), ("key", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
_PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("left", "<u1"), ("count", "<u1")])


def front_coded(rows: list[tuple[bytes, tuple]]) -> bytes:
    """A sorted run: bytes shared with the one before, length of the rest, places, and all rests."""
    known, rest, before = [], [], b""
    for suffix, _ in rows:
        k = shared(suffix, before, 0)
        known.append(k)
        rest.append(suffix[k:])
        before = suffix
    head = np.array([len(rows)], "<u4").tobytes() + np.array(known, "<u2").tobytes() + np.array([len(r) for r in rest], "<u2").tobytes()
    return zlib.compress(head + np.array([p for _, p in rows], _PLACE).tobytes() + b"".join(rest), 1)


def decoded(blob: bytes):
    """The stream of a front-coded run."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    known = np.frombuffer(raw, "<u2", n, 4).tolist()
    sizes = np.frombuffer(raw, "<u2", n, 4 + 2 * n).tolist()
    places = (p.item() for p in np.frombuffer(raw, _PLACE, n, 4 + 4 * n))
    at, before = 4 + (4 + _PLACE.itemsize) * n, b""
    for k, m, place in zip(known, sizes, places, strict=True):
        before = before[:k] + raw[at:at + m]
        at += m
        yield before, k, place


def context(raw: bytes, h: int, first: int, last: int, anchor: int) -> bytes:
    """The sort key of an anchor: hash, suffix as far as the run's strings reach, then the bytes on its left."""
    return h.to_bytes(8, "big") + raw[anchor:last + SPAN] + raw[first:anchor]


def _sorted_runs(near: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs by range (``part``), and spans already known to repeat, dealt out by document."""
    schema = "part int, run binary, doc_id long, row_key long, spans binary"
    names = arrow_schema(schema)

    def run(it):
        held, size = {}, 0
        spans = defaultdict(list)

        def send():
            rows = sorted(held.items())
            by = defaultdict(list)
            h = np.frombuffer(b"".join(suffix[:8] for suffix, _ in rows), ">u8").astype(np.uint64)
            for p, row in zip(ranges_of(h, parts).tolist(), rows, strict=True):
                by[p].append(row)
            yield from ([p, front_coded(r), None, None, None] for p, r in by.items())
            yield from ([k % parts, None, None if d == _NULL else d, k, np.array(v, "<u4").tobytes()] for (d, k), v in spans.items())

        for batch in it:
            lists = batch.column(3)
            cuts, starts = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (doc, key, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True)):
                raw, doc = text.encode(), _NULL if doc is None else doc
                wanted = starts[cuts[k]:cuts[k + 1]]
                h, first, last, anchor = runs(raw)
                mine = np.isin(first, wanted)
                for hh, lo, hi, a in zip(*[v[mine].tolist() for v in (h, first, last, anchor)], strict=True):
                    suffix = context(raw, hh, lo, hi, a)
                    place = (doc, key, lo, a - lo, hi - lo)
                    # The left part's length belongs to the identity: it is one byte at the end of the key.
                    suffix += bytes([a - lo])
                    other = held.get(suffix)
                    if other is None:
                        held[suffix] = place
                        size += len(suffix) + 200
                        continue
                    earlier, later = sorted((other, place))
                    held[suffix] = earlier
                    if earlier != later:  # else a row that came twice
                        spans[later[:2]].append((later[2], later[2] + later[4] + SPAN))
            if size >= RUN_BYTES:
                yield _batch(send(), names)
                held, size = {}, 0
                spans = defaultdict(list)
        yield _batch(send(), names)

    return near.select("doc_id", KEY, "text", "starts").mapInArrow(run, schema)


def _batch(rows, names: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names.names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, names, strict=True)], schema=names)


def _stretch(suffix: bytes, place: tuple, most: int = SPAN + 8, low: int = 0, high: int = WINDOW - 1) -> tuple[int, bytes]:
    """The strings of a context that may occur again, as the first's start and the bytes of all; none: no bytes.

    ``most``: bytes it shares with a neighbour in the order; a string that reaches further to the right is in no other. Only
    strings with ``low`` to ``high`` bytes left of the gram.
    """
    left, count = place[3], place[4]
    first, last = max(0, left - high), min(count, left - max(low, SPAN + 8 - most))
    if first > last:
        return 0, b""
    right = len(suffix) - 9 - left
    whole = suffix[8 + right:8 + right + left] + suffix[8:8 + right]
    return place[2] + first, whole[first:last + SPAN]


def _strings(suffix: bytes, place: tuple, *bounds: int):
    """Start and bytes of each string of a context, or of those within the bounds."""
    start, text = _stretch(suffix, place, *bounds)
    return [(start + k, text[k:k + SPAN]) for k in range(len(text) - SPAN + 1)]


def _meet(sorted_runs: DataFrame, parts: int, limit: int, held: int = HELD_CONTEXTS, buckets: int = 1) -> DataFrame:
    """Spans that repeat, those known before included, and contexts of very common grams: ``doc_id, row_key, bucket, spans, start, strings``.

    A document's spans lie in many ranges. A range sends those of a bucket of documents in one row, so what leaves it follows its spans'
    bytes, not how many documents have one there.
    """
    schema = "doc_id long, row_key long, bucket int, spans binary, start long, strings binary"

    names = arrow_schema(schema)

    def loose(group):
        for place, suffix, most in group:
            start, text = _stretch(suffix, place, most)
            if text:
                yield [None if place[0] == _NULL else place[0], place[1], None, None, start, text]

    def close(group, spans):
        group.sort()
        last = [None] * len(group)
        width = max(1, WINDOW * held // len(group))
        for high in range(WINDOW - 1, -1, -width):  # equal strings have equal left lengths
            seen = set()
            for i, (place, suffix, most) in enumerate(group):
                for s, x in _strings(suffix, place, most, max(0, high - width + 1), high):
                    if x not in seen:
                        seen.add(x)
                        continue
                    own = spans[place[:2]]
                    open_ = last[i] or (own[-1] if own else None)
                    if open_ and open_[0] <= s <= open_[1] - SPAN + 1:
                        open_[1] = max(open_[1], s + SPAN)
                    else:
                        own.append(open_ := [s, s + SPAN])
                    last[i] = open_

    def part(blobs, spans):
        """The output of one range: contexts of a very common gram as they come, spans at the end."""
        group, wide = [], False
        for suffix, common, place in merged([decoded(b) for b in blobs]):
            if common < 8 + GRAM:
                if wide:
                    yield from loose(group)
                elif len(group) > 1:
                    close(group, spans)
                group, wide = [], False
            elif group and common >= len(suffix) and len(group[-1][1]) == len(suffix):
                earlier, later = sorted((group[-1][0], place))
                group[-1] = (earlier, suffix, group[-1][2])
                if earlier != later:
                    spans[later[:2]].append([later[2], later[2] + later[4] + SPAN])
                continue
            elif len(group) >= limit:
                # The last stays, as equal ones may follow it.
                yield from loose(group[:-1])
                group, wide = group[-1:], True
            if group:
                group[-1] = (*group[-1][:2], max(group[-1][2], common))
            group.append((place, suffix, common))
        if wide:
            yield from loose(group)
        elif len(group) > 1:
            close(group, spans)
        if sum(map(len, spans.values())):
            rec = np.array([(d, k, lo, hi) for (d, k), v in spans.items() for lo, hi in v], _SPANS)
            rec = rec[np.argsort(rec["key"] % buckets, kind="stable")]
            for some in np.split(rec, np.flatnonzero(np.diff(rec["key"] % buckets)) + 1):
                yield [None, None, int(some["key"][0] % buckets), zlib.compress(some.tobytes(), 1), None, None]

    def run(it):
        def ranges():
            now, blobs, spans = None, [], defaultdict(list)
            for batch in it:
                for number, blob, doc, key, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if number != now:
                        yield blobs, spans
                        blobs, spans = [], defaultdict(list)
                    now = number
                    if blob is None:
                        spans[_NULL if doc is None else doc, key] += np.frombuffer(known, "<u4").reshape(-1, 2).tolist()
                    else:
                        blobs.append(blob)
            yield blobs, spans

        for blobs, spans in ranges():
            rows = part(blobs, spans)
            while some := list(islice(rows, LOOSE_ROWS)):
                yield _batch(some, names)

    # One range a task: hashing their few numbers onto tasks would give some tasks several and others none.
    tasks = min(parts, MOST_TASKS)
    return (sorted_runs.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")
            .mapInArrow(run, schema))


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """The spans of a bucket of documents, a row for each."""
    rec = _unpack(rows["spans"], _SPANS)
    rec = rec[np.lexsort((rec["lo"], rec["key"], rec["doc"]))]
    cuts = np.flatnonzero((np.diff(rec["doc"]) != 0) | (np.diff(rec["key"]) != 0)) + 1
    docs = np.split(rec, cuts)
    return pd.DataFrame({"doc_id": pd.array([None if r["doc"][0] == _NULL else int(r["doc"][0]) for r in docs], "Int64"),
                         KEY: [int(r["key"][0]) for r in docs], "spans": [r[["lo", "hi"]].copy().astype([("lo", "<u4"), ("hi", "<u4")]).tobytes() for r in docs]})


def repeats(rows: DataFrame, settled: DataFrame, limit: int = GROUP_CONTEXTS) -> DataFrame:
    """Per document the spans of bytes to remove, as packed pairs: ``doc_id, row_key, spans``.

    ``rows`` come from ``keyed``; documents whose key is in ``settled`` are not looked into.
    """
    spark = rows.sparkSession
    batches(spark)
    size = F.octet_length("text")
    n = rows.agg(F.sum(size)).first()[0] or 0
    anchors = _anchors(rows, max(1, int(n) // (WINDOW // 2) // ANCHORS_A_TASK))
    starts = staged(_repeated(anchors).join(settled, F.col("anchor_key") == F.col(KEY), "left_anti"), "starts")
    found = starts.agg(F.sum(F.size("starts"))).first()[0] or 0
    near = rows.join(starts.hint("merge"), F.col(KEY) == F.col("anchor_key"))
    parts = max(partitions(spark), int(found) // CONTEXTS_A_TASK)
    buckets = max(partitions(spark), int(found) // STARTS_A_BUCKET)
    met = staged(_meet(_sorted_runs(near, parts), parts, limit, buckets=buckets), "met")
    loose = met.filter("strings is not null").select("doc_id", KEY, "start", "strings", F.expr(
        f"explode(sequence(0, octet_length(strings) - {SPAN})) AS k")).selectExpr("doc_id", KEY, "start + k AS start", f"substring(strings, k + 1, {SPAN}) AS string")
    place = F.struct("doc_id", KEY, "start")
    least = loose.groupBy("string").agg(F.min(place).alias("least"))
    later = loose.join(least, "string").filter(~place.eqNullSafe(F.col("least"))).groupBy("doc_id", KEY).agg(
        F.collect_list("start").alias("starts"))

    def packed(batch):
        return {"doc_id": batch.column("doc_id"), KEY: batch.column(KEY), "spans": [
            np.array([(s, s + SPAN) for s in v], "<u4").tobytes() for v in batch.column("starts").to_pylist()]}

    more = map_arrow(later, packed, f"doc_id long, {KEY} long, spans binary")
    spans = met.filter("spans is not null").select("bucket", "spans").groupBy("bucket").applyInPandas(
        _by_document, f"doc_id long, {KEY} long, spans binary").unionByName(more)
    return spans.groupBy("doc_id", KEY).agg(F.collect_list("spans").alias("spans"))


def uncovered(n: int, spans: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Mask of the bytes that stay, removed bytes, removed runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    gone = np.cumsum(edge[:n]) > 0
    return ~gone, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0


def deduplicated(docs: DataFrame, with_bytes: bool = False, limit: int = GROUP_CONTEXTS) -> DataFrame:
    """Every document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and if wanted the bytes kept.

    ``limit``: contexts of one gram beyond which its strings are compared in an aggregation, not in their range.
    """
    rows = keyed(docs)
    digests = staged(rows.select("doc_id", KEY, F.octet_length("text").alias("n"), F.md5("text").alias("digest")), "digests")
    least = digests.filter(F.col("n") >= SPAN).groupBy("digest").agg(F.min(F.struct("doc_id", KEY)).alias("one"))
    known = staged(digests.join(least, "digest", "left").select("doc_id", KEY, (F.col("one").isNotNull() & ~(
        F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & F.col(KEY).eqNullSafe(F.col(f"one.{KEY}")))).alias("copy")), "copies")
    # Only small tables say which documents are copies; the texts move for the spans and for the result.
    settled = known.groupBy(KEY).agg(F.min("copy").alias("all")).filter("all").select(KEY)
    later = known.filter("copy").select("doc_id", KEY).distinct()
    marks = repeats(rows, settled, limit).withColumn("copy", F.lit(False)).unionByName(
        later.withColumn("spans", F.lit(None).cast("array<binary>")).withColumn("copy", F.lit(True)))
    both = rows.alias("t").join(staged(marks, "spans").alias("m").hint("merge"), same_row("t", "m"), "left").select(
        "t.doc_id", "t.text", "m.spans", "m.copy")

    def run(batch):
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc, text, spans, copy in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "copy")], strict=True):
            raw = text.encode()
            kept, removed, pieces = raw, 0, 0
            if copy:
                kept, removed, pieces = b"", len(raw), 1
            elif spans:
                stay, removed, pieces = uncovered(len(raw), np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64))
                kept = np.frombuffer(raw, np.uint8)[stay].tobytes()
            for k, v in zip(out, (doc, len(raw), removed, pieces, sha256(kept).hexdigest(), kept if with_bytes else None), strict=True):
                out[k].append(v)
        return out

    done = map_arrow(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_bytes else done.drop("kept")
