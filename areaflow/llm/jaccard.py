"""N-gram Jaccard self-join: which documents share at least 80 % of their five-word shingles.

Copies first collapse to classes by the digest of their shingle set. Each class then lists its rarest
shingles: two sets that reach the threshold share at least one shingle among the first
``n - ceil(0.8 n) + 1`` of either in any fixed order, and rare ones first keep these lists apart. Rarity is
counted over all documents into a table of fixed size (``2**22`` counters, 8 MB), which is what the
order is made of; equal counters are ordered by hash, so the order is total and the same everywhere.

Classes that list the same shingle meet by its hash, and the length and positional filters are tried on
their pairs (a pair is kept at its first common shingle, where the positional bound holds). Where they
leave few pairs, as among classes that meet by chance, these go on one by one, each once whatever the
shingles it shares. Else the list goes on: members sorted by size fall apart where no pair reaches over,
and member lists that come up for many shingles are kept once. What is left faces the suffix filter: sets are
counted by parts of the hash range, and half the difference of these counts bounds the overlap from above. The
number of parts follows the size of the set: 64 parts would let any two sets of some thousand shingles pass, and
in a large corpus, where long sets often meet by chance, link them all to one group. What passes joins groups of
possible partners, in which every pair is compared exactly and at most once - not at all if its members
are linked already, as only groups are asked for. Only texts of these groups are sorted to their places.

Long lists and large groups are cut into blocks, and pairs of blocks are dealt out, so that no task holds
more than two blocks. Links leave a block pair as a spanning forest, never as all pairs.

Shingles are compared by 64-bit hashes.

Defined cases: a document with fewer words than a shingle has its whole word sequence as one shingle; one
without words, or without text, has none, and is linked with nothing. Rows equal in id and text are one
document of their class, and get equal rows. A null ``doc_id`` takes part; it is never the least id unless
alone. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
import zlib
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, arrow_schema, back_to, batches, keeps, keyed, map_arrow, partitions, same_row, staged
from areaflow.llm.components import components

WIDTH = 5
#: The threshold as a fraction of whole numbers.
NUM, DEN = 80, 100
COUNTER_BITS = 22
SEGMENTS = 64
#: Parts of a set: this many at least, and at most in a member list.
PARTS, LISTED_PARTS = 64, 256
#: Lists up to this size are tried pair by pair.
SHORT_LIST = 32
#: The wanted rows are marked in a table of fixed size, by their key.
MARK_BITS = 26
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 20
_REMEMBERED = 400_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POSTING = np.dtype([("h", "<u8"), ("c", "<i8"), ("n", "<u4"), ("p", "<u4")])


class _Words(dict):
    """64-bit hashes of words, remembered by a worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _Words()
keeps(_WORDS.clear)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    x = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        x = (x ^ (x >> np.uint64(31))) * _M1 + h[k:len(h) - n + 1 + k]
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(n)) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return np.unique(x ^ (x >> np.uint64(31)))


def digest(x: np.ndarray) -> bytes:
    return blake2b(x.tobytes(), digest_size=16).digest()


def short_id(whole: bytes) -> int:
    return int.from_bytes(whole[:8], "little", signed=True)


def needed(a, b):
    """Least overlap of sets of sizes a and b at the threshold."""
    return -(-NUM * (a + b) // (NUM + DEN))


def widths(n: np.ndarray) -> np.ndarray:
    """The number of parts of sets of size n, a power of two: eight shingles a part at most."""
    return np.maximum(PARTS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 8)).clip(0).astype(np.int64))


def counted(x: np.ndarray) -> np.ndarray:
    """A set counted by the parts of the hash range; counts end at 255, which can only narrow a difference."""
    k = int(widths(np.array(len(x))))
    return np.minimum(np.bincount((x & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8)


def folded(parts: np.ndarray, k: int) -> np.ndarray:
    """Counts of finer parts, or of k parts followed by zeros, as counts of k parts."""
    return parts if parts.shape[-1] == k else parts.reshape(*parts.shape[:-1], -1, k).sum(-2)


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """Row kinds in one pass: documents with their class, and the task's shingle counters by segment."""
    schema = (f"doc_id long, {KEY} long, class binary, c long, n int, parts binary, coarse binary, segment int, counts binary")
    names = arrow_schema(schema)
    empty = [None] * len(names.names)

    def run(it):
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in it:
            rows = []
            for doc, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", KEY, "text")], strict=True):
                x = shingles(text, width)
                if not len(x):
                    rows.append((doc, key, None, None, 0, None, None, None, None))
                    continue
                np.add.at(counters, x >> np.uint64(64 - COUNTER_BITS), 1)
                parts = counted(x)
                coarse = None
                if len(parts) > LISTED_PARTS:
                    coarse = np.minimum(folded(parts.astype(np.int64), LISTED_PARTS), 255).astype(np.uint8).tobytes()
                whole = digest(x)
                rows.append((doc, key, whole, short_id(whole), len(x), parts.tobytes(), coarse, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(names)], schema=names)
        for s, part in enumerate(counters.reshape(SEGMENTS, -1)):
            if part.any():
                row = empty[:7] + [s, zlib.compress(part.tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, names, strict=True)], schema=names)

    batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, schema)


def _counters(spark: SparkSession, rows: DataFrame):
    """The table of rarity, summed by segment, as a broadcast of fixed size: 16 bits a counter, saturating."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << COUNTER_BITS) // SEGMENTS, np.uint64)
        for blob in part["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        return pd.DataFrame({"segment": [key[0]], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})

    # Counters of fixed size: the number of segments does not depend on the documents.
    sums = rows.filter("segment is not null").select("segment", "counts").groupBy("segment").applyInPandas(
        add, "segment int, counts binary").collect()
    table = np.zeros((SEGMENTS, (1 << COUNTER_BITS) // SEGMENTS), np.uint16)
    for r in sums:
        table[r["segment"]] = np.frombuffer(r["counts"], "<u2")
    return spark.sparkContext.broadcast(table.ravel())


def ordered(x: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """A set in the fixed order: rare first."""
    return x[np.lexsort((x, counters[x >> np.uint64(64 - COUNTER_BITS)]))]


def _postings(docs: DataFrame, width: int, counters, buckets: int) -> DataFrame:
    """The prefix of each class as packed records, dealt out by shingle; a task sends a class once."""
    schema = "bucket int, records binary"
    names = arrow_schema(schema)

    def run(it):
        held, size, seen = [], 0, set()

        def send():
            rec = np.concatenate(held)
            b = (rec["h"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            rec, b = rec[order], b[order]
            cuts = np.flatnonzero(np.diff(b)) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(b[np.append(0, cuts)], pa.int32()),
                 pa.array([zlib.compress(r.tobytes(), 1) for r in np.split(rec, cuts)], pa.binary())], schema=names)

        for batch in it:
            for text in batch.column("text").to_pylist():
                x = shingles(text, width)
                n = len(x)
                c = short_id(digest(x)) if n else None
                if not n or c in seen:
                    continue
                seen.add(c)
                k = n - -(-NUM * n // DEN) + 1
                rec = np.empty(k, _POSTING)
                rec["h"], rec["c"], rec["n"], rec["p"] = ordered(x, counters.value)[:k], c, n, np.arange(k)
                held.append(rec)
                size += k
                if size >= 1 << 20:
                    yield send()
                    held, size, seen = [], 0, set()
        if held:
            yield send()

    batches(docs.sparkSession)
    return keyed(docs).select("text").mapInArrow(run, schema)


def chains(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Numbers the parts into which records of one shingle, sorted by size, fall by length and position.

    A record of size n at position p reaches partners of size up to ``(n - p) (1 + DEN / NUM) - n`` and no more
    than ``n DEN / NUM``; where no earlier record reaches the next size, no pair reaches over.
    """
    n, p = n.astype(np.int64), p.astype(np.int64)
    reach = np.minimum(n * DEN // NUM, ((n - p) * (NUM + DEN)) // NUM - n)
    return np.cumsum(np.append(0, np.maximum.accumulate(reach)[:-1] < n[1:]))


def tried(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the length and positional filters let sets of size n meet sets of size m, n at most m, at positions p and q."""
    return (NUM * m <= DEN * n) & (np.minimum(n - p, m - q) >= needed(n, m))


def _lists(postings: DataFrame) -> DataFrame:
    """What shingles listed by two classes or more tell: pairs ``(g, c)`` with ``size`` 0, and members ``c`` of lists ``g``.

    Equal lists have one id, and pairs and lists come once.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rec = np.concatenate([np.frombuffer(zlib.decompress(b), _POSTING) for b in rows["records"]])
        rec = rec[np.lexsort((rec["c"], rec["n"], rec["h"]))]
        same = (rec["h"][1:] == rec["h"][:-1])
        rec = rec[np.append(True, ~(same & (rec["c"][1:] == rec["c"][:-1])))]
        same = rec["h"][1:] == rec["h"][:-1]
        rec = rec[np.append(same, False) | np.append(False, same)]
        out: dict[int, np.ndarray] = {}
        pairs = np.empty((0, 2), np.int64)
        if len(rec):
            starts = np.append(0, np.flatnonzero(rec["h"][1:] != rec["h"][:-1]) + 1)
            sizes = np.diff(np.append(starts, len(rec)))
            number, ends = np.repeat(np.arange(len(starts)), sizes), np.repeat(starts + sizes, sizes)
            n, p = rec["n"].astype(np.int64), rec["p"].astype(np.int64)

            def sweep(of: np.ndarray):
                """Pairs that pass, by their distance in the list."""
                at = np.flatnonzero(of[number])
                for step in range(1, SHORT_LIST):
                    at = at[at + step < ends[at]]
                    if not len(at):
                        break
                    ok = at[tried(n[at], p[at], n[at + step], p[at + step])]
                    yield ok, ok + step

            short = sizes <= SHORT_LIST
            found, partnered = np.zeros(len(sizes), np.int64), ~short[number]
            for a, b in sweep(short):
                found += np.bincount(number[a], minlength=len(sizes))
                partnered[a] = partnered[b] = True
            few = short & (found <= 2 * sizes)
            c = rec["c"]
            each = [np.sort(np.stack([c[a], c[b]], 1), 1) for a, b in sweep(few & (found > 0))]
            if each:
                pairs = np.unique(np.concatenate(each), axis=0)
            rec = rec[partnered & ~few[number]]
        if len(rec):
            starts = np.append(0, np.flatnonzero(rec["h"][1:] != rec["h"][:-1]) + 1)
            for lo, hi in zip(starts, np.append(starts[1:], len(rec)), strict=True):
                part = rec[lo:hi]
                number = chains(part["n"], part["p"])
                for k in range(number[-1] + 1):
                    c = np.sort(part["c"][number == k])
                    if len(c) > 1:
                        out[int.from_bytes(blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True)] = c
        sizes = [len(c) for c in out.values()]
        return pd.DataFrame({"g": np.concatenate([pairs[:, 0], np.repeat(np.array(list(out), np.int64), sizes)]),
                             "c": np.concatenate([pairs[:, 1], *out.values()]),
                             "size": np.concatenate([np.zeros(len(pairs), np.int32), np.repeat(sizes, sizes).astype(np.int32)])})

    return postings.groupBy("bucket").applyInPandas(run, "g long, c long, size int").distinct()


def block_pairs(members: DataFrame, group: str, blocks) -> DataFrame:
    """Deal each member to the pairs ``(i, j)`` of blocks that hold its block; one block gives one pair."""
    n = F.greatest(blocks.cast("int"), F.lit(1))
    rows = members.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64(group, "c"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    return rows.withColumn("other", F.explode(other)).withColumn("i", F.least("block", "other")).withColumn(
        "j", F.greatest("block", "other")).drop("other", "blocks")


class Forest:
    """Union-find over the members of one block pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(c: np.ndarray, n: np.ndarray, parts: np.ndarray, block: np.ndarray, cross: bool, same) -> list[tuple[int, int]]:
    """A spanning forest of the links ``same(a, b)`` among members whose lengths and parts allow one.

    Members come by size, so the partners of one lie in a run; those already in its group are skipped, nearest
    sizes first. In a cross pair of blocks only members of different blocks are compared. ``parts`` has a row for
    each member, which ends in zeros where others have more parts.
    """
    order = np.lexsort((c, n))
    c, n, parts, block = c[order], n[order].astype(np.int64), parts[order].astype(np.int16), block[order]
    forest, out = Forest(len(c)), []
    group = np.arange(len(c))
    lows = np.searchsorted(n, -(-NUM * n // DEN), "left")
    wide = np.minimum(widths(n), parts.shape[1])
    for b in range(1, len(c)):
        a = np.arange(lows[b], b)
        if cross:
            a = a[block[a] != block[b]]
        a = a[group[a] != group[b]]
        if not len(a):
            continue
        k = int(wide[lows[b]])
        apart = np.abs(folded(parts[a], k) - folded(parts[b], k)).sum(1)
        a = a[(n[a] + n[b] - apart) // 2 >= needed(n[a], n[b])]
        for k in a[::-1].tolist():
            if forest.find(k) != forest.find(b) and same(int(order[k]), int(order[b])):
                x, y = group[k], group[b]
                forest.join(k, b)
                group[group == max(x, y)] = min(x, y)
                out.append((int(c[k]), int(c[b])))
    return out


def _by_pair(members: DataFrame, group: str, compare) -> DataFrame:
    """Stream the members of each block pair, one pair at a time, through ``compare``; links come out.

    A member that comes several times to a pair counts once.
    """
    names = arrow_schema("a long, b long")
    columns = members.columns

    def run(it):
        key, rows = None, []

        def links():
            found = compare(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                               pa.array([x[1] for x in found], pa.int64())], schema=names)

        for batch in it:
            for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                row = dict(zip(columns, row, strict=True))
                now = (row[group], row["i"], row["j"])
                if now != key:
                    if len(rows) > 1:
                        yield links()
                    key, rows = now, []
                if not rows or rows[-1]["c"] != row["c"]:
                    rows.append(row)
        if len(rows) > 1:
            yield links()

    spark = members.sparkSession
    batches(spark)
    return (members.repartition(partitions(spark), group, "i", "j").sortWithinPartitions(group, "i", "j", "c")
            .mapInArrow(run, "a long, b long"))


def _promising(rows: list[dict]) -> list[tuple[int, int]]:
    most = max(len(r["parts"]) for r in rows)
    parts = np.frombuffer(b"".join(r["parts"].ljust(most, b"\0") for r in rows), np.uint8).reshape(-1, most)
    c, n, block = (np.array([r[k] for r in rows], np.int64) for k in ("c", "n", "block"))
    return linked(c, n, parts, block, rows[0]["i"] != rows[0]["j"], lambda a, b: True)


def _verified(rows: list[dict]) -> list[tuple[int, int]]:
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    parts = np.array([np.bincount((x & np.uint64(63)).astype(np.int64), minlength=64) for x in sets])
    c, block = (np.array([r[k] for r in rows], np.int64) for k in ("c", "block"))

    def same(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        at = np.searchsorted(y, x)
        shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return DEN * shared >= NUM * (len(x) + len(y) - shared)

    return linked(c, np.array([len(x) for x in sets]), np.minimum(parts, 32767), block, rows[0]["i"] != rows[0]["j"], same)


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose parts allow a link."""
    one = classes.select("c", "n", "parts")
    rows = pairs.join(one.toDF("a", "n", "parts"), "a").join(one.toDF("b", "m", "others"), "b")

    def run(batch):
        a, b, n, m = (batch.column(k).to_numpy().astype(np.int64) for k in ("a", "b", "n", "m"))
        parts, others = batch.column("parts").to_pylist(), batch.column("others").to_pylist()
        shapes = np.array([(len(x), len(y)) for x, y in zip(parts, others, strict=True)]).reshape(-1, 2)
        ok = np.zeros(len(a), bool)
        for shape in np.unique(shapes, axis=0):
            at = np.flatnonzero((shapes == shape).all(1))
            x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), k).astype(np.int32)
                    for side, k in zip((parts, others), shape, strict=True))
            apart = np.abs(folded(x, shape.min()) - folded(y, shape.min())).sum(1)
            ok[at] = (n[at] + m[at] - apart) // 2 >= needed(n[at], m[at])
        return {"a": a[ok], "b": b[ok]}

    return map_arrow(rows, run, "a long, b long")


def _near(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of possible partners among listed pairs and members of lists."""
    members = lists.filter("size > 0").join(
        classes.select("c", "n", F.coalesce("coarse", "parts").alias("parts")), "c")
    links = _by_pair(block_pairs(members, "g", F.ceil(F.col("size") / BLOCK_MEMBERS)).select(
        "g", "i", "j", "block", "c", "n", "parts"), "g", _promising)
    pairs = lists.filter("size = 0").select(F.col("g").alias("a"), F.col("c").alias("b"))
    return links.unionByName(_allowed(pairs, classes))


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keyed rows of ``docs`` that may be in ``wanted``: all that are, and few others.

    Keys are marked in a table of 2**26 bits (8 MB) whatever their number, which is broadcast; where it fills up, more
    rows pass, and the join that follows still decides.
    """
    spark = docs.sparkSession
    place = F.pmod(F.col(KEY), F.lit(1 << MARK_BITS))
    found = wanted.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(32767).alias("bit")).groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros((1 << MARK_BITS - 15, 4096), np.uint8)
    for r in found:
        table[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return _passed(keyed(docs), spark.sparkContext.broadcast(table.ravel()))


def _passed(rows: DataFrame, bits: Broadcast) -> DataFrame:
    """The keyed rows whose key is marked."""

    def run(it):
        for batch in it:
            at = batch.column(KEY).to_numpy() & ((1 << MARK_BITS) - 1)
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    batches(rows.sparkSession)
    return rows.mapInArrow(run, f"doc_id long, {KEY} long, text string")


def _released(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage: until then shuffle files stay on disk, also of tables that are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def joined(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every document with its set size, class and ``component_id``."""
    spark = docs.sparkSession
    rows = staged(_classes(docs, width), "classes")
    counters = _counters(spark, rows)
    members = rows.filter("segment is null")
    classes = staged(members.filter("c is not null").groupBy("c").agg(
        F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("coarse").alias("coarse"),
        F.min(F.struct("doc_id", KEY)).alias("one")), "sets")
    total = classes.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    buckets = max(1, int(total) // (1 << 19))
    _released(spark)
    lists = staged(_lists(_postings(docs, width, counters, buckets)), "lists")
    _released(spark)
    near = components(staged(_near(lists, classes), "near"))
    grouped = staged(near.withColumnRenamed("node", "c").join(classes.select("c", "n", "one"), "c"), "groups")
    blocks = grouped.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("k"))
    wanted = staged(block_pairs(grouped.join(blocks, "root"), "root", F.col("k")).groupBy("c", "one", "root", "block").agg(
        F.collect_list(F.struct("i", "j")).alias("pairs")).select(
        F.col("one.doc_id").alias("doc_id"), F.col(f"one.{KEY}").alias(KEY), "c", "root", "block", "pairs"), "wanted")
    texts = _marked(docs, wanted).alias("t").join(wanted.alias("w").hint("merge"), same_row("t", "w")).select(
        "t.text", "w.c", "w.root", "w.block", "w.pairs")

    def sets(batch):
        out = {k: [] for k in ("root", "i", "j", "block", "c", "shingles")}
        seen = set()
        for r in batch.to_pylist():
            if r["c"] in seen:
                continue
            seen.add(r["c"])
            x = shingles(r["text"], width).tobytes()
            for pair in r["pairs"]:
                for k, v in zip(out, (r["root"], pair["i"], pair["j"], r["block"], r["c"], x), strict=True):
                    out[k].append(v)
        return out

    compared = map_arrow(texts, sets, "root long, i int, j int, block int, c long, shingles binary")
    _released(spark)
    links = components(staged(_by_pair(compared, "root", _verified), "links"))
    _released(spark)
    top = staged(classes.select("c").join(links, F.col("c") == F.col("node"), "left").select(
        "c", F.coalesce("root", "c").alias("root")), "roots")
    placed = members.select("doc_id", KEY, F.col("n").cast("long").alias("n_shingles"), "c").join(top, "c", "left")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", KEY, "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.col("root").alias("group"))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, one of each group of near copies: the one with the least id, then row key."""
    found = staged(joined(docs, width), "joined")
    _released(docs.sparkSession)
    first = found.filter("`group` is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", KEY)).alias("keep"))
    out = found.join(first, "group").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col(KEY) == F.col(f"keep.{KEY}"))))
    return back_to(docs, out.select("doc_id", KEY).distinct(), "left_anti").select("d.*")
