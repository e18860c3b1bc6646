"""Groups of words that are one edit apart, by banded edit matrices over sorted lists of words.

Words are counted per task before they are shuffled. Two words of at least ``m`` characters that are one edit apart share, before or
behind the edit, at least half of the ``m``: so each word goes under its first half and, turned round, under its
last half, and near words meet in a list with a common half. In a sorted list a word is compared with those behind
it: the rows of the banded edit matrix are kept for as far as neighbours in the list share a prefix, and where a
row exceeds one edit everything that shares the prefix so far is skipped.

A list that is longer than ``LIST`` (many words with one half in common) is split by the same rule: the rest of its words again
shares its first or its last half. Splitting ends when the rest is one character or two, of which the alphabet allows few. So no
list grows with the input, whatever the words. A pair that shares both halves counts only under the first.

Defined results: null and empty texts have no words, a null id counts as the empty string in the hash. Every row counts, repeated
ones too. Ties between near words go to the smaller word. Only ``doc_id`` and ``text`` are read. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import batches, staged

#: Words in a list that is scanned by one task; longer ones are split.
LIST = 128
#: Different words a task counts before it hands them on.
COUNTED = 400_000
#: Texts longer than this are cut into words one by one.
LONG_TEXT = 1 << 22
#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"


def runs(text: str, least: int) -> Counter[bytes]:
    """Runs of at least ``least`` letters with A to Z folded, as UTF-8, and how often each occurs."""
    low = text.encode().lower()  # of bytes, only A to Z are changed
    ascii_only = len(low) == len(text)
    pattern = re.compile(b"[a-z]{%d,}" % least) if ascii_only else re.compile(f"[{LETTERS}]{{{least},}}")
    plain = low if ascii_only else low.decode()
    found = Counter(pattern.findall(plain) if len(plain) <= LONG_TEXT else (m.group() for m in pattern.finditer(plain)))
    return found if ascii_only else Counter({w.encode(): n for w, n in found.items()})


def vocabulary(docs: DataFrame, least: int = 5, seen: int = 3, one_in: int = 97) -> DataFrame:
    """``word`` and ``n`` of every word of at least ``least`` characters and ``seen`` occurrences.

    One word in ``one_in`` of a document, by a hash of id and word, is taken without one of its characters.
    """
    batches(docs.sparkSession)

    def counted(batch: pa.RecordBatch, total: dict[bytes, int]) -> None:
        crc, before = zlib.crc32, total.get
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            text = text.as_py()
            if not text:
                continue
            prefix = crc(f"{'' if doc is None else doc}:".encode())
            for word, n in runs(text, least).items():
                h = crc(word, prefix)
                if h % one_in == 0:
                    letters = word.decode()
                    k = h % len(letters)
                    if len(letters) == least:
                        continue
                    word = (letters[:k] + letters[k + 1:]).encode()
                total[word] = before(word, 0) + n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in it:
            counted(batch, total)
            if len(total) >= COUNTED:
                yield _counts(total)
                total.clear()
        yield _counts(total)

    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def _counts(total: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()).cast(pa.string()), pa.array(total.values(), pa.int64())],
                                      ["word", "n"])


# --- lists ---------------------------------------------------------------------------

def _split(lists: DataFrame) -> DataFrame:
    """Every word of a list under the first and under the last half of its rest.

    ``list`` names what its words have in common, ``rest`` is what is left of a word, ``r`` the length of the
    shorter of two near rests. Two rests of a list may share less than ``below`` first characters, else another list has them.
    """
    half = F.floor(F.col("r") / 2).cast("int")
    kept = (F.length("rest") - half).cast("int")
    left = (F.col("r") - half).cast("int").alias("r")
    first = F.struct(F.concat("list", F.lit("<"), F.col("rest").substr(F.lit(1), half)).alias("list"),
                     F.col("rest").substr(half + 1, kept).alias("rest"), left,
                     (F.col("below") - half).cast("int").alias("below"))
    last = F.struct(F.concat("list", F.lit(">"), F.col("rest").substr(kept + 1, half)).alias("list"),
                    F.col("rest").substr(F.lit(1), kept).alias("rest"), left, F.least("below", half).cast("int").alias("below"))
    return lists.select("word", "n", F.explode(F.array(first, last)).alias("l")).select("word", "n", "l.*").filter("below > 0")


def _lists(words: DataFrame, least: int, limit: int) -> DataFrame:
    """Lists in which all near words meet, none longer than ``limit`` unless its rests are at most two characters."""
    length = F.length("word")
    shorter = F.filter(F.array(length - 1, length), lambda m: m >= least)
    now = _split(words.select("word", "n", F.explode(shorter).alias("r")).select(
        "word", "n", F.col("r").cast("string").alias("list"), F.col("word").alias("rest"), "r", F.lit(1 << 30).alias("below")))
    done = None
    while True:
        now = staged(now, "lists")
        sizes = now.groupBy("list").agg(F.count("*").alias("size"))
        hot = staged(sizes.filter(F.col("size") > limit).select("list"), "long-lists")
        splits = now.join(hot, "list", "left_semi").filter("r > 1")
        if hot.isEmpty() or splits.isEmpty():
            return now if done is None else done.unionByName(now)
        cold = now.join(hot, "list", "left_anti").unionByName(now.join(hot, "list", "left_semi").filter("r <= 1"))
        done = cold if done is None else done.unionByName(cold)
        now = _split(splits)


def shared_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def near_in(rests: list[str], shorter: int, below: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list whose strings are one edit apart and share less than ``below`` first characters.

    Strings have ``shorter`` characters or one more, and at least one of a pair has ``shorter``: two longer ones meet elsewhere.

    A row of the banded matrix stands for a prefix, of length ``d``, of the string that is compared: it holds the
    edits from it to the word's prefixes of lengths ``d - 1``, ``d`` and ``d + 1``. Rows hold for all strings with that prefix.
    """
    shared = [0, *(shared_prefix(a, b) for a, b in pairwise(rests))]
    many, longest = len(rests), max(map(len, rests), default=0)
    for i, word in enumerate(rests):
        size = valid = common = len(word)
        padded = "\0" + word + "\0\0"
        rows = [(9, 0, 1), *[(1, 0, 1)] * (longest + 1)]  # of the word against itself
        j = i + 1
        while j < many:
            if shared[j] < valid:
                valid = shared[j]  # rows up to here hold for the string at j too
            if shared[j] < common:
                common = shared[j]
            other = rests[j]
            a, b, c = rows[valid]
            for depth in range(valid + 1, len(other) + 1):
                x = other[depth - 1]
                if padded[depth - 1] != x:
                    a += 1
                if a > b:
                    a = b + 1
                if padded[depth] != x:
                    b += 1
                if b > c:
                    b = c + 1
                if b > a:
                    b = a + 1
                if padded[depth + 1] != x:
                    c += 1
                if c > b:
                    c = b + 1
                rows[depth] = a, b, c
                if a > 1 and b > 1 and c > 1:
                    valid = depth
                    j = _beyond(rests, shared, j, depth)
                    break
            else:
                valid = len(other)
                if common < below and (size == shorter or valid == shorter) and rows[valid][size - valid + 1] == 1:
                    yield i, j
                j += 1


def _beyond(rests: list[str], shared: list[int], j: int, depth: int) -> int:
    """The first place behind ``j`` whose string does not share the first ``depth`` characters of the one there."""
    for k in range(j + 1, min(j + 9, len(rests))):
        if shared[k] < depth:
            return k
    return bisect_left(rests, rests[j][:depth] + "\U0010ffff", j + 1)


def near(words: DataFrame, least: int = 5, limit: int = LIST) -> DataFrame:
    """For words that have any: ``word``, number of near words ``n_near``, the most frequent ``best`` and its count ``best_n``.

    A list gives one row for each of its words at most, however many pairs it holds.
    """
    batches(words.sparkSession)
    lists = _lists(words, least, limit).repartition("list").sortWithinPartitions("list", "rest")

    def scanned(rows: list[tuple[str, str, int, int, int]]) -> Iterator[tuple[str, int, str, int]]:
        found: dict[int, list] = {}
        for pair in near_in([r[0] for r in rows], *rows[0][3:]):
            for i, j in (pair, pair[::-1]):
                rank = (-rows[j][2], rows[j][1])
                if i not in found:
                    found[i] = [1, rank]
                else:
                    found[i][0] += 1
                    if rank < found[i][1]:
                        found[i][1] = rank
        for i, (n, rank) in found.items():
            yield rows[i][1], n, rank[1], -rank[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in it:
            out: list[tuple[str, int, str, int]] = []
            for of, *row in zip(*(batch[c].to_pylist() for c in ("list", "rest", "word", "n", "r", "below")), strict=True):
                if of != name:
                    if len(held) > 1:
                        out.extend(scanned(held))
                    name, held = of, []
                held.append(row)
            yield _found(out)
        yield _found(list(scanned(held)) if len(held) > 1 else [])

    parts = lists.select("list", "rest", "word", "n", "r", "below").mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def _found(rows: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "best", "best_n"])


def last_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the form that following ``forms(word, form)`` ends at.

    Each round follows twice as many forms as the one before; a chain is as long as counts can double.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ahead.join(now.select("root"), "root", "left_semi").isEmpty():
            return now
        now = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def variants(docs: DataFrame, least: int = 5, seen: int = 3, one_in: int = 97, times: int = 2, limit: int = LIST) -> DataFrame:
    """Every word of the vocabulary with its count, near words, ``form`` and ``root``.

    The form is the near word of largest count (ties: the smaller), if that is at least ``times`` the word's own.
    """
    words = staged(vocabulary(docs, least, seen, one_in), "vocabulary")
    beside = words.join(near(words, least, limit), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    all_words = staged(beside.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(all_words.filter("form is not null"))
    return all_words.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
