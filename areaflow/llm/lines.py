"""Line deduplication by winnowing.

A run of lines that occurs earlier - in a document with a smaller ``doc_id``, or further up in the same
one - is deleted where it holds at least ``min_words`` words. Lines without a word are passed over and
stay. Lines are compared without the white space around them.

Every line has a hash. A window is a smallest run of lines with ``min_words`` words, read forward from
its first line or backward from its last; its fingerprint is its least line hash, placed at the first line that has it. A
repeated run holds a whole window, which is the same in both places, so both select the same fingerprint at two places.
Fingerprints with one place, however many windows select it, are done with. Around each place of the others the
windows that select it are compared whole, and a window that also starts earlier is deleted. The forward
and backward windows inside a repeated run cover all its lines, so exactly the repeated runs go,
whichever of many earlier places each part of them comes from.

Places are not joined with each other. The first place of a fingerprint may stand among other lines, while a run repeats
one of its many further places: extending from the first place alone loses that run, and joining
all places of a common line is a pair for every two of them. Windows meet by their digests instead, one row each.

Defined cases: a null text is empty and has no lines. A null ``doc_id`` comes before all others. Rows
of one ``doc_id`` are ordered by row key; rows equal in id and text are one document, get the same
result, and do not count as copies of each other. An empty table gives an empty result. Other columns
are kept by ``without_repeats`` and not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, back_to, keyed, map_arrow, staged

MIN_WORDS = 20
_DIGEST = 16


def line_digests(text: str) -> tuple[list[int], bytes, list[int]]:
    """Numbers, digests and word counts of the lines with a word."""
    number, digests, words = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        line = line.strip()
        if line:
            number.append(i)
            digests.append(blake2b(line, digest_size=_DIGEST).digest())
            words.append(len(line.split()))
    return number, b"".join(digests), words


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """First and last line of every smallest forward and backward run of ``min_words`` words."""
    found, total, lo = set(), 0, 0
    for hi, w in enumerate(words):  # backward: the latest start for this end
        total += w
        while total - words[lo] >= min_words:
            total -= words[lo]
            lo += 1
        if total >= min_words:
            found.add((lo, hi))
    total, hi = 0, 0
    for lo, w in enumerate(words):  # forward: the earliest end for this start
        while hi < len(words) and total < min_words:
            total += words[hi]
            hi += 1
        if total < min_words:
            break
        found.add((lo, hi - 1))
        total -= w
    return sorted(found)


def fingerprint(digests: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The least line hash of a window, as a signed 64-bit number, and the first line that has it."""
    least, place = min((digests[_DIGEST * k:_DIGEST * k + 8], k) for k in range(lo, hi + 1))
    return int.from_bytes(least, "big", signed=True), place


def _digested(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per document with a window: line digests, words, and its distinct fingerprints with the number of their places."""

    def run(batch):
        out = {k: [] for k in ("doc_id", KEY, "digests", "words", "marks")}
        for doc, key, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", KEY, "text")], strict=True):
            _, digests, words = line_digests(text)
            if sum(words) < min_words:
                continue
            marks: dict[int, int] = {}
            last: dict[int, int] = {}
            for lo, hi in windows(words, min_words):  # in order, so a mark's places come in order too
                m, place = fingerprint(digests, lo, hi)
                if last.get(m) != place:
                    last[m] = place
                    marks[m] = marks.get(m, 0) + 1
            for k, v in zip(out, (doc, key, digests, np.array(words, "<u4").tobytes(),
                                  [{"mark": m, "times": n} for m, n in marks.items()]), strict=True):
                out[k].append(v)
        return out

    return map_arrow(keyed(docs), run, f"doc_id long, {KEY} long, digests binary, words binary, "
                                       "marks array<struct<mark:long,times:int>>")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, row key and spans of lines (numbers among the lines with a word) to delete.

    Only digests move. Counts of marks and earliest windows combine per task before the shuffle; the
    two joins back have one row per mark or window on one side, and a hot one is split on the other.
    """
    rows = staged(_digested(docs, min_words).dropDuplicates(["doc_id", KEY]), "lines")
    marks = rows.select("doc_id", KEY, F.inline("marks"))
    again = marks.groupBy("mark").agg(F.sum("times").alias("times")).filter("times > 1").select("mark")
    hits = (marks.join(again, "mark").groupBy("doc_id", KEY).agg(F.collect_list("mark").alias("hits"))
            .withColumnRenamed("doc_id", "hit_doc").withColumnRenamed(KEY, "hit_key"))
    near = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col(KEY) == F.col("hit_key")))

    def run(batch):
        out = {k: [] for k in ("doc_id", KEY, "window", "lo", "hi")}
        for row in batch.to_pylist():
            marked, digests = set(row["hits"]), row["digests"]
            for lo, hi in windows(np.frombuffer(row["words"], "<u4").tolist(), min_words):
                if fingerprint(digests, lo, hi)[0] in marked:
                    whole = blake2b(digests[_DIGEST * lo:_DIGEST * (hi + 1)], digest_size=16).digest()
                    for k, v in zip(out, (row["doc_id"], row[KEY], whole, lo, hi), strict=True):
                        out[k].append(v)
        return out

    found = staged(map_arrow(near.select("doc_id", KEY, "digests", "words", "hits"), run,
                             f"doc_id long, {KEY} long, window binary, lo int, hi int"), "windows")
    place = F.struct("doc_id", KEY, "lo")
    first = (found.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("window", "first"))
    later = found.join(first, "window").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of the spans; lines with a word before, and deleted."""
    number, _, words = line_digests(text)
    gone = np.zeros(len(number) + 1, np.int64)
    for lo, hi in spans:
        gone[lo] += 1
        gone[hi + 1] -= 1
    drop = {number[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] > 0)}
    if not drop:
        return text, len(words), 0
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), len(words), len(drop)


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of ``docs`` as struct ``d``, with ``clean`` (null stays null), ``n_lines`` and ``n_removed``."""
    both = back_to(docs, repeats(docs, min_words)).select("d", F.col("d.text").alias("text"), F.col("r.spans").alias("spans"))
    fields = both.schema["d"].dataType.simpleString()

    def run(batch):
        texts = batch.column("text").to_pylist()
        rows = [cut(t or "", [(s["lo"], s["hi"]) for s in spans or ()])
                for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True)]
        return {"d": batch.column("d"), "clean": [None if t is None else r[0] for t, r in zip(texts, rows, strict=True)],
                "n_lines": [r[1] for r in rows], "n_removed": [r[2] for r in rows]}

    return map_arrow(both, run, f"d {fields}, clean string, n_lines long, n_removed long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated runs deleted; ``n_chars``, where there is one, follows the text."""
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean"), F.lit(0)).cast("long")}
    return cleaned(docs, min_words).select(*[
        new[c].alias(c) if c in new else F.col("d").getField(c).alias(c) for c in docs.columns])
