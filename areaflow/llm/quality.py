"""Quality rules with verdicts on hosts.

Every document is measured against simple text rules. The failures of each rule are then summed by
host; a host's rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts
themselves, so that a host with three pages is not judged by three pages. A host whose shrunk rate
exceeds a limit is under suspicion: its documents must pass every rule. Elsewhere only the base
rules reject.

Defined cases: a null text is empty and fails the base rules (no words). Documents without a host
(null) form one host. Rows with equal id and text get equal results, each its own row. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, back_to, keyed, map_arrow, staged

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1].astype(np.int64) * len(number) + ids[2:],
                                return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    raw = text.encode()
    words = raw.split()
    octets = np.frombuffer(raw, np.uint8)
    letters = int(((octets & 0xC0) != 0x80).sum() - _SPACE[octets].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), letters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures of every document, with its host."""

    def run(batch):
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        names = [x.split()[0] for x in MEASURES.split(", ")]
        return {"doc_id": batch.column("doc_id"), KEY: batch.column(KEY), "host": batch.column("host"),
                **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

    rows = keyed(docs, host).withColumnRenamed(host, "host").withColumn("host", F.col("host").cast("string"))
    return map_arrow(rows, run, f"doc_id long, {KEY} long, host string, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules(symbols: float = 0.1, dup_lines: int = 3, repeats: float = 0.3,
          word_chars: tuple[float, float] = (2.0, 14.0)) -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    n = F.col("n_words")
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") > symbols * n,
        "lines": F.col("n_dup_lines") > dup_lines,
        "repeats": F.col("n_repeat_words") > repeats * n,
        "length": (F.col("word_chars") < word_chars[0] * n) | (F.col("word_chars") > word_chars[1] * n),
    }


def prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Beta prior of each rule's rate over hosts by moments: one row of sums reaches the driver.

    The variance of the rates, weighted by documents, less what sampling alone would give, fixes the
    prior's weight; hosts that do not differ get a prior worth as many documents as there are.
    """
    total = F.sum("n_docs")
    row = hosts.agg(F.count("*").alias("hosts"), total.alias("n"), *[
        x for r in names for x in (F.sum(f"f_{r}").alias(f"s_{r}"),
                                   F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"q_{r}"))]).first()
    out = {}
    for r in names:
        n = row["n"] or 0
        mean = (row[f"s_{r}"] or 0) / n if n else 0.0
        spread = (row[f"q_{r}"] / n - mean * mean) if n else 0.0
        between = spread - mean * (1 - mean) * max(row["hosts"] - 1, 0) / n if n else 0.0
        weight = mean * (1 - mean) / between - 1 if between > 1e-12 else float(n)
        weight = min(max(weight, 2.0), max(float(n), 2.0))
        out[r] = (mean * weight, (1 - mean) * weight)
    return out


def host_verdicts(measures: DataFrame, limit: float = 0.5, **levels) -> DataFrame:
    """Per host: documents, shrunk rate of each rule, and whether any rate exceeds ``limit``."""
    checks = rules(**levels)
    names = list(checks)
    hosts = staged(measures.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in checks.items()]), "hosts")
    rate = {r: (F.col(f"f_{r}") + a) / (F.col("n_docs") + a + b) for r, (a, b) in prior(hosts, names).items()}
    return hosts.select("host", "n_docs", *[v.alias(f"rate_{r}") for r, v in rate.items()],
                        F.greatest(*rate.values()).alias("worst")).withColumn("suspect", F.col("worst") > limit)


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5, **levels) -> DataFrame:
    """Every document's measures, ``base_failed`` and ``kept``.

    ``kept`` is false for a base failure, and for a document of a suspect host that fails any rule.
    Host sums combine per task before the shuffle, so a host with a third of all rows is one row per
    task; the join back to documents carries no text, and adaptive execution splits a hot host.
    """
    measures = staged(measured(docs, host), "measures")
    hosts = host_verdicts(measures, limit, **levels).select(F.col("host").alias("h"), "suspect", "worst")
    any_rule = F.greatest(*[c.cast("int") for c in rules(**levels).values()]) == 1
    return (measures.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("suspect", F.lit(False)) & any_rule))
            .drop("h", "suspect"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, all columns as they came."""
    bad = judged(docs, **options).filter(~F.col("kept")).select("doc_id", KEY).distinct()
    return back_to(docs, bad, "left_anti").select("d.*")
