"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them: the turns of all conversations form a tree, and each
shared turn is written once. The tokens of the tree stand in depth-first order, cut into one segment per
distinct conversation: the turns that the conversation does not share with one before it. A segment
carries where it starts in that order, the position id of its first token (the tokens of the turns before it,
whichever segments hold them), the intervals of its ancestors' tokens that it attends to, and the tokens
under the loss mask.

A turn is ``### role: text</turn>`` and a line end. A backslash goes before every backslash in a text, and before
the first character of anything that would read as a control string; roles escape colons too. Header, text and
end are tokenized apart, so shared turns have the same tokens everywhere and the mask ends with the text.

How it is done: a digest chained over the turns names a node of the tree. Distinct conversations are sorted by their
chain; a node belongs to the first conversation through it, found by a minimum that combines per task.
Conversations sorted by chain visit the tree depth first, so a conversation's own nodes are the end of
its chain, and its ancestors are few intervals, one for each branching above it.

Defined cases: a null text or role is empty. Turns are ordered by number, null first, then role and text; equal
rows are turns each. A null ``conv_id`` names one conversation. An empty table gives empty files. Other columns are
not read. A conversation is held by one task at a time.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.llm.common import arrow_schema, batches, map_arrow, partitions, staged
from areaflow.llm.tokens import visible_bytes, encoder, vocabulary_path
from areaflow.sources.staging import shared_dir

NODE = 16
_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
_UNDO = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
END = "</turn>\n"


def escaped(text: str, what: re.Pattern = _TEXT) -> str:
    return what.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def header(role: str) -> str:
    return f"### {escaped(role, _ROLE)}: "


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    tokenizer, back = encoder(path).tokenizer, {c: b for b, c in visible_bytes().items()}
    return [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
            for t in (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))]


def decode(raw: bytes, path: str) -> bytes:
    return b"".join(map(_token_bytes(path).__getitem__, np.frombuffer(raw, "<u4").tolist()))


def _chained(turns: DataFrame, path: str, loss_role: str) -> DataFrame:
    """One row per conversation: chain of node digests, tokens and their number by turn, spans of the loss."""
    schema = "conv_id long, chain binary, lengths binary, ids binary, loss binary"
    names = arrow_schema(schema)

    def run(it):
        code = encoder(path)
        end, now, held = code(END), None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (now[0], b"".join(held[0]), np.array(held[1], "<u4").tobytes(), b"".join(held[2]),
                 np.array(held[3], "<u4").tobytes()), names, strict=True)], schema=names)

        for batch in it:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (conv,):
                    if now:
                        yield row()
                    now, held, node, total = (conv,), ([], [], [], []), b"", 0
                head, body = code(header(role)), code(escaped(text))
                node = blake2b(node + sha256(role.encode()).digest() + text.encode(), digest_size=NODE).digest()
                n, m = len(head) // 4, len(body) // 4
                held[0].append(node)
                held[1].append(n + m + len(end) // 4)
                held[2].append(head + body + end)
                if role == loss_role:
                    held[3].extend((total + n, total + n + m))
                total += held[1][-1]
        if now:
            yield row()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    batches(turns.sparkSession)
    return (rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, schema))


def write_tree(turns: DataFrame, folder: str, path: str | None = None, loss_role: str = "assistant") -> None:
    """Write ``segments`` (in depth-first order) and ``members`` (whose conversation ends in which segment)."""
    path = path or vocabulary_path()
    convs = staged(_chained(turns, path, loss_role), "conversations").withColumn(
        "leaf", F.expr(f"substring(chain, octet_length(chain) - {NODE - 1}, {NODE})"))
    first = convs.groupBy("leaf").agg(F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id")).alias("one"))
    one = convs.alias("c").join(first.alias("f"), (F.col("c.leaf") == F.col("f.leaf"))
                                & F.col("c.conv_id").eqNullSafe(F.col("f.one.conv_id"))).select("c.*")
    n = partitions(turns.sparkSession)
    # Numbers from ranges of the sorted chains grow in depth-first order; written at once, they stay.
    ordered = staged(one.repartitionByRange(n, "chain").sortWithinPartitions("chain").withColumn(
        "rank", F.monotonically_increasing_id()), "ordered")

    def nodes_of(batch):
        out = {k: [] for k in ("rank", "node", "n")}
        for r in batch.to_pylist():
            lengths = np.frombuffer(r["lengths"], "<u4").tolist()
            out["rank"] += [r["rank"]] * len(lengths)
            out["node"] += [r["chain"][NODE * k:NODE * (k + 1)] for k in range(len(lengths))]
            out["n"] += lengths
        return out

    nodes = staged(map_arrow(ordered.select("rank", "chain", "lengths"), nodes_of, "rank long, node binary, n long"), "nodes")
    owners = nodes.groupBy("node").agg(F.min("rank").alias("owner"))
    shares = staged(nodes.join(owners, "node").groupBy("rank", "owner").agg(F.sum("n").alias("n")), "shares")
    own = shares.filter("rank = owner").select("rank", "n").withColumn("range", F.shiftright("rank", 33))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    outer = own.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("outer"))
    within = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(own.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(outer, "range").select(
        "rank", "n", (F.col("inner") + F.col("outer")).alias("start")), "starts")
    above = shares.filter("rank <> owner").select("rank", "owner", F.col("n").alias("length")).join(
        starts.select(F.col("rank").alias("owner"), "start"), "owner").groupBy("rank").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("attends"))

    def segment(batch):
        out = {k: [] for k in ("start", "n_tokens", "position", "ids", "loss", "attends")}
        for r in batch.to_pylist():
            n, total = r["n"], len(r["ids"]) // 4
            loss = np.frombuffer(r["loss"], "<u4").reshape(-1, 2).astype(np.int64) - (total - n)
            for k, v in zip(out, (r["start"], n, total - n, r["ids"][4 * (total - n):],
                                  [{"lo": int(a), "hi": int(b)} for a, b in loss if a >= 0], r["attends"] or []), strict=True):
                out[k].append(v)
        return out

    rows = ordered.join(starts, "rank").join(above, "rank", "left").select("start", "n", "ids", "loss", "attends")
    map_arrow(rows, segment, "start long, n_tokens long, position long, ids binary, loss array<struct<lo:long,hi:long>>, "
                             "attends array<struct<start:long,stop:long>>").repartitionByRange(n, "start").sortWithinPartitions(
        "start").write.parquet(f"{folder}/segments")
    leaves = ordered.join(starts, "rank").select("leaf", "start")
    convs.select("conv_id", "leaf").join(leaves, "leaf").select("conv_id", "start").write.parquet(f"{folder}/members")


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct conversation of the files: segment ``start``, its tokens in order and its loss spans."""
    segments = spark.read.parquet(f"{folder}/segments")
    own = F.struct("start", (F.col("start") + F.col("n_tokens")).alias("stop"))
    path = segments.select(F.col("start").alias("leaf"), F.explode(F.concat("attends", F.array(own))).alias("part"))
    parts = path.select("leaf", F.col("part.start").alias("start"), (F.col("part.stop") - F.col("part.start")).alias("length")).join(
        segments.select("start", "position", "ids", "loss"), "start")
    keep = F.filter("loss", lambda s: s["hi"] <= F.col("length"))
    moved = F.transform(keep, lambda s: F.struct((s["lo"] + F.col("position")).alias("lo"), (s["hi"] + F.col("position")).alias("hi")))
    sliced = parts.select("leaf", F.struct("position", F.expr("substring(ids, 1, CAST(length * 4 AS INT))").alias("ids"),
                                           moved.alias("loss")).alias("piece"))
    whole = sliced.groupBy("leaf").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select(F.col("leaf").alias("start"), "pieces")


def digests(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """Read every conversation back: turns, loss text and length, as counts and digests."""
    path = path or vocabulary_path()

    def run(batch):
        out = {k: [] for k in ("leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for start, pieces in zip(batch.column("start").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            ids = b"".join(p["ids"] for p in pieces)
            formatted = decode(ids, path).decode()
            turns = parsed(formatted)
            loss = [unescaped(decode(ids[4 * s["lo"]:4 * s["hi"]], path).decode()) for p in pieces for s in p["loss"]]
            whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for k, v in zip(out, (start, len(turns), whole, sum(map(len, loss)), sha256("".join(loss).encode()).hexdigest(),
                                  len(formatted)), strict=True):
                out[k].append(v)
        return out

    rows = map_arrow(read_conversations(spark, folder), run, "leaf long, n_turns long, turns_sha256 string, loss_chars long, "
                                                             "loss_sha256 string, formatted_chars long")
    members = spark.read.parquet(f"{folder}/members")
    return members.join(rows, F.col("start") == F.col("leaf")).drop("start", "leaf")


def formatted(turns: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the tree (to the shared folder by default) and return what is read back from it."""
    spark = turns.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/areaflow/chats-{uuid.uuid4().hex}"
    write_tree(turns, folder, **options)
    return digests(spark, folder, options.get("path"))
