"""Token ids in files of separately compressed documents.

A file set holds three Parquet tables:

* ``dictionary``: one row; a Zstandard dictionary trained on serialized id arrays, its SHA-256, the
  bytes per id, the tokenizer's file name and the end id;
* ``blocks``: documents in ascending ``doc_id`` order, some MB a row. Each document is one Zstandard
  frame of its own in ``payload``; ``offsets`` says where each frame begins, ``n_tokens`` how many ids
  it has, ``doc_ids`` whose it is, ``dict_hash`` which dictionary it needs, ``low`` and ``high``
  the span of document ids, so that a reader of a few documents opens few blocks;
* ``shards``: ids and documents of each range of blocks and the number of ids before it.

Defined cases: a null text is an empty one, its ids are the end id alone. Null document ids come
first; equal ids are ordered by the row key; rows equal in id and text are stored each. An empty
table gives an empty file set. Other columns are not read. A text longer than a block is a block.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, arrow_schema, batches, keyed, map_arrow, partitions
from areaflow.llm.tokens import encoder, vocabulary_path
from areaflow.sources.staging import shared_dir

BLOCK_BYTES = 1 << 20
BLOCKS = ("shard int, block int, low long, high long, doc_ids array<long>, n_tokens array<int>, "
          "offsets array<int>, tokens long, dict_hash string, payload binary")


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, sample: int = 512,
                     sample_chars: int = 4000, size: int = 1 << 16) -> bytes:
    """A dictionary from the ids of about ``sample`` documents; empty where there are too few.

    The sample is bounded on purpose and only decides how small the files get: documents are taken
    by a hash of their row, at a rate that makes about ``sample`` of any number of rows.
    """
    import zstandard

    n = docs.count()
    rows = keyed(docs).filter(F.pmod(F.xxhash64(F.lit("sample"), KEY), F.lit(max(n, 1))) < sample)
    texts = [r[0] for r in rows.select(F.substring("text", 1, sample_chars)).limit(2 * sample).collect()]
    encode = encoder(path)
    arrays = [np.append(np.frombuffer(encode(t), "<u4"), end_id).astype(f"<u{width}").tobytes() for t in sorted(texts)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes, kind: str):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if kind == "write":
        return zstandard.ZstdCompressor(level=3, dict_data=data)
    return zstandard.ZstdDecompressor(dict_data=data)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    """Encode every document and write the file set to ``folder``.

    Texts are dealt out by ranges of ``doc_id`` first and encoded afterwards, so they move once and
    the ids never do. Only frames of one block are in a worker's memory.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    encode = encoder(path)
    width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, path, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(digest, dictionary, width, path.rsplit("/", 1)[-1], end_id)],
        "dict_hash string, bytes binary, width int, tokenizer string, end_id int",
    ).coalesce(1).write.parquet(f"{folder}/dictionary")

    names = arrow_schema(BLOCKS)

    def run(it):
        from pyspark import TaskContext

        shard, code, write = TaskContext.get().partitionId(), encoder(path), _codec(dictionary, "write").compress
        end, number = np.array([end_id], "<u4").tobytes(), 0
        ids, counts, frames, held = [], [], [], 0

        def block():
            real = [i for i in ids if i is not None]
            row = [[shard], [number], [min(real, default=None)], [max(real, default=None)], [ids], [counts],
                   [np.cumsum([0, *map(len, frames)]).tolist()], [sum(counts)], [digest], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, names, strict=True)], schema=names)

        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(code(text) + end, "<u4")
                ids.append(doc)
                counts.append(len(raw))
                frames.append(write(raw.astype(f"<u{width}").tobytes()))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    ids, counts, frames, held, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    batches(spark)
    (keyed(docs).repartitionByRange(partitions(spark), "doc_id", KEY).sortWithinPartitions("doc_id", KEY)
     .select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks"))
    # One row per range of blocks: the ordered sum is over as many rows as there were write tasks.
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("doc_ids")).alias("n_docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/shards")


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the number of ids before them: a sum within a shard over a few block headers."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("shard", "block", "tokens").withColumn(
        "inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    starts = spark.read.parquet(f"{folder}/shards").select("shard", F.col("start").alias("outer"))
    return heads.join(starts, "shard").select("shard", "block", (F.col("inner") + F.col("outer")).alias("start"))


def read_tokens(spark: SparkSession, folder: str, doc_ids: Sequence[int] | None = None,
                with_ids: bool = True) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, the ids.

    With ``doc_ids`` only the frames of those documents are decompressed, from blocks whose span
    of ids can hold them.
    """
    head = spark.read.parquet(f"{folder}/dictionary").first()
    width, dictionary, digest = head["width"], bytes(head["bytes"]), head["dict_hash"]
    wanted = None if doc_ids is None else frozenset(doc_ids)
    blocks = spark.read.parquet(f"{folder}/blocks")
    if wanted is not None:
        span = F.lit(False)
        for i in sorted(wanted):
            span = span | ((F.col("low") <= i) & (F.col("high") >= i))
        blocks = blocks.filter(span)
    blocks = blocks.join(_positions(spark, folder), ["shard", "block"]).select(
        "doc_ids", "n_tokens", "offsets", "dict_hash", "payload", "start")

    def run(batch):
        read = _codec(dictionary, "read").decompress
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
        for row in batch.to_pylist():
            if row["dict_hash"] != digest:
                raise ValueError("a block was written with another dictionary")
            payload, at = memoryview(row["payload"]), row["start"]
            for k, (doc, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                if wanted is None or doc in wanted:
                    ids = np.frombuffer(read(payload[row["offsets"][k]:row["offsets"][k + 1]]), f"<u{width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a frame does not hold the ids its index names")
                    for name, v in zip(out, (doc, at, n, zlib.crc32(ids.tobytes()), ids if with_ids else None), strict=True):
                        out[name].append(v)
                at += n
        return out

    rows = map_arrow(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
    return rows if with_ids else rows.drop("ids")


def encoded(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the file set (to the shared folder by default) and return what is read back from it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/areaflow/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, **options)
    return read_tokens(spark, folder, with_ids=False)
