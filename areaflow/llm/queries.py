"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm import (
    bpe_trie, chats, decontaminate, jaccard, lines, packing, quality, secrets, spelling, suffixes, token_files, toxicity, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that repeats a benchmark item."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "start", "stop")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions and checksums read back from the files."""
    return token_files.encoded(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, through all layers."""
    return secrets.found(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    placed = packing.packed(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", F.round("worst", 6).alias("host_rate"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after, and the digest of each document that is left."""
    out = lines.cleaned(table(spark, sf_dir, "documents"))
    return out.select(F.col("d.doc_id").alias("doc_id"), "n_lines", "n_removed",
                      F.sha2(F.coalesce("clean", F.lit("")), 256).alias("text_sha256"))


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation read back from the tree, and one whose texts hold control strings."""
    text = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(text).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return chats.formatted(turns.unionByName(extra))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated substrings."""
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return jaccard.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, its form and the last form."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error",
                      F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


def op13_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its text back from them."""
    back = bpe_trie.decoded(bpe_trie.encoded(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe_trie.listed("ids"), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontamination, op2_token_files, op3_toxicity, op4_secrets, op5_best_fit_packing, op6_chat_tree,
    op7_suffix_dedup, op8_host_rules, op9_line_dedup, op10_jaccard_join, op11_spelling_variants,
    op12_embedding_whitening, op13_bpe_trie)}

#: Queries whose result SQL can give, by name.
ORACLES: dict[str, str] = {}
