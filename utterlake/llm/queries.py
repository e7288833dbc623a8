"""One thin query for each operator: read the whole table, apply the operator, derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm import oracles
from utterlake.llm.collocations import collocations
from utterlake.llm.filter_audit import audit
from utterlake.llm.fingerprint import edit_likeness
from utterlake.llm.language import identify
from utterlake.llm.lm_scoring import score_texts
from utterlake.llm.minhash import near_duplicates
from utterlake.llm.mixing import mixed_documents
from utterlake.llm.pieces import encode
from utterlake.llm.quality import judge
from utterlake.llm.rlz_dedup import dedup_words
from utterlake.llm.sharding import shuffle_shards
from utterlake.llm.suffix_dedup import dedup_bytes
from utterlake.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_words(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return done.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256", "n_spans")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_bytes(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return done.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shuffle_shards(_documents(spark, sf_dir))
    return done.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixed_documents(_documents(spark, sf_dir))
    return done.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_documents(spark, sf_dir))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    done = judge(_documents(spark, sf_dir).select("doc_id", "text"), labels)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


@query
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id")


#: The vocabulary that the pipeline and the query encode with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(_documents(spark, sf_dir).select("doc_id", "text"), PIECES, verified="lossless")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score_texts(_documents(spark, sf_dir), held_out)


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), _documents(spark, sf_dir))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxicity(_documents(spark, sf_dir).select("doc_id", "text"), labels, held_out).select("doc_id", "held_out", "score", "predicted")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


ORACLES |= {"op12_filter_audit": oracles.OP12, "op13_collocations": oracles.OP13}
ORACLES |= {"op1_rlz_dedup": oracles.OP1, "op3_suffix_dedup": oracles.OP3, "op10_minhash_dedup": oracles.OP10}
