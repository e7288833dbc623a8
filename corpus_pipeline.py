"""Training-data pipeline over `documents`: each stage's rows are written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.minhash import keep_first
from utterlake.llm.mixing import mixed_texts
from utterlake.llm.pieces import encode
from utterlake.llm.quality import keep_good
from utterlake.llm.queries import PIECES
from utterlake.llm.suffix_dedup import dedup_bytes
from utterlake.session import cut_lineage, release, used_scratch


def stage(fn):
    """A stage over any table with doc_id, source and text. Its other columns travel in one struct, so that no name of theirs can meet
    one of the operator's. If the operator has left scratch files, its rows are written and the files go at once; no
    frame that a caller holds depends on what a later stage does."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        start = len(used_scratch())
        columns = docs.columns
        held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns) if c != "text"])
        out = fn(spark, docs.select(held.alias("_held"), "doc_id", "source", "text"), sf_dir)
        text = F.col("text")
        n_chars = F.length(text).cast("long")
        place = {c: F.col(f"_held.c{k}") for k, c in enumerate(columns)} | {"text": text}
        if fn.__name__ in CHANGING and "n_chars" in columns:
            place["n_chars"] = n_chars
        out = out.select(*[place[c].alias(c) for c in columns])
        own = used_scratch()[start:]
        if own:
            out = cut_lineage(out, fn.__name__)
            release(spark, own)
        return out

    return run_stage


#: Stages that change texts, and so their lengths.
CHANGING = ("substring_dedup", "mixing")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go, and so do those without a text (null, empty or of under 50 words).

    Repeated rows are judged alike; an empty table stays empty; texts of any length are judged whole.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (null ids last, of repeated rows one).

    Null texts are empty texts, which are copies of each other; texts of under five words are near-duplicates of equal ones only.
    """
    return keep_first(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated strings of 200 bytes go; documents stay, also those of which nothing is left.

    Null texts become empty ones; a character of which only some bytes would go stays whole; repeated rows lose all they share.
    """
    return dedup_bytes(docs).drop("text").withColumnRenamed("kept_text", "text")


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: one row for each time a document's source is gone through.

    Documents without words have no rows; repeated rows are documents of their own.
    """
    return mixed_texts(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of the mixed texts, and whether they decode to the text. Null texts have no pieces."""
    done = encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), PIECES, verified="lossless")
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Trees, signatures and sampling are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
        if name == "quality_rules":  # the others have written their rows
            docs = cut_lineage(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
