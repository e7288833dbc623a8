"""Readers and writers of the pipeline's files. Paths are folders that all executors can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.functions import signal as G
from utterlake.functions import text as X
from utterlake.operators.joins import latest_rows
from utterlake.operators.ordered import Running, running

UTTERANCE_SCHEMA = "ordinal bigint, id string, text string, audio_sec double, infer_sec double"
SAMPLE_SCHEMA = "ordinal bigint, id string, text string, sampling_rate int, array array<double>"
# The keys of a decoder step; trace is ours and tells traces in one folder apart.
TRACE_SCHEMA = (
    "source string, kind string, trace bigint, chunk_index bigint, step_index bigint, encoder_steps bigint, t bigint, token_id bigint, "
    "duration_idx bigint, duration_value bigint, skip bigint, prev_token bigint, token_piece string, emitted boolean, commit_state int, "
    "token_topk array<struct<token_id: bigint, token_piece: string, logp: double>>, "
    "duration_topk array<struct<duration_idx: bigint, duration_value: bigint, logp: double>>"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _objects(spark: SparkSession, path: str, schema: str, rejects: str | None) -> DataFrame:
    """JSON lines as rows. Blank lines are skipped; a malformed line fails the job, or goes to the folder ``rejects``."""
    d = _lines(spark, path).where(X.strip_all(F.col("value")) != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    d = d.select("value", parsed.alias("o"))
    bad = F.col("o").isNull() | F.col("o._bad").isNotNull()
    if rejects is None:
        wrong = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200))).cast("boolean")
        d = d.where(F.when(bad, wrong).otherwise(True))
    else:
        write_lines(d.where(bad).select("value"), rejects)
        d = d.where(~bad)
    return d.select("o.*").drop("_bad")


def scan_utterances(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """JSONL utterances. Blank lines are skipped, ids become strings, numbers may be missing, and of
    several lines with one id the one with the highest ``ordinal`` counts."""
    d = _objects(spark, path, UTTERANCE_SCHEMA, rejects)
    return latest_rows(d, ["id"], F.col("ordinal"))


def scan_manifest_samples(spark: SparkSession, path: str, limit: int | None = None, rejects: str | None = None) -> DataFrame:
    """JSONL samples with inline audio; the id falls back to the ordinal, the duration is computed."""
    d = _objects(spark, path, SAMPLE_SCHEMA, rejects)
    if limit is not None and limit > 0:
        d = d.orderBy("ordinal").limit(limit)
    rate = F.greatest(F.col("sampling_rate"), F.lit(1))
    return d.withColumn("id", F.coalesce("id", F.col("ordinal").cast("string"))).withColumn(
        "audio_sec", F.size("array") / rate
    )


def scan_dataset(
    spark: SparkSession, path: str, ordinal: str, limit: int | None = None, id_column: str | None = "id"
) -> DataFrame:
    """Columnar dataset with the text column found by candidate names."""
    d = spark.read.parquet(path)
    key = F.col(id_column) if id_column in d.columns else F.col(ordinal)
    out = d.select(F.col(ordinal).alias("ordinal"), key.cast("string").alias("id"), X.pick_text(d).alias("reference"))
    if limit is not None and limit > 0:
        return out.orderBy("ordinal").limit(limit)
    return out


# A timestamped line, "[start -> end] Speaker n: text", with any white space between its parts, and line ends.
SPEAKER_LINE = (
    rf"(?s)^\[([0-9]+(?:\.[0-9]+)?)[{X.WHITE}]*->[{X.WHITE}]*([0-9]+(?:\.[0-9]+)?)\]"
    rf"[{X.WHITE}]*Speaker[{X.WHITE}]+([0-9]+):[{X.WHITE}]*(.*)$"
)
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def take_while(df: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Rows before the first row of the key where ``stop`` holds."""
    d = running(df, keys, order, {"_stop": Running("max", stop.cast("int"))})
    return d.where(F.coalesce("_stop", F.lit(0)) == 0).drop("_stop")


def parse_speaker_lines(df: DataFrame, keys: list[str], order: str, line: str, max_seconds: float | None) -> DataFrame:
    """Matching, non-empty lines of each file up to the first that starts at or after the limit."""
    df = df.withColumn(line, X.strip_all(F.col(line)))
    part = lambda i: F.regexp_extract(line, SPEAKER_LINE, i)
    d = df.where(F.col(line).rlike(SPEAKER_LINE)).select(
        *keys,
        order,
        part(1).cast("double").alias("start_sec"),
        part(2).cast("double").alias("end_sec"),
        part(3).cast("int").alias("speaker"),
        X.strip_all(part(4)).alias("text"),
    )
    if max_seconds is not None:
        d = take_while(d, keys, order, F.col("start_sec") >= max_seconds)
    return d.where(F.col("text") != "")


def scan_speaker_lines(spark: SparkSession, path: str, max_seconds: float | None = None) -> DataFrame:
    """Timestamped transcript files. The key of a file is its folder's ``file=`` value, else its path; lines count from 0."""
    d = spark.read.text(path, wholetext=True)
    file = F.col("file") if "file" in d.columns else F.col("_metadata.file_path")
    d = d.select(file.alias("file"), F.posexplode(F.split("value", LINE_END)).alias("ordinal", "line"))
    return parse_speaker_lines(d, ["file"], "ordinal", "line", max_seconds)


def scan_trace(spark: SparkSession, path: str) -> DataFrame:
    """JSONL trace steps; blank, malformed and non-object lines are skipped."""
    d = _lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", TRACE_SCHEMA, {"mode": "PERMISSIVE"})
    return d.select(parsed.alias("t")).where(F.col("t.kind") == "step").select("t.*")


# Manifest column names, in file order.
MANIFEST_COLUMNS = ("dataset", "profile", "run_name", "status")


def scan_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifests, one file each. Lines are stripped; a header with the expected names drops out where it is the
    first line that is not blank, and so do lines without four parts."""
    lines = F.filter(F.transform(F.split("value", LINE_END), X.strip_all), lambda x: x != "")
    d = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("_i", "value"))
    parts = F.split("value", "\t")
    header = (F.col("_i") == 0) & F.col("value").startswith("\t".join(MANIFEST_COLUMNS))
    d = d.where((F.size(parts) == len(MANIFEST_COLUMNS)) & ~header)
    return d.select(*[parts[i].alias(c) for i, c in enumerate(MANIFEST_COLUMNS)])


def scan_run_summaries(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Summary text per run, from <root>/run_name=<name>/... or from packed texts; parsing is left to manifest_report."""
    if packed:
        return read_packed(spark, root).select(F.col("key").alias("run_name"), F.col("text").alias("summary"))
    d = spark.read.text(root, wholetext=True)
    return d.select("run_name", F.col("value").alias("summary"))


def write_packed(df: DataFrame, path: str, key: str, text: str, shards: int = 64) -> None:
    """Many texts in few files: JSON lines of key and text, in folders by a hash of the key. Each task writes to the folders of its own keys
    only. A null key or text stays null."""
    name = F.col(key).cast("string")
    d = df.select(name.alias("key"), F.col(text).alias("text"), F.lit(shards).alias("of"), F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"))
    d.repartition("of", "shard").write.mode("overwrite").partitionBy("of", "shard").json(path)


def read_packed(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """key and text of packed texts; with ``key`` only that one's folder is read."""
    d = spark.read.schema("key string, text string, of int, shard int").json(path)
    if key is not None:
        d = d.where((F.col("shard") == F.pmod(F.xxhash64(F.lit(key)), F.col("of"))) & (F.col("key") == key))
    return d.select("key", "text")


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole transcript files, stripped, with the file key taken from the folder name."""
    return spark.read.text(path, wholetext=True).select("file", X.strip_all(F.col("value")).alias("text"))


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary, one piece per line; the line number from 0 is the token id.

    Several files count as one text in the order of their names. Each is read by itself and shifted by
    the lines of the files before.
    """
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_f"), "value")
    lines = F.when(F.col("value") != "", F.split(F.regexp_replace("value", r"\n$", ""), "\n"))
    d = d.select("_f", lines.alias("_l"))
    # One row per file.
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.select("_f", F.coalesce(F.size("_l"), F.lit(0)).cast("bigint").alias("_n"))
    shifts = counts.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    d = d.select("_f", F.posexplode("_l").alias("_i", "piece")).join(shifts, "_f")
    return d.select((F.col("_shift") + F.col("_i")).alias("id"), "piece")


def scan_audio_arrays(df: DataFrame, matrix: str) -> DataFrame:
    """Two-dimensional audio payloads as mono rows."""
    return df.withColumn("samples", G.to_mono(F.col(matrix))).drop(matrix)


def ingress_stream(spark: SparkSession, path: str, schema: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """Chunks as they arrive in a folder."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed column order; list columns are joined by '; '."""
    types = dict(df.dtypes)
    cols = [F.array_join(c, "; ").alias(c) if types[c].startswith("array") else F.col(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, path: str, partition: str, text: str) -> None:
    """One text folder per value of ``partition``."""
    df.select(partition, F.col(text).alias("value")).write.mode("overwrite").partitionBy(partition).text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column frame as text lines."""
    df.write.mode("overwrite").text(path)
