"""Streaming jobs: keyed processors, windows, shedding, latency and batch traces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from utterlake.operators.backlog import shed
from utterlake.session import scratch
from utterlake.streaming.processors import KeyedState, LatencyProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(source: DataFrame | Feed, key: str, processor: KeyedState) -> DataFrame | Feed:
    """Run a keyed processor; rows of a key meet in one task, all else stays parallel."""
    if isinstance(source, Feed):
        return source.derive(lambda stream: keyed(stream, key, processor))
    stream = source
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=processor.output,
        outputMode="append",
        timeMode="none" if processor.idle_ms is None and processor.ttl_ms is None else "ProcessingTime",
    )


@dataclass
class Feed:
    """A stream over a folder and the tables still to be put there, one after the other."""

    stream: DataFrame
    path: str
    parts: list[DataFrame]

    def derive(self, build: Callable[[DataFrame], DataFrame]) -> Feed:
        return Feed(build(self.stream), self.path, self.parts)


def staged(spark: SparkSession, parts: list[DataFrame], label: str, key: str | None = "stream", files: int | None = 64) -> Feed:
    """Feed tables to a stream in turn. The query stops in between and resumes from its checkpoint.

    A micro-batch takes at most ``files`` files. All rows of a key in a part are in one file, so that none comes before its time.
    With ``files`` None each part is one micro-batch, in however many files it was written.
    """
    path = scratch(spark, label)
    parts[0].limit(0).write.parquet(path)
    reader = spark.readStream.schema(parts[0].schema)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return Feed(stream, path, [p.repartition(key) if key else p for p in parts])


def run(source: DataFrame | Feed, label: str, sink: Callable[[DataStreamWriter, str], DataStreamWriter], watch: Callable[[list], None] | None = None) -> str:
    """Process what is there, and then each part of a feed; returns the output folder. ``watch`` gets the progress of each query."""
    feed = source if isinstance(source, Feed) else Feed(source, "", [])
    spark = feed.stream.sparkSession
    out, checkpoint = scratch(spark, label), scratch(spark, f"{label}-ckpt")
    for part in feed.parts or [None]:
        if part is not None:
            part.write.mode("append").parquet(feed.path)
        writer = sink(feed.stream.writeStream, out).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        if watch:
            watch(query.recentProgress)
    return out


def run_to_table(source: DataFrame | Feed, label: str) -> DataFrame:
    """Process what is there, into Parquet in the shared folder, and read the result, without late rows."""
    return run_with_late(source, label)[0]


def run_with_late(source: DataFrame | Feed, label: str) -> tuple[DataFrame, DataFrame | None]:
    """As run_to_table, and the late rows of a keyed processor (stream, seq) as a table of their own."""
    stream = source.stream if isinstance(source, Feed) else source
    out = run(source, label, lambda w, path: w.format("parquet").outputMode("append").option("path", path))
    d = stream.sparkSession.read.schema(stream.schema).parquet(out)
    if "late" not in d.columns:
        return d, None
    return d.where("not late").drop("late"), d.where("late").select("stream", "seq")


def run_batches(
    source: DataFrame | Feed, label: str, work: Callable[[DataFrame, int, str], None], mode: str = "append"
) -> str:
    """Process what is there by a function of (batch, epoch, output folder); returns the folder. An
    epoch that is run again after a failure overwrites what it wrote."""
    return run(
        source,
        label,
        lambda w, out: w.outputMode(mode).foreachBatch(lambda df, epoch: work(df, epoch, out)),
    )


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Event-time rows once each; copies and rows later than the watermark drop out."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, length: str, slide: str, key: str, value: str) -> DataFrame:
    """Sliding windows: the chunk is the length, the hop the slide."""
    w = F.window(time, length, slide)
    g = stream.groupBy(w, key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.unix_micros("window.start").alias("start_us"), key, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Spells of activity separated by at least ``gap``; merged before the shuffle, so that a busy key
    sends few rows."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    g = stream.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "n")


def shed_stream(source: Feed, label: str, keys: list[str], order: str, **budget) -> DataFrame:
    """Per micro-batch shedding; a chunk table with kept and resync flags."""

    def work(df: DataFrame, epoch: int, out: str) -> None:
        shed(df, keys, order, **budget).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    out = run_batches(source, label, work)
    return source.stream.sparkSession.read.parquet(out)


def latency_stream(source: DataFrame | Feed, label: str, reach: int) -> DataFrame:
    """Ready latency of events whose marks come in the same stream: (stream, seq, ms) of each event, once. Statistics are taken over
    the result, so they hold for the whole stream, however many micro-batches there were."""
    return run_to_table(keyed(source, "stream", LatencyProcessor(reach)), label)


def latency_stats(latencies: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and 95th percentile, by sketches that Spark merges."""
    p95 = F.percentile_approx("ms", 0.95, 10000).alias("p95_ms")
    return latencies.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), p95)


@dataclass
class Tally:
    """What became of the rows of a stream: kept, copies of kept ones, and late ones in a table of their own."""

    kept: DataFrame
    late: DataFrame
    n_read: int
    n_late: int


def deduplicated_with_late(source: Feed, time: str, keys: list[str], delay_ms: int, label: str) -> Tally:
    """As deduplicated(), and the rows later than the watermark by themselves.

    A second query over the same micro-batches compares each row with the watermark that the rows before its batch have set;
    that watermark is kept in the checkpointed output, so a batch that is run again sets the same rows apart.
    """
    spark = source.stream.sparkSession
    once = source.derive(lambda s: deduplicated(s, time, keys, f"{delay_ms} milliseconds"))
    parts = source.parts
    out_kept, out_late, out_marks = (scratch(spark, f"{label}-{x}") for x in ("kept", "late", "marks"))
    checkpoints = [scratch(spark, f"{label}-ckpt") for _ in range(2)]
    counts = {"read": 0, "late": 0}

    def set_apart(df: DataFrame, epoch: int) -> None:
        # the watermark in milliseconds, as Spark rounds it, after the batches before this one
        marks = [] if epoch == 0 else spark.read.schema("high long").parquet(out_marks).where(f"epoch < {epoch}").agg(F.max("high")).first()
        high = marks[0] if marks else None
        known = df.observe(f"{label}-{epoch}", F.count("*").alias("n"))
        seen = known.withColumn("_ms", F.unix_millis(time))
        late = seen.where(F.lit(False) if high is None else F.unix_micros(time) <= (high - delay_ms) * 1000).drop("_ms")
        late.write.mode("overwrite").parquet(f"{out_late}/epoch={epoch}")
        df.agg(F.max(F.unix_millis(time)).alias("high")).write.mode("overwrite").parquet(f"{out_marks}/epoch={epoch}")

    for part in parts:
        part.write.mode("append").parquet(source.path)
        first = once.stream.writeStream.format("parquet").option("path", out_kept).option("checkpointLocation", checkpoints[0])
        query = first.trigger(availableNow=True).start()
        query.awaitTermination()
        for p in query.recentProgress:
            counts["read"] += p.numInputRows
            counts["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        second = source.stream.writeStream.foreachBatch(set_apart).option("checkpointLocation", checkpoints[1])
        second.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(source.stream.schema).parquet(out_kept)
    late = spark.read.schema(source.stream.schema).parquet(out_late)
    return Tally(kept, late, counts["read"], counts["late"])


def batch_trace(events: Feed, label: str, queue_limit: int) -> DataFrame:
    """One JSON object per micro-batch: sizes, queue, drops and the latest event."""

    def work(df: DataFrame, epoch: int, out: str) -> None:
        d = df.agg(
            F.lit("realtime_batch").alias("kind"),
            F.lit(epoch).cast("bigint").alias("trace_batch_index"),
            F.count("*").alias("batch_chunk_count"),
            F.min("seq").alias("batch_first_chunk"),
            F.max("seq").alias("batch_last_chunk"),
            F.sum(F.greatest(F.lit(0), F.col("queued") - queue_limit)).alias("dropped_chunks"),
            F.max("queued").alias("queue_chunk_count"),
            F.max_by("is_speech", "seq").alias("event_is_speech"),
        )
        d.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{out}/epoch={epoch}")

    out = run_batches(events, label, work)
    schema = (
        "kind string, trace_batch_index bigint, batch_chunk_count bigint, batch_first_chunk bigint, batch_last_chunk bigint, "
        "dropped_chunks bigint, queue_chunk_count bigint, event_is_speech boolean"
    )
    return events.stream.sparkSession.read.schema(schema).json(out)
