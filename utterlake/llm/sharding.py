"""Two-pass external shuffle into shards of equal row counts, in DataFrame functions only.

Pass one counts rows and bytes, files each row in a bucket by a seeded hash of its id and text, and counts the buckets;
a bucket is about bucket_bytes large. Pass two gathers each bucket, shuffles it by Fisher and Yates' rule (Spark's seeded
shuffle of an array) and deals its rows to the shards in turn, going on where the bucket before has ended.

Null ids and texts are values like others; an empty table gives an empty table; repeated rows get slots of their own; a row
longer than a bucket is a bucket's one row. Columns named shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _starts(counts: DataFrame) -> DataFrame:
    """Rows in the buckets before each bucket; the running sum goes over groups of a thousand buckets first."""
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_g"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_g"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return starts.join(groups, "_group").select("_bucket", (F.col("_s") + F.col("_g")).alias("_start"))


def shuffle_shards(df: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 1, bucket_bytes: int = 8 << 20) -> DataFrame:
    """The rows of df with shard (0 to shards - 1, counts at most one apart) and slot (gapless from 0 in each shard).

    The order depends on the rows and the seed alone, not on how df is partitioned.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.xxhash64(F.lit(seed), F.col(id_column), F.col(text)).alias("_h"),
    )
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 64
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // bucket_bytes))
    # another hash than the one that orders a bucket's rows before they are shuffled
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_h")), F.lit(n))
    filed = rows.withColumn("_bucket", bucket)
    counts = filed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.expr("_bucket div 1024"))
    gathered = filed.repartition(n, "_bucket").groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_h", "_row"))).alias("_rows"))
    # the seeded shuffle draws on and on within a partition, so buckets that share one must come in a fixed order
    shuffled = gathered.sortWithinPartitions("_bucket").withColumn("_rows", F.shuffle("_rows", seed))
    placed = shuffled.join(_starts(counts), "_bucket").select("_start", F.posexplode("_rows").alias("_pos", "_one"))
    index = F.col("_start") + F.col("_pos")
    return placed.select("_one._row.*", F.pmod(index, F.lit(shards)).cast("int").alias("shard"), F.floor(index / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write shuffled rows as one folder for each shard, in slot order within a file."""
    df.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
