"""Audio and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.functions import signal as G
from utterlake.plans import fixtures as fx
from utterlake.plans.registry import query

N_FFT, WINDOW, HOP, BINS, RATE = 64, 48, 16, 8, 16000


def total(c):
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dbfs_sql(x: str) -> str:
    return f"20.0::DOUBLE * log10(greatest(sqrt(list_sum(list_transform({x}, lambda x: x * x)) / len({x})), 1e-7::DOUBLE))"


@query("sg1_energy_dbfs", f"SELECT utt, round({dbfs_sql('samples')}, 6) AS dbfs FROM v_sig")
def _(spark, sf):
    return fx.sig(spark, sf).select("utt", F.round(G.energy_dbfs(F.col("samples")), 6).alias("dbfs"))


@query(
    "sg2_downmix",
    """SELECT utt, len(m) AS n, round(list_sum(m), 6) AS total, round(m[7], 6) AS seventh FROM
    (SELECT utt, list_transform(range(1, len(ch0) + 1), lambda i: (ch0[i] + ch1[i]) / 2) AS m FROM v_sig2)""",
)
def _(spark, sf):
    d = fx.sig2(spark, sf).select("utt", G.to_mono(F.array("ch0", "ch1")).alias("m"))
    return d.select(
        "utt", F.size("m").cast("bigint").alias("n"), F.round(total("m"), 6).alias("total"), F.round(F.get("m", F.lit(6)), 6).alias("seventh")
    )


@query(
    "sg3_pick_loudest_channel",
    "SELECT utt, CASE WHEN list_sum(list_transform(ch1, lambda x: x * x)) > list_sum(list_transform(ch0, lambda x: x * x)) THEN 1 ELSE 0 END AS channel FROM v_sig2",
)
def _(spark, sf):
    return fx.sig2(spark, sf).select("utt", G.loudest_channel(F.array("ch0", "ch1")).alias("channel"))


@query(
    "sg4_resample_linear",
    """SELECT utt, i AS pos, round(samples[lo + 1] * (1 - (p - lo)) + samples[least(lo + 1, 63) + 1] * (p - lo), 6) AS value FROM
    (SELECT utt, samples, i, i / 0.6::DOUBLE AS p, least(greatest(CAST(floor(i / 0.6::DOUBLE) AS BIGINT), 0), 63) AS lo FROM (SELECT utt, samples, unnest(range(38)) AS i FROM v_sig))""",
)
def _(spark, sf):
    d = fx.sig(spark, sf).select("utt", F.posexplode(G.resample_linear(F.col("samples"), 16000.0, 9600.0)).alias("pos", "value"))
    return d.select("utt", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "sg5_frame_hops",
    f"""SELECT utt, h AS hop, round({dbfs_sql('samples[h * 16 + 1:h * 16 + 48]')}, 6) AS vad_dbfs, round(list_sum(samples[h * 16 + 1:h * 16 + 16]), 6) AS decode_sum
    FROM (SELECT utt, samples, unnest(range(2)) AS h FROM v_sig)""",
)
def _(spark, sf):
    d = G.frame_hops(fx.sig(spark, sf), "samples", 48, 16)
    return d.select(
        "utt",
        F.col("hop").cast("bigint").alias("hop"),
        F.round(G.energy_dbfs(F.col("vad_chunk")), 6).alias("vad_dbfs"),
        F.round(total("decode"), 6).alias("decode_sum"),
    )


FRAMES_SQL = """(SELECT utt, f AS frame, 8 + i AS n, CASE WHEN f * 16 + i - 32 BETWEEN 0 AND len(samples) - 1 THEN samples[f * 16 + i - 32 + 1] ELSE 0 END * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 48)) AS x
  FROM (SELECT utt, samples, f, unnest(range(48)) AS i FROM (SELECT utt, samples, unnest(range(1 + len(samples) // 16)) AS f FROM v_sig)))"""
POWER_SQL = f"""(SELECT utt, frame, k, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) AS power
  FROM {FRAMES_SQL}, range(33) t(k) GROUP BY utt, frame, k)"""
MEL_SQL = f"""(SELECT utt, frame, m AS bin, ln(greatest(sum(power * w), 1e-6::DOUBLE)) AS value FROM {POWER_SQL} JOIN (
    SELECT m, k, greatest(0, least((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) AS w
    FROM (SELECT m, k, k * 250.0::DOUBLE AS f, e[m + 1] AS lo, e[m + 2] AS mid, e[m + 3] AS hi FROM range(8) a(m), range(33) b(k),
      (SELECT list_transform(range(10), lambda i: CASE WHEN i * top / 9 < 15 THEN i * top / 9 * 200.0::DOUBLE / 3 ELSE 1000.0::DOUBLE * exp(ln(6.4::DOUBLE) / 27 * (i * top / 9 - 15)) END) AS e
        FROM (SELECT 15 + ln(8.0::DOUBLE) / (ln(6.4::DOUBLE) / 27) AS top)))) USING (k) GROUP BY utt, frame, m)"""


def power(spark, sf):
    d = G.spectrum_frames(fx.sig(spark, sf), "samples", N_FFT, WINDOW, HOP)
    return d.select("utt", "frame", G.power_spectrum("windowed").alias("power"))


def mel(spark, sf):
    d = power(spark, sf).select("utt", "frame", G.log_mel(F.col("power"), RATE, N_FFT, BINS).alias("m"))
    return d.select("utt", "frame", F.posexplode("m").alias("bin", "value"))


@query("sg6_power_spectrum", f"SELECT utt, frame, k, round(power, 6) AS power FROM {POWER_SQL}")
def _(spark, sf):
    d = power(spark, sf).select("utt", "frame", F.posexplode("power").alias("k", "p"))
    return d.select("utt", "frame", F.col("k").cast("bigint").alias("k"), F.round("p", 6).alias("power"))


@query("sg7_mel_project", f"SELECT utt, frame, bin, round(value, 5) AS value FROM {MEL_SQL}")
def _(spark, sf):
    return mel(spark, sf).select("utt", "frame", F.col("bin").cast("bigint").alias("bin"), F.round("value", 5).alias("value"))


@query(
    "sg8_cmvn",
    f"""SELECT utt, frame, bin, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-5::DOUBLE), 4) AS z
    FROM {MEL_SQL} WINDOW w AS (PARTITION BY utt, bin)""",
)
def _(spark, sf):
    d = G.cmvn(mel(spark, sf), ["utt", "bin"], "value")
    return d.select("utt", "frame", F.col("bin").cast("bigint").alias("bin"), F.round("z", 4).alias("z"))


@query("sg9_frame_count", "SELECT doc_id, greatest(1, 1 + greatest(total, 0) // 160) AS frames FROM v_len")
def _(spark, sf):
    return fx.length(spark, sf).select("doc_id", G.frame_count(F.col("total"), 160).alias("frames"))


@query(
    "ag24_chunk_duration_estimate",
    """SELECT utt, frame_rank, CASE frame_rank WHEN 2 THEN n / 16000.0::DOUBLE WHEN 3 THEN n * 10.0::DOUBLE / 1000 END AS sec
    FROM (SELECT utt, len(samples) + utt AS n, 1 + utt % 3 AS frame_rank FROM v_sig)""",
)
def _(spark, sf):
    n = F.size("samples") + F.col("utt")
    one = F.lit(1).cast("bigint")
    shape = F.slice(F.array(one, one, n), (3 - F.col("utt") % 3).cast("int"), (1 + F.col("utt") % 3).cast("int"))
    d = fx.sig(spark, sf).withColumn("shape", shape)
    return d.select("utt", (1 + F.col("utt") % 3).alias("frame_rank"), G.chunk_seconds(F.col("shape"), RATE, 10.0).alias("sec"))
