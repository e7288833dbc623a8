"""Audio functions on sample arrays; spectra run as Arrow batches through numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterlake.functions.arrays import let

DOUBLES = T.ArrayType(T.DoubleType())


def dbfs(rms: Column) -> Column:
    return 20.0 * F.log10(F.greatest(rms, F.lit(1e-7)))


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x * x)


def energy_dbfs(samples: Column) -> Column:
    """Root mean square level; -120 for no samples."""
    return F.when(F.size(samples) == 0, -120.0).otherwise(dbfs(F.sqrt(energy(samples) / F.size(samples))))


def downmix(channels: Column) -> Column:
    """Mean over a list of channels of equal length."""
    n = F.size(channels)
    return F.transform(
        F.get(channels, F.lit(0)),
        lambda _, i: F.aggregate(channels, F.lit(0.0), lambda acc, c: acc + F.get(c, i)) / n,
    )


def to_mono(matrix: Column) -> Column:
    """Mono samples of a two-dimensional payload: at most 8 rows, each longer than that, are channels;
    otherwise the rows are moments in time."""
    rows, cols = F.size(matrix), F.size(F.get(matrix, F.lit(0)))
    in_time = F.transform(matrix, lambda r: F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x) / F.size(r))
    return F.when((rows <= 8) & (cols > rows), downmix(matrix)).otherwise(in_time)


def loudest_channel(channels: Column) -> Column:
    """Index of the channel with most energy, the first on a tie."""
    return let(F.transform(channels, energy), lambda e: F.array_position(e, F.array_max(e)) - 1)


def resample_linear(samples: Column, from_rate: float, to_rate: float) -> Column:
    """Linear interpolation at a new rate, clamped at the ends."""
    if from_rate <= 0 or to_rate <= 0 or abs(from_rate - to_rate) < 1e-6:
        return samples
    ratio = to_rate / from_rate

    def body(v: Column) -> Column:
        n = F.size(v)
        out = F.greatest(F.lit(1), F.round(n * F.lit(ratio)).cast("int"))

        def at(i: Column) -> Column:
            pos = i / F.lit(ratio)
            low = F.least(F.greatest(F.floor(pos).cast("int"), F.lit(0)), n - 1)
            frac = pos - low
            return F.get(v, low) * (1 - frac) + F.get(v, F.least(low + 1, n - 1)) * frac

        return F.when(n == 0, v).otherwise(F.transform(F.sequence(F.lit(0), out - 1), at))

    return let(samples, body)


def frame_count(samples: Column, hop: int) -> Column:
    return F.greatest(F.lit(1), 1 + F.floor(F.greatest(samples, F.lit(0)) / hop).cast("bigint"))


def frame_hops(df: DataFrame, samples: str, chunk: int, hop: int, wait_for_chunk: bool = True) -> DataFrame:
    """One row per hop: the chunk the detector sees (the last ``chunk`` samples that have come in by
    then) and the new samples the decoder gets. Without waiting, a hop is enough to go on."""
    need = chunk if wait_for_chunk else hop
    n = F.size(samples)
    # Hop h is decoded when need - hop samples beyond it are in.
    count = F.floor((n - (need - hop)) / hop).cast("int")
    hops = F.when(count < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count - 1))

    def cut(h: Column) -> Column:
        end = F.least(h * hop + need, n)
        begin = F.greatest(end - chunk, F.lit(0))
        return F.struct(
            h.alias("hop"),
            F.slice(samples, begin + 1, end - begin).alias("vad_chunk"),
            F.slice(samples, h * hop + 1, F.lit(hop)).alias("decode"),
        )

    # Cut inside the row, so that the samples are not copied along with every hop.
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.inline(F.transform(hops, cut)))


def hann(length: int) -> list[float]:
    """Periodic Hann window."""
    return [0.5 - 0.5 * math.cos(2.0 * math.pi * n / length) for n in range(length)]


def spectrum_frames(df: DataFrame, samples: str, n_fft: int, window: int, hop: int) -> DataFrame:
    """Centre-padded, windowed frames, one row each."""
    weights = F.array(*[F.lit(w) for w in hann(window)])
    offset = max(0, (n_fft - window) // 2)
    after = max(0, n_fft - window - offset)
    s = F.col(samples)
    frames = F.sequence(F.lit(0).cast("bigint"), frame_count(F.size(s), hop) - 1)

    def windowed(frame: Column) -> Column:
        start = (frame * hop - n_fft // 2).cast("int")

        def value(w: Column, i: Column) -> Column:
            at = start + i
            return F.when((at >= 0) & (at < F.size(s)), F.get(s, at) * w).otherwise(0.0)

        padded = F.concat(
            F.array_repeat(F.lit(0.0), offset).cast("array<double>"),
            F.transform(weights, value),
            F.array_repeat(F.lit(0.0), after).cast("array<double>"),
        )
        return F.struct(frame.alias("frame"), F.slice(padded, 1, n_fft).alias("windowed"))

    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.inline(F.transform(frames, windowed)))


@F.pandas_udf(DOUBLES)
def power_spectrum(frames: pd.Series) -> pd.Series:
    """|FFT|^2 of each frame, first half."""
    if frames.empty:
        return pd.Series([], dtype=object)
    spec = np.fft.rfft(np.stack(frames.to_numpy()), axis=1)
    return pd.Series(list(spec.real**2 + spec.imag**2))


# Fixed values of the mel scale: linear below 1000 Hz at 200/3 Hz per mel, logarithmic above with
# step ln(6.4)/27.
HZ_PER_MEL = 200.0 / 3.0
BREAK_HZ = 1000.0
LOG_STEP = math.log(6.4) / 27.0


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    knee = BREAK_HZ / HZ_PER_MEL
    return np.where(mel < knee, mel * HZ_PER_MEL, BREAK_HZ * np.exp(LOG_STEP * (mel - knee)))


def hz_to_mel(hz: float) -> float:
    if hz < BREAK_HZ:
        return hz / HZ_PER_MEL
    return BREAK_HZ / HZ_PER_MEL + math.log(hz / BREAK_HZ) / LOG_STEP


def mel_bank(sample_rate: int, n_fft: int, bins: int) -> np.ndarray:
    """Area-normalised triangles between evenly spaced mel points, one row per bin."""
    edges = mel_to_hz(np.linspace(0.0, hz_to_mel(sample_rate / 2), bins + 2))
    freqs = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (freqs - low) / (mid - low), (high - freqs) / (high - mid)
    return np.clip(np.minimum(rising, falling), 0.0, None) * (2.0 / (high - low))


def log_mel(power: Column, sample_rate: int, n_fft: int, bins: int) -> Column:
    """Log mel energies of a power spectrum, floored at 1e-6."""
    bank = mel_bank(sample_rate, n_fft, bins).T

    @F.pandas_udf(DOUBLES)
    def project(spectra: pd.Series) -> pd.Series:
        if spectra.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.log(np.maximum(np.stack(spectra.to_numpy()) @ bank, 1e-6))))

    return project(power)


def cmvn(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Z-score per key with 1e-5 added to the population deviation; the statistics pre-aggregate."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    d = df.join(stats, keys)
    return d.withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-5)).drop("_m", "_s")


def chunk_seconds(shape: Column, sample_rate: int, hop_ms: float) -> Column:
    """Seconds in a model input: samples for rank 2, feature frames for rank 3, unknown otherwise."""
    last = F.get(shape, F.size(shape) - 1)
    return F.when(F.size(shape) == 2, last / float(sample_rate)).when(F.size(shape) == 3, last * hop_ms / 1000.0)
