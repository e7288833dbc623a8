"""Job parameters with the fixed default values of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StreamPolicy:
    sample_rate: int = 16000
    chunk_ms: int = 960
    hop_ms: int = 320

    @property
    def chunk_samples(self) -> int:
        return self.sample_rate * self.chunk_ms // 1000

    @property
    def hop_samples(self) -> int:
        return self.sample_rate * self.hop_ms // 1000


@dataclass(frozen=True)
class VadConfig:
    start_dbfs: float = -35.0
    end_dbfs: float = -45.0
    min_speech_ms: int = 120
    min_silence_ms: int = 250

    @property
    def windowable(self) -> bool:
        return self.start_dbfs > self.end_dbfs and self.min_speech_ms > 0 and self.min_silence_ms > 0


@dataclass(frozen=True)
class StabilizerConfig:
    agreement: int = 2
    draft: int = 1
    decode_only_when_speech: bool = True
    flush_on_speech_end: bool = True
    run_limit: int = 80
    stagnation_limit: int = 24
    carry_words: int = 32


@dataclass(frozen=True)
class AdaptiveStride:
    alpha: float = 0.15
    utilization: float = 0.90
    min_sec: float = 0.25
    max_sec: float = 0.75
    base_sec: float = 0.25
    sample_rate: int = 16000
