"""String functions over transcript text, all Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate column names, in the order they are tried.
TEXT_CANDIDATES = ("text", "transcript", "sentence", "reference")
TEXT_CANDIDATES_HUB = ("norm_text", "text", "transcription", "sentence")
AUDIO_CANDIDATES = ("audio", "wav", "file", "path")

WORD_MARK = "▁"

# Fixed value: the characters with the Unicode property White_Space, as the inside of a pattern class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_basic(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and apostrophes becomes a space; spaces squeezed."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_compare(text: Column) -> Column:
    """Like normalize_basic, with each run of other characters made one space."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9']+", " ")
    return F.trim(kept)


def normalize_mode(text: Column, mode: str = "basic") -> Column:
    """none trims; basic and open_asr both give the basic form."""
    if mode == "none":
        return strip_all(text)
    if mode in ("basic", "open_asr"):
        return normalize_basic(text)
    raise ValueError(f"unknown mode {mode!r}")


def tokenize(text: Column) -> Column:
    """Whitespace words, without empties."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokenize(text)).cast("bigint")


def edge_punct_norm(word: Column) -> Column:
    """Strip Unicode punctuation at both ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, r"^\p{P}+", ""), r"\p{P}+$", ""))


def alnum_norm(word: Column) -> Column:
    """Lower case, letters, marks and digits only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{M}\p{N}]", "")


def alnum_words(words: Column) -> Column:
    return F.filter(F.transform(words, alnum_norm), lambda w: w != "")


def merged_transcript(confirmed: Column, hypothesis: Column) -> Column:
    """Confirmed text then hypothesis, one space between, empty parts left out."""
    return F.concat_ws(" ", F.nullif(strip_all(confirmed), F.lit("")), F.nullif(strip_all(hypothesis), F.lit("")))


def safe_float(value: Column) -> Column:
    return value.try_cast("double")


def text_fingerprint(text: Column) -> Column:
    return F.sha1(text)


def stride_text(stride: Column) -> Column:
    """A stride with three decimals, zeros and a bare dot stripped."""
    fixed = F.format_string("%.3f", stride)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def stride_id(stride: Column) -> Column:
    return F.concat(F.lit("stride_"), F.translate(stride_text(stride), ".", "p"))


def pick_column(df: DataFrame, candidates: tuple[str, ...]) -> str:
    """First candidate the frame has; a null value in it does not move on to the next."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} among {df.columns}")


def pick_text(df: DataFrame, candidates: tuple[str, ...] = TEXT_CANDIDATES) -> Column:
    """The text column by candidate list; lists are joined by a space."""
    name = pick_column(df, candidates)
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(F.col(name), " ")
    return F.col(name).cast("string")


def preview(text: Column, length: int) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")


def real_time_factor(infer_sec: Column, audio_sec: Column) -> Column:
    return infer_sec / F.greatest(audio_sec, F.lit(1e-9))


def speed_factor(infer_sec: Column, audio_sec: Column) -> Column:
    return audio_sec / F.greatest(infer_sec, F.lit(1e-9))


def strip_all(text: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{WHITE}]+", ""), f"[{WHITE}]+$", "")
