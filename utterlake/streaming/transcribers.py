"""Plugging a user's transcriber into Spark: loaded once per task, warmed up, timed per row."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


def transcribe(df: DataFrame, make: Callable[[], object], column: str, language: str = "en", keywords: str = "") -> DataFrame:
    """Add text and infer_sec. ``make`` builds an object with transcribe_file(path, language, keywords)
    and, if it likes, warmup()."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        if hasattr(model, "warmup"):
            model.warmup()
        for pdf in batches:
            texts, seconds = [], []
            for item in pdf[column]:
                t = time.perf_counter()
                texts.append(model.transcribe_file(item, language, keywords))
                seconds.append(time.perf_counter() - t)
            yield pdf.assign(text=texts, infer_sec=seconds)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(work, f"{fields}, text string, infer_sec double")


def transcribe_stream(df: DataFrame, make: Callable[[], object], key: str, column: str) -> DataFrame:
    """Streaming payload per row: parallel lists of texts, cursors and stamps."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rows = [model.transcribe_stream(x) for x in pdf[column]]
            yield pd.DataFrame(
                {
                    key: pdf[key].to_numpy(),
                    "results": [r["results"] for r in rows],
                    "cursors": [r["cursors"] for r in rows],
                    "stamps": [r["stamps"] for r in rows],
                }
            )

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(
        work, f"`{key}` {kind}, results array<string>, cursors array<double>, stamps array<array<double>>"
    )


def transcribe_command(
    df: DataFrame, key: str, column: str, argv: list[str], timeout_sec: float, json_key: str | None = None, workers: int = 4
) -> DataFrame:
    """(key, text, status, code, error, infer_sec) of each row: the output of a command of the caller's, or of its field ``json_key``.

    ``{item}`` and ``{id}`` in the arguments stand for the row's input and key. No shell takes the command apart, so nothing in the data is
    run. Each task keeps ``workers`` commands going. status is ``ok``, ``failed`` (exit code other than 0, or no such program),
    ``timeout`` (killed with all that it has started) or ``bad output`` (not the JSON asked for); then text is null and error has the
    first 400 characters of what the command said. A null input is an empty argument.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(item: str | None, name: object) -> tuple:
        args = [a.replace("{item}", item or "").replace("{id}", str(name)) if a in ("{item}", "{id}") else a for a in argv]
        begin = time.perf_counter()
        spent = lambda: time.perf_counter() - begin
        try:
            p = subprocess.Popen(args, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True)
        except OSError as e:
            return None, "failed", None, str(e)[:400], spent()
        try:
            out, said = p.communicate(timeout=timeout_sec)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            return None, "timeout", None, f"over {timeout_sec} s", spent()
        if p.returncode:
            return None, "failed", p.returncode, (said.strip() or out.strip())[:400], spent()
        text = out.strip()
        if json_key is not None:
            try:
                text = str(json.loads(text).get(json_key, "")).strip()
            except (ValueError, AttributeError):
                return None, "bad output", 0, text[:400], spent()
        return text, "ok", 0, None, spent()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                rows = list(pool.map(one, pdf[column], pdf[key]))
                out = pd.DataFrame(rows, columns=["text", "status", "code", "error", "infer_sec"])
                out["code"] = out["code"].astype("Int32")
                yield out.assign(**{key: pdf[key].to_numpy()})[[key, *out.columns]]

    return df.mapInPandas(work, f"`{key}` {kind}, text string, status string, code int, error string, infer_sec double")
