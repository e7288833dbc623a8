"""Language of web pages by Bayesian fusion of text, declared language, address and host.

1. Text likelihoods: byte trigrams, hashed into 8,192 cells, counted over every labelled document by language.
2. A page's visible text gives a posterior under a flat prior, with the log likelihood scaled by `temper`, as neighbouring
   trigrams depend on each other.
3. These posteriors, summed by grouped aggregation, give P(declared | language), P(address suffix | language), P(language code
   in the path | language), and priors of hosts, smoothed by those of their domains, and these by the global prior. A page is left
   out of its own host's sum.
4. The posterior of a page is the product of all of them.

Null or unlabelled documents teach nothing; a page without text, url or declaration lacks that evidence only; without labels the
result is null; an empty table gives an empty table; repeated rows are pages of their own, and ties go to the language
that comes first by name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm import kernel as K
from utterlake.session import cut_lineage

CELLS = 1 << 13
#: What documents with a label outside the `languages` most frequent ones are taken to be in.
OTHER = "other"
_CLOSER = re.compile(r"</(script|style)\s*>", re.I)
_OPENER = re.compile(r"<(script|style)\b", re.I)
_HTML = re.compile(r"<html\b[^>]*", re.I)
_META = re.compile(r"<meta\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)
_CONTENT = re.compile(r"content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)
_URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d+)?(?:/([a-zA-Z]{2})(?=[/?#]|$))?", re.I)


def visible(html: str) -> str:
    """The text outside tags, comments, scripts and styles, in one walk; what is never closed is text."""
    closers: dict[str, list[tuple[int, int]]] = {"script": [], "style": []}
    for m in _CLOSER.finditer(html):
        closers[m[1].lower()].append(m.span())
    starts = {k: [a for a, _ in v] for k, v in closers.items()}
    out, at = [], 0
    comments = True  # whether a comment may still end
    while (begin := html.find("<", at)) >= 0:
        out.append(html[at:begin])
        end = -1
        if m := _OPENER.match(html, begin):
            kind = m[1].lower()
            k = bisect.bisect_left(starts[kind], m.end())
            if k < len(closers[kind]):
                end = closers[kind][k][1]
        elif comments and html.startswith("<!--", begin):
            end = html.find("-->", begin + 4) + 3
            if end == 2:
                end, comments = -1, False
        if end < 0:
            end = html.find(">", begin) + 1
        if not end:
            at = begin
            break
        out.append(" ")
        at = end
    out.append(html[at:])
    return "".join(out)


def declared_language(html: str) -> str | None:
    """The language that the page's html tag, or else its content-language, names."""
    for tag in _HTML.finditer(html):
        if m := _LANG.search(tag[0]):
            return m[1].lower()
    for tag in _META.finditer(html):
        at = tag[0].lower().find("content-language")
        if at >= 0 and (m := _CONTENT.search(tag[0], at + 16)):
            return m[1].lower()
    return None


def cells(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of each trigram that lies in one text; ASCII letters count as lower case."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    h = (low[:n] * np.uint32(0x9E3779B1)) ^ (low[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (low[2 : n + 2] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    inside = np.arange(n) + 3 <= offs[1:][doc]
    return doc[inside], h[inside].astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's documents by language."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, data, offs in K.text_chunks(batch.column("_text")):
            doc, cell = cells(data, offs)
            names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
            counts = np.bincount(code[doc] * CELLS + cell, minlength=len(names) * CELLS).reshape(-1, CELLS)
            for name, c in zip(names.tolist(), counts, strict=True):
                totals[name] = totals[name] + c if name in totals else c
    for name, c in totals.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "cell", "n"])


def train(docs: DataFrame, languages: int, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and the log probabilities of the cells in each.

    The model is sent to every task, so there are at most `languages` of them and one more for all rarer labels.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("_text"))
    often = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect()]
    if len(often) > languages:
        often = often[:languages]
        known = known.withColumn("lang", F.when(F.col("lang").isin(often), F.col("lang")).otherwise(OTHER))
        often = sorted({*often, OTHER})
    names = sorted(often)
    rows = known.mapInArrow(_count_rows, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(names), CELLS))
    place = {n: k for k, n in enumerate(names)}
    for name, cell, n in rows:
        counts[place[name], cell] = n
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(1, keepdims=True))


def _posterior(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(x.ravel()))


def _evidence_rows(table: np.ndarray, temper: float, chunk: int = 256):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.slice(at, chunk)
                htmls = [h or "" for h in part.column("_html").to_pylist()]
                log = np.zeros((len(htmls), len(table)))
                for i, j, data, offs in K.text_chunks(pa.array([visible(h) for h in htmls], pa.large_string())):
                    doc, cell = cells(data, offs)
                    for k, row in enumerate(table):
                        log[i:j, k] = np.bincount(doc, row[cell], j - i)
                declared = [declared_language(h) for h in htmls]
                found = [_URL.match(u or "") for u in part.column("_url").to_pylist()]
                host = [m[1].lower().rstrip(".") if m else None for m in found]
                labels = [h.split(".") if h else [] for h in host]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        _lists(log * temper),
                        _lists(_posterior(log * temper)),
                        pa.array(declared, pa.string()),
                        pa.array(host, pa.string()),
                        pa.array([".".join(x[-2:]) if x else None for x in labels], pa.string()),
                        pa.array([x[-1] if x else None for x in labels], pa.string()),
                        pa.array([m[2].lower() if m and m[2] else None for m in found], pa.string()),
                    ],
                    names=["page_id", "_log", "_post", "declared", "host", "domain", "suffix", "code"],
                )

    return rows


def _sums(k: int) -> Column:
    """Sum of the posteriors of a group, as an array."""
    return F.array(*[F.sum(F.element_at("_post", i + 1)) for i in range(k)])


def _fuse_rows(names: list[str], weight: float, total: np.ndarray, pages: int):
    k = len(names)
    prior = (total + 1) / (pages + k)

    def array(batch, name, default):
        col = batch.column(name)
        out = np.tile(default, (len(batch), 1))
        has = col.is_valid().to_numpy(zero_copy_only=False)
        if has.any():
            out[has] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return out, has

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            log, _ = array(batch, "_log", np.zeros(k))
            own, _ = array(batch, "_post", np.zeros(k))
            domain, in_domain = array(batch, "_domain", np.zeros(k))
            host, in_host = array(batch, "_host", np.zeros(k))
            base = np.tile(prior, (len(batch), 1))
            for sums, has in ((domain, in_domain), (host, in_host)):
                others = np.maximum(sums - own * has[:, None], 0)
                base = (others + weight * base) / (others.sum(1, keepdims=True) + weight)
            score = log + np.log(base)
            for name in ("_by_declared", "_by_suffix", "_by_code"):
                sums, has = array(batch, name, np.zeros(k))
                # P(value | language), the page left out; values share `weight` pages of each language
                score += np.where(has[:, None], np.log((np.maximum(sums - own, 0) + 0.5) / (total - own + weight)), 0)
            post = _posterior(score)
            best = post.argmax(1)
            text = own.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([names[b] for b in best.tolist()]),
                    pa.array(post[np.arange(len(post)), best]),
                    pa.array([names[b] for b in text.tolist()]),
                    batch.column("declared"),
                    batch.column("host"),
                ],
                names=["page_id", "lang", "confidence", "text_lang", "declared", "host"],
            )

    return rows


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", temper: float = 0.05, weight: float = 5.0, languages: int = 512) -> DataFrame:
    """page_id, lang, confidence, text_lang (by the text alone), declared, host of each page.

    The `languages` most frequent labels of docs are told apart; documents with any other label are one language, `other`.
    """
    names, table = train(docs, languages)
    kind = pages.schema[page_id].dataType.simpleString()
    k = len(names)
    if not k:
        return pages.select(F.col(page_id).alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(
        _evidence_rows(table, temper),
        f"page_id {kind}, _log array<double>, _post array<double>, declared string, host string, domain string, suffix string, code string",
    )
    seen = cut_lineage(seen, "evidence")
    total = seen.agg(F.count("*").alias("n"), _sums(k).alias("s")).first()
    out = seen
    for column, name in (("host", "_host"), ("domain", "_domain"), ("declared", "_by_declared"), ("suffix", "_by_suffix"), ("code", "_by_code")):
        sums = seen.where(F.col(column).isNotNull()).groupBy(column).agg(_sums(k).alias(name))
        out = out.join(sums, column, "left")
    sums = np.array([x or 0.0 for x in total.s])
    return out.mapInArrow(_fuse_rows(names, weight, sums, total.n), f"page_id {kind}, lang string, confidence double, text_lang string, declared string, host string")
