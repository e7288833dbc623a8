"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matches, exception phrases, scores normalised by length.

A text is folded first: lower case, look-alike letters of other scripts, accents, digits and symbols inside words become plain
letters, so that disguised words meet the lexicon. Terms are whole words or beginnings of words. Their weights are learnt from
a bounded sample of labelled rows: one pass counts words of toxic and other texts and proposes terms, a second one finds them and counts the
distinct pairs of neighbours each is found between, so that copies of a text count once. Two-word phrases around a term
that speak against toxicity become exceptions, and matches inside them don't count. The score is a logistic function of the
summed weights and of their share of the text's words.

Null, empty and wordless texts have no matches and get the score of a text without any. Rows without a label, and labels that
are null, teach nothing; an id with several labels is toxic if one of them says so. Without rows of both kinds, or without
terms, every score is the share of toxic rows (0 without labels). An empty table gives an empty table; repeated rows score alike;
whole texts of any length are read. Columns of the input named as new ones are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.session import cut_lineage

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "авекмнопрстухьѕіјԁһԛԝɡɩαβγεηικνορτυχωϲ",
    "abekmhonpctyxbsijdhqwgiabyeniknoptuxwc",
)
#: Signs that stand for a letter inside a word, and digits that do so in a word with letters.
SIGNS = str.maketrans("@$€!|+", "aseiit")
DIGITS = str.maketrans("0134579", "oieastg")
#: What is dropped: combining marks, soft hyphens, joiners and other characters without width.
DROPPED = dict.fromkeys([*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])
#: l, i and 1 are written for each other; all become i.
BARS = str.maketrans("l", "i")
#: Plain characters: capitals and bars as above, all but letters and digits as blanks.
PLAIN = {k: " " if not chr(k).isalnum() else chr(k).lower().translate(BARS) for k in range(128)}

_SIGN = re.compile(r"(?<=\w)[@$€!|+](?=\w)")
_DIGIT = re.compile(r"\d+")
_GAP = re.compile(r"[\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")


class _Runs(dict):
    """Folded runs of characters outside ASCII, remembered; the same few come again and again."""

    def __missing__(self, run: str) -> str:
        if len(self) > 100_000:
            self.clear()
        self[run] = out = unicodedata.normalize("NFKD", run).casefold().translate(DROPPED).translate(LOOK_ALIKES)
        return out


_RUNS = _Runs()


def _letters(m: re.Match) -> str:
    """Digits beside a letter, as letters."""
    around = m.string[max(0, m.start() - 1) : m.start()] + m.string[m.end() : m.end() + 1]
    return m[0].translate(DIGITS) if any(c.isalpha() for c in around) else m[0]


def fold(text: str | None) -> str:
    """The folded words of a text, each between single spaces."""
    text = text or ""
    if not text.isascii():
        text = _OTHER.sub(lambda m: _RUNS[m[0]], text)
    text = _DIGIT.sub(_letters, _SIGN.sub(lambda m: m[0].translate(SIGNS), text))
    text = " ".join(text.translate(PLAIN).split()) if text.isascii() else _GAP.sub(" ", text.lower()).strip().translate(BARS)
    return f" {text} " if text else " "


class Lexicon:
    """Weights of terms and exception phrases, in one automaton.

    A term is ` begin` (words that begin so) or ` word ` (that word); an exception is ` two words `.
    """

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.weights, self.exceptions = dict(weights), sorted(exceptions)
        self.machine = ahocorasick.Automaton()
        for term in self.weights:
            self.machine.add_word(term, (term, len(term)))
        for phrase in self.exceptions:
            self.machine.add_word(phrase, (None, len(phrase)))
        if self.weights:
            self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[str, int, int]]:
        """(term, start, end) of the longest term of each matched word outside exceptions; start is the blank before the word."""
        if not self.weights:
            return []
        best, spans = {}, []
        for last, (term, length) in self.machine.iter(folded):
            start = last + 1 - length
            if term is None:
                spans.append((start, last))
            elif start not in best or length > len(best[start]):
                best[start] = term
        out = []
        k, reach = 0, -1
        spans.sort()
        for start in sorted(best):
            end = folded.index(" ", start + 1)
            while k < len(spans) and spans[k][0] <= start:
                reach = max(reach, spans[k][1])
                k += 1
            if reach < end:
                out.append((best[start], start, end))
        return out

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for text in batch.column("_text"):
        yield fold(text.as_py())  # one text at a time, as there are very long ones


def _word_counts(batches: Iterator[pa.RecordBatch], flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each folded word occurs."""
    counts = (Counter(), Counter())

    def out():
        for toxic, count in enumerate(counts):
            if count:
                n = pa.array(count.values(), pa.int64())
                zero = pa.array(np.zeros(len(count), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), n if toxic else zero, zero if toxic else n], names=["word", "bad", "good"])
                count.clear()

    for batch in batches:
        for toxic, text in zip(batch.column("_toxic").to_pylist(), _texts(batch), strict=True):
            counts[toxic].update(set(text.split()))
            if len(counts[toxic]) > flush:
                yield from out()
    yield from out()


def chance(bad: Column, good: Column, share: float) -> Column:
    """Log likelihood ratio of a term's own share of toxic texts against the overall one, where it is higher."""
    n = bad + good
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return F.when(bad > n * share, part(bad, F.lit(share)) + part(good, F.lit(1 - share))).otherwise(0.0)


def propose(words: DataFrame, share: float, most: int) -> list[str]:
    """Up to `most` terms whose excess in toxic texts is beyond chance, given how many were looked at.

    Of terms that begin alike the one with the largest ratio is taken, of equal ones the longest; whole words before beginnings.
    """
    ends = F.transform(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(24))), lambda k: F.substring("word", F.lit(1), k))
    terms = F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.transform(F.when(F.length("word") >= 4, ends).otherwise(F.array()), lambda p: F.concat(F.lit(" "), p)))
    # only terms of toxic texts can be proposed; what they begin with narrows the words that are taken apart
    bad = words.where("bad > 0").select(F.explode(terms).alias("term"), "bad").groupBy("term").agg(F.sum("bad").alias("bad"))
    looked = bad.count()
    least = float(np.log(max(looked, 1) / 0.01))
    worth = bad.where(F.col("bad") * float(-np.log(share)) >= least)
    start = lambda c: F.rtrim(F.substring(c, 1, 5)).alias("_start")
    near = words.where("good > 0").withColumn("_start", start(F.concat(F.lit(" "), "word"))).join(worth.select(start("term")).distinct(), "_start", "left_semi")
    good = near.select(F.explode(terms).alias("term"), "good").join(worth.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("good").alias("good"))
    rated = worth.join(good, "term", "left").select("term", chance(F.col("bad"), F.coalesce("good", F.lit(0)), share).alias("ratio"))
    rows = rated.where(F.col("ratio") >= least).orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(most).collect()
    taken: set[str] = set()
    begun: set[str] = set()
    for term in (r.term for r in rows):
        begins = {term[:k] for k in range(5, len(term) + 1)}
        if not begins & taken and term not in begun:
            taken.add(term)
            begun |= begins
    return sorted(taken)


def _contexts(terms: list[str]):
    """Every match of a term in labelled texts, with the words around it."""
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for toxic, text in zip(batch.column("_toxic").to_pylist(), _texts(batch), strict=True):
                for term, start, end in lexicon.hits(text):
                    before = text[text.rfind(" ", 0, start) + 1 : start]
                    after = text[end + 1 : text.find(" ", end + 1)] if end + 1 < len(text) else ""
                    found.add((term, before, text[start + 1 : end], after, toxic))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(found), strict=True)], names=["term", "before", "word", "after", "toxic"])

    return rows


def learn(labelled: DataFrame, share: float, most: int) -> Lexicon:
    """The lexicon of labelled rows (_text, _toxic). Weights are log ratios of contexts, smoothed by half a context of each kind."""
    words = cut_lineage(labelled.mapInArrow(_word_counts, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    terms = propose(words, share, most)
    if not terms:
        return Lexicon({})
    found = labelled.mapInArrow(_contexts(terms), "term string, before string, word string, after string, toxic boolean")
    # a pair of neighbours counts once for each kind of text
    contexts = cut_lineage(found.distinct(), "contexts")
    tally = [F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")]
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - float(np.log(share / (1 - share)))
    least = float(np.log(max(len(terms), 1) / 0.01))
    known = contexts.groupBy("term").agg(*tally).where(chance(F.col("bad"), F.col("good"), share) >= least)
    weights = {r.term: r.weight for r in known.select("term", odds.alias("weight")).collect()}
    phrase = lambda a, b: F.concat(F.lit(" "), a, F.lit(" "), b, F.lit(" "))
    around = contexts.select("term", "toxic", F.explode(F.array(F.when(F.col("before") != "", phrase("before", "word")), F.when(F.col("after") != "", phrase("word", "after")))).alias("phrase"))
    spared = around.where("phrase is not null").groupBy("phrase").agg(*tally).where((F.col("good") >= 3) & (odds < 0))
    exceptions = [r.phrase for r in spared.orderBy(F.desc("good"), "phrase").limit(most).collect()]
    return Lexicon(weights, exceptions)


def matched(df: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    """df with _weight (of all matches) and _words (how many words the text has) instead of its text."""
    keep = [c for c in df.columns if c != text]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, folded in enumerate(_texts(batch)):
                weight[k] = sum(lexicon.weights[t] for t, _, _ in lexicon.hits(folded))
                words[k] = folded.count(" ") - 1 if len(folded) > 1 else 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(weight), pa.array(words)], names=[*keep, "_weight", "_words"])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "_weight double", "_words long"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")).mapInArrow(rows, schema)


def signals(weight, words, log) -> list:
    """What the logistic function sees: the weight, and the weight for each hundred words."""
    return [log(1 + weight), log(1 + 100 * weight / (words + 20))]


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression with non-negative slopes by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    free = np.ones(x.shape[1], bool)
    while True:
        beta = np.zeros(x.shape[1])
        pull = np.where(np.arange(len(beta)) < len(beta) - 1, l2, 1e-3)[free]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            z = x[:, free]
            grad = z.T @ (n * (p - y)) + pull * beta[free]
            step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(pull), grad)
            beta[free] -= step / max(1.0, float(np.abs(step).max()) / 4)
        low = np.flatnonzero(beta[:-1] < 0)
        if not len(low):
            return beta
        free[low] = False


def calibrate(scored: DataFrame) -> np.ndarray | None:
    """Coefficients from the labelled rows of matched() (_toxic, _weight, _words), gathered in cells of a tenth of a unit."""
    grid = [F.round(s, 1).alias(f"_s{k}") for k, s in enumerate(signals(F.col("_weight"), F.col("_words"), F.log))]
    cells = scored.groupBy(*grid).agg(F.count("*").alias("n"), F.avg(F.col("_toxic").cast("double")).alias("y")).orderBy("_s0", "_s1").collect()
    if not cells:
        return None
    a = np.array([tuple(r) for r in cells], float)
    return fit(a[:, :2], a[:, 3], a[:, 2])


def toxicity(df: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", train_rows: int = 20000, terms: int = 20000, extra: dict[str, float] | None = None) -> DataFrame:
    """df without its texts, with held_out, score (0 to 1) and predicted (score of 0.5 or more).

    Labels of held-out rows are not read. The lexicon is learnt from about train_rows labelled ids or fewer, drawn by a hash of
    the id; that bounds what is broadcast. terms bounds the lexicon and the exceptions, taken by evidence. extra adds folded terms
    with weights of one's own (` word ` or ` begin`).
    """
    own = [c for c in df.columns if c.lower() not in ("held_out", "score", "predicted") or c in (id_column, text)]
    rows = df.select(*[F.col(f"`{c}`") for c in own], F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = labels.where("toxic is not null").groupBy(F.col(id_column).alias("_id")).agg((F.max("toxic") == 1).alias("_toxic"))
    step = max(1, -(-known.count() // train_rows))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(step)) == 0)
    texts = rows.where(~F.col("held_out")).select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).where("_id is not null")
    labelled = cut_lineage(texts.join(F.broadcast(known), "_id").select("_text", "_toxic"), "labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("_toxic")).first()
    lexicon = learn(labelled, bad / n, terms) if 0 < bad < n else Lexicon({})
    if extra:
        lexicon = Lexicon(lexicon.weights | extra, lexicon.exceptions)
    beta = calibrate(matched(labelled.withColumnRenamed("_text", text), lexicon, text)) if lexicon.weights and 0 < bad < n else None
    done = matched(rows, lexicon, text)
    if beta is None:
        score = F.lit(bad / n if n else 0.0)
    else:
        near = sum((F.lit(float(b)) * s for b, s in zip(beta[:-1], signals(F.col("_weight"), F.col("_words"), F.log), strict=True)), F.lit(float(beta[-1])))
        score = 1 / (1 + F.exp(-near))
    done = done.withColumn("score", score)
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_weight", "_words")
