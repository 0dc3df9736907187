"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding, normalised by length, with exception phrases.

Folding undoes look-alike letters, accents, digits for letters and signs within words. The lexicon consists of whole words, and beginnings of words, whose share among the
labelled rows is far higher in toxic ones; the weight is the log-odds. A beginning is taken where it is as specific as its evidence: a longer one that has nearly
all of the same toxic words replaces it, and beginnings of beginnings cover their continuations. A hit doesn't count where its word and a neighbour make an
exception phrase: given ones, and word pairs that labelled clean rows have and toxic ones hardly do. The score is a logistic function of the sum of weights and
of that sum in proportion to length; its three coefficients are fitted on the same labelled rows.

Labels are learned from rows with crc32(id as text) mod 5 <> 0, at most fit_rows of them (chosen by a hash of the id). All of these count: rows with the same label and the same
four sketches of their word pairs, copies as a rule, share the weight of one row, so that a text isn't evidence as often as it was copied. Lexicon and phrases are as many as
the evidence gives; they are broadcast, behind a check that fails beyond max_terms. Words are what blanks or signs part: in scripts without either a sentence is one word.

Defined results: null or empty text has no hits and the score of such texts; without labelled rows of both classes every score is the base rate; a null id
counts as held out; labels other than 0 and 1 and those without a document aren't used; a document labelled several times is learned from as often; an empty table gives no rows;
other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows that labels are learned from at most, and entries beyond which a lexicon isn't broadcast but an error.
FIT_ROWS, MAX_TERMS = 200_000, 2_000_000
#: Characters of a word beginning; longer words are taken as a whole besides.
SHORTEST, LONGEST = 3, 14
#: Toxic rows that a beginning needs, its least log-odds, the least likelihood ratio (natural logarithm) against chance, and the share of toxic rows
#: at which a longer beginning replaces it.
SUPPORT, LOG_ODDS, EVIDENCE, AS_GOOD = 4, 2.5, 12.0, 0.9
#: Clean rows that an exception phrase needs, and their least share among its rows.
PHRASE_SUPPORT, PHRASE_SHARE = 5, 0.9
#: Columns of the sketches.
SKETCHES = ("low1", "high1", "low2", "high2")
#: Exception phrases known beforehand, as (word, next word) after folding; hits in either don't count.
PHRASES: tuple[tuple[str, str], ...] = ()

# Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝѵһαβεικνορτυχϲɑɡıſ", "abekmhopctyxijsdqwvhabeikvoptuxcagis"))
DIGITS = dict(zip("01345789", "oieastbg"))
SIGNS = {"@": "a", "$": "s", "€": "e", "|": "i", "!": "i"}


def _fold_table() -> dict[int, str | None]:
    """Each character's folded form: lower case without accents, look-alikes and digits as letters, l as i (1 stands for either), others as a blank."""
    spans = [(0, 0x250), (0x250, 0x2B0), (0x370, 0x530), (0x1D00, 0x2000), (0x2100, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF00, 0xFF60), (0x1D400, 0x1D800), (0x1F130, 0x1F190)]
    table: dict[int, str | None] = {}
    for low, high in spans:
        for at in range(low, high):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(at)).casefold() if not unicodedata.combining(c))
            plain = "".join(LOOKALIKES.get(c, DIGITS.get(c, c)) for c in plain).replace("l", "i")
            table[at] = plain if plain and all(c.isalpha() for c in plain) else " "
    for at in [0xAD, 0x34F, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370), *range(0xFE00, 0xFE10)]:
        table[at] = None
    for at in [*range(0x2010, 0x2070), *range(0x3000, 0x3040)]:
        table.setdefault(at, " ")
    return table


_TABLE = _fold_table()
_SIGN = re.compile(r"(?<=[^\W\d_])[@$€|!](?=[^\W_])|[@$](?=[^\W\d_])")


def fold(text: str | None) -> str:
    """Words of folded letters, one blank before each and after the last."""
    if not text:
        return " "
    if "@" in text or "$" in text or "!" in text or "|" in text or "€" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = text.translate(_TABLE).split()
    return f" {' '.join(words)} " if words else " "


class Model(NamedTuple):
    terms: dict[str, float]
    phrases: frozenset[tuple[str, str]]
    coefficients: tuple[float, float, float]


class Matcher:
    """Sum of weights of the hits in a folded text."""

    def __init__(self, terms: dict[str, float], phrases: frozenset[tuple[str, str]]):
        import ahocorasick

        self.phrases, self.automaton = phrases, ahocorasick.Automaton() if terms else None
        for term, weight in terms.items():
            self.automaton.add_word(" " + term, (len(term), weight))
        if terms:
            self.automaton.make_automaton()

    def hits(self, folded: str):
        """(weight, phrase with the word before, phrase with the word after) of each hit."""
        for end, (size, weight) in self.automaton.iter(folded) if self.automaton else ():
            start = end - size + 1
            stop = folded.find(" ", end + 1)
            word = folded[start:stop]
            before = folded[folded.rfind(" ", 0, start - 1) + 1 : start - 1] if start > 1 else ""
            yield weight, (before, word), (word, folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else "")

    def total(self, folded: str) -> float:
        if not self.phrases:
            return sum(w for _, (_, w) in self.automaton.iter(folded)) if self.automaton else 0.0
        return sum(w for w, a, b in self.hits(folded) if a not in self.phrases and b not in self.phrases)


def features(total: float, folded: str) -> tuple[float, float]:
    """Of the sum of weights: its logarithm, and that of its proportion to length, per 100 characters."""
    return math.log1p(total), math.log1p(100 * total / max(len(folded), 1))


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def sketches(folded: str) -> tuple[int, int, int, int]:
    """Least and greatest of two hashes of the word pairs; near copies agree in all as a rule, other texts hardly ever."""
    words = folded.split()
    first = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])] or [zlib.crc32(folded.encode())], np.uint64)
    second = (first * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return int(first.min()), int(first.max()), int(second.min()), int(second.max())


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, folded, share) of the labelled rows that may be learned from, at most fit_rows or so, whose ids and labels are broadcast.

    share: 1 over the rows that have this row's label and sketches.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = common.materialize(known, "toxic-labels")
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")

    def kernel():
        def step(texts):
            folded = [fold(t) for t in texts]
            found = np.array([sketches(t) for t in folded], np.int64).reshape(-1, 4)
            return {"folded": folded} | {name: found[:, k] for k, name in enumerate(SKETCHES)}

        return step

    rows = common.materialize(common.map_batches(rows, kernel, ["text"], "folded string, " + ", ".join(f"{x} long" for x in SKETCHES)).drop("text"), "toxic-training")
    alike = common.materialize(rows.groupBy("toxic", *SKETCHES).agg(F.count("*").alias("n")).filter("n > 1"), "toxic-alike")
    # At most half as many rows as were learned from, of six numbers each.
    return rows.join(F.broadcast(alike), ["toxic", *SKETCHES], "left").select("toxic", "folded", (1.0 / F.coalesce("n", F.lit(1))).alias("share"))


def _bounded(found: DataFrame, most: int) -> list:
    """The rows, at the driver; an error if they are more than most."""
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries: learn from fewer rows (fit_rows)")
    return rows


def _tally(labels, shares, items) -> dict[str, list]:
    """Sums of shares of toxic and of clean rows by item; items has a set for each row."""
    toxic, clean = Counter(), Counter()
    for label, share, found in zip(labels, shares, items):
        into = toxic if label else clean
        for x in found:
            into[x] += share
    every = list(toxic.keys() | clean.keys())
    return {"item": every, "t": [float(toxic[x]) for x in every], "c": [float(clean[x]) for x in every]}


def lexicon(rows: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Words and word beginnings, and their weights."""

    def kernel():
        def step(labels, texts, shares):
            found = _tally(labels, shares, (set(t.split()) for t in texts))
            return {"word": found["item"], "t": found["t"], "c": found["c"]}

        return step

    totals = rows.agg(F.sum(F.col("toxic") * F.col("share")).alias("t"), F.sum("share").alias("n")).first()
    t, c = totals["t"] or 0.0, (totals["n"] or 0.0) - (totals["t"] or 0.0)
    if t <= 0 or c <= 1e-9:
        return {}
    words = common.map_batches(rows, kernel, ["toxic", "folded", "share"], "word string, t double, c double", keep=False).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    cuts = F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    begins = F.explode(F.when(F.length("word") > LONGEST, F.array_append(cuts, F.col("word"))).otherwise(cuts))
    terms = words.filter(F.length("word") >= SHORTEST).select(begins.alias("term"), "t", "c").groupBy("term").agg(F.round(F.sum("t"), 6).alias("t"), F.round(F.sum("c"), 6).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("c") + 0.5) / (c + 1))
    rate, share = t / (t + c), F.col("t") / (F.col("t") + F.col("c"))
    evidence = F.col("t") * F.log(share / rate) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    found = _bounded(terms.filter((F.col("t") >= SUPPORT) & (share > rate)).withColumn("odds", F.round(odds, 6)).filter((F.col("odds") >= LOG_ODDS) & (evidence >= EVIDENCE)), max_terms)
    support = {r["term"]: r["t"] for r in found}
    weights = {r["term"]: r["odds"] for r in found}
    best = Counter()  # support of the best entry that is longer by one step
    for term in support:
        shorter = term[: min(len(term) - 1, LONGEST)]
        best[shorter] = max(best[shorter], support[term])
    kept = {x for x in support if best[x] < AS_GOOD * support[x]}
    return {x: weights[x] for x in kept if not any(x[:k] in kept for k in range(SHORTEST, min(len(x), LONGEST + 1)))}


def exception_phrases(rows: DataFrame, terms: dict[str, float], most: int = MAX_TERMS) -> frozenset[tuple[str, str]]:
    """Word pairs with a hit that clean rows have."""
    if not terms:
        return frozenset()
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def kernel():
        matcher = Matcher(sent.value, frozenset())

        def step(labels, texts, shares):
            found = _tally(labels, shares, ({p for _, a, b in matcher.hits(text) for p in (a, b) if all(p)} for text in texts))
            return {"a": [p[0] for p in found["item"]], "b": [p[1] for p in found["item"]], "t": found["t"], "c": found["c"]}

        return step

    pairs = common.map_batches(rows, kernel, ["toxic", "folded", "share"], "a string, b string, t double, c double", keep=False).groupBy("a", "b").agg(F.round(F.sum("t"), 6).alias("t"), F.round(F.sum("c"), 6).alias("c"))
    return frozenset((r["a"], r["b"]) for r in _bounded(pairs.filter((F.col("c") >= PHRASE_SUPPORT) & (F.col("c") >= PHRASE_SHARE * (F.col("c") + F.col("t")))), most))


def coefficients(rows: DataFrame, terms: dict[str, float], phrases: frozenset[tuple[str, str]]) -> tuple[float, float, float]:
    """Logistic regression on the two features by Newton's method over a table of rounded features and their counts."""
    sent = rows.sparkSession.sparkContext.broadcast((terms, phrases))

    def kernel():
        matcher = Matcher(*sent.value)

        def step(labels, texts, shares):
            seen = Counter()
            for label, t, share in zip(labels, texts, shares):
                seen[(label, *(round(x, 2) for x in features(matcher.total(t), t)))] += share
            return {"y": [k[0] for k in seen], "a": [k[1] for k in seen], "b": [k[2] for k in seen], "n": [float(n) for n in seen.values()]}

        return step

    cells = common.map_batches(rows, kernel, ["toxic", "folded", "share"], "y int, a double, b double, n double", keep=False).groupBy("y", "a", "b").agg(F.round(F.sum("n"), 6).alias("n")).orderBy("y", "a", "b").collect()
    y, n = np.array([r["y"] for r in cells], float), np.array([r["n"] for r in cells], float)
    positive, every = float((y * n).sum()), float(n.sum())
    base = math.log((positive + 0.5) / (every - positive + 0.5)) if every else -4.0
    if not 0 < positive < every or not terms:
        return base, 0.0, 0.0
    x = np.array([[1.0, r["a"], r["b"]] for r in cells])
    beta = np.array([base, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - 1e-2 * beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(3) * 1e-2, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(round(b, 6)) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Model:
    rows = training_rows(docs, labels, fit_rows)
    terms = lexicon(rows)
    known = exception_phrases(rows, terms) | frozenset(tuple(fold(w).strip() for w in p) for p in phrases)
    return Model(terms, known, coefficients(rows, terms, known))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (score >= 0.5) and weight, the sum of the weights of its hits."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def kernel():
        terms, phrases, (a, b, c) = sent.value
        matcher = Matcher(terms, phrases)

        def step(texts):
            totals, scores = [], []
            for t in texts:
                folded = fold(t)
                totals.append(matcher.total(folded))
                x, y = features(totals[-1], folded)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))))
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores], "weight": totals}

        return step

    return common.map_batches(docs, kernel, [text_col], "score double, predicted int, weight double")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, as they are."""
    told = score(common.packed(docs, text_col), model, text_col).filter("predicted = 0")
    return told.select(*common.unpacked(told, docs.columns, **{text_col: text_col}))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
