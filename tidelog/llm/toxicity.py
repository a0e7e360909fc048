"""Toxicity scores: gradient-boosted trees over dense features with isotonic calibration.

All labelled training rows give the lexicon: words and word beginnings, normalised against
obfuscation, that are in ``LEAST_ROWS`` toxic documents or more and there far more often than in others, with a margin of one standard
error. Documents with each token are counted over all labelled rows, with partial sums in every task; the odds are computed where the counts
are, and the model takes the ``LEXICON`` tokens of the greatest odds at most (a documented bound on its size). Features of a text are
lexicon densities, how near hits are to second-person words, and rates of capitals, punctuation and
obfuscation. The trees and the calibration are fitted on a sample of ``SAMPLE_ROWS`` labelled rows
at most (a documented bound, drawn by a hash of id and text from each class, the rarer class first, and weighted to the shares of the whole);
scores never use labels, lang, source or doc_id.

Labels meet their texts in a join by id, for which only texts are shuffled whose id may have a label, by a bitmap of the ids' hashes of
16 MB at most; the joined rows are written; scoring has no shuffle.

Defined cases: a null or empty text has all features zero and gets the score of such texts; a very long text is measured whole, in
slices; rows with null
doc_id or label are no training rows, and of repeated labels the largest counts; without labelled rows
of both classes every score is the labels' mean (0 without any); repeated rows get equal scores; tokens of equal odds are taken in
their order; an empty
table gives an empty result; columns of the input with the names of new columns are replaced.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.boosting import BoostedTrees, isotonic
from tidelog.llm.common import HashSet, drop_written, per_worker, ready_for_python, written
from tidelog.llm.language_id import held_out
from tidelog.llm.lattice import slices

SAMPLE_ROWS = 20_000
LEAST_ROWS, LEAST_ODDS, LEXICON = 3, 1.5, 100_000
FOLDS = 4
BEGINNINGS = (4, 5, 6)
NEAR_WORDS = 3
KEPT_WORDS, KEPT_CHARS = 200_000, 16_000_000
COUNTED_WORDS, COUNTED_TOKENS = 100_000, 150_000  # remembered, and counted, by a task until they are let go
SECOND_PERSON = set(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
LOOKALIKES = str.maketrans("013457@$", "oieastas")
SQUEEZE, SYMBOL = re.compile(r"(.)\1{2,}"), re.compile(r"[\W_]+")
UPPER, PUNCTUATION, DIGITS = string.ascii_uppercase.encode(), string.punctuation.encode(), string.digits.encode()


def normal(token: str) -> tuple[str, bool, bool]:
    """A word without case, look-alike characters, inner symbols and long repeats; whether it was obfuscated; whether stretched."""
    plain = token.lower().strip(string.punctuation)
    if plain.isalpha():
        squeezed = SQUEEZE.sub(r"\1\1", plain)
        return squeezed, False, squeezed != plain
    if not any(c.isalpha() for c in plain):
        return "", False, False
    word = SYMBOL.sub("", plain.translate(LOOKALIKES))
    squeezed = SQUEEZE.sub(r"\1\1", word)
    return squeezed, SYMBOL.sub("", plain.replace("'", "").replace("-", "")) != plain.replace("'", "").replace("-", "") or any(c.isdigit() for c in plain), squeezed != word


def tokens(word: str) -> list[str]:
    """Lexicon entries that a normalised word could be: itself, and its beginnings (marked by a star)."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n] if word else []


FEATURES = (
    "hits", "hit_count", "worst", "weight", "near_second_person", "second_person", "capitals", "exclaim",
    "punctuation", "obfuscated", "stretched", "length", "shouted", "obfuscated_hits", "digits",
)


class Features:
    """Dense features of texts; remembers the flags of recent words in bounded memory."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.flags = np.zeros((1024, 6), dtype=np.float32)

    def _flags(self, token: str) -> tuple[float, ...]:
        word, obfuscated, stretched = normal(token)
        weight = max((self.lexicon.get(t, 0.0) for t in tokens(word)), default=0.0)
        return weight, word in SECOND_PERSON, obfuscated, stretched, len(token) > 2 and token.isupper(), weight > 0 and obfuscated

    def _rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.place)
        self.chars += sum(map(len, new))
        if (len(self.place) + len(new) > KEPT_WORDS or self.chars > KEPT_CHARS) and self.place:
            self._forget()
            new = set(words)
        while len(self.place) + len(new) > len(self.flags):
            self.flags = np.concatenate((self.flags, np.zeros_like(self.flags)))
        for word in new:
            at = self.place[word] = len(self.place)
            self.flags[at] = self._flags(word)
        return self.flags[np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))]

    def of(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        flags = np.concatenate([self._rows(part.split()) for part in slices(text)])
        data = text.encode()
        chars, n = len(data), max(1, len(flags))
        count = lambda drop: chars - len(data.translate(None, drop))
        hit = np.flatnonzero(flags[:, 0] > 0)
        near = 0
        if len(hit):
            person = np.concatenate(([0], np.cumsum(flags[:, 1] > 0)))
            near = int((person[np.minimum(hit + NEAR_WORDS + 1, len(flags))] > person[np.maximum(hit - NEAR_WORDS, 0)]).sum())
        weights = flags[:, 0]
        rates = flags[:, 1:].mean(axis=0) if len(flags) else np.zeros(5)
        out[:] = (
            len(hit) / n, np.log1p(len(hit)), weights.max(initial=0.0), weights.sum() / n, near / n, rates[0], count(UPPER) / chars,
            (data.count(b"!") + data.count(b"?")) / n, count(PUNCTUATION) / chars, rates[1], rates[2], np.log1p(n), rates[3], rates[4], count(DIGITS) / chars,
        )
        return out

    def table(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t) for t in texts]).reshape(len(texts), len(FEATURES))


@dataclass
class ToxicityModel:
    """``trees`` is None where there was nothing to learn; every score is then ``mean``."""

    lexicon: dict[str, float]
    mean: float
    trees: BoostedTrees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None or self.knots is None:
            return np.full(len(features), self.mean)
        margin = self.trees.margin(features)
        # The small share of the plain logistic keeps the order within a flat part of the calibration.
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _document_counts(rows: DataFrame) -> DataFrame:
    """(token, bad0, good0, bad1, ...): documents of each fold that hold a token, toxic and others, over rows (toxic, fold, text)."""

    def count(batches):
        per_worker()
        seen: dict[tuple[int, bool], Counter] = {}
        known: dict[str, list[str]] = {}

        def flush():
            parts = [(f, x, c) for (f, x), c in seen.items()]
            out = pa.RecordBatch.from_arrays(
                [pa.array([f for f, _, c in parts for _ in c], pa.int32()), pa.array([x for _, x, c in parts for _ in c], pa.bool_()), pa.array([t for _, _, c in parts for t in c], pa.string()), pa.array([n for _, _, c in parts for n in c.values()], pa.int64())],
                names=["fold", "bad", "token", "n"],
            )
            seen.clear()
            return out

        for batch in batches:
            for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: set[str] = set()
                for word in {w for part in slices(text or "") for w in part.split()}:
                    if (found := known.get(word)) is None:
                        if len(known) > COUNTED_WORDS:
                            known.clear()
                        found = tokens(normal(word)[0])
                        if len(word) < 100:
                            known[word] = found
                    own.update(found)
                seen.setdefault((fold, toxic > 0), Counter()).update(own)
            if sum(map(len, seen.values())) > COUNTED_TOKENS:
                yield flush()
        yield flush()

    counts = rows.select("toxic", "fold", "text").mapInArrow(count, "fold int, bad boolean, token string, n long")
    of = lambda f, bad: F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("bad") == bad), F.col("n"))), F.lit(0)).alias(f"{'bad' if bad else 'good'}{f}")
    return counts.groupBy("token").agg(*(of(f, bad) for f in range(FOLDS) for bad in (True, False)))


def _folds(without: int | None) -> list[int]:
    return [f for f in range(FOLDS) if f != without]


def _telling(counts: DataFrame, sizes: dict, most: int) -> list:
    """The tokens that pass for the lexicon of all folds or of all but one, with their counts; ``most`` of the greatest odds."""
    passes, odds = F.lit(False), {}
    for without in (None, *range(FOLDS)):
        n, m = (sum((F.col(f"{kind}{f}") for f in _folds(without)), F.lit(0)) for kind in ("bad", "good"))
        toxic, clean = (sum(sizes.get((f, x), 0) for f in _folds(without)) for x in (True, False))
        odds[without] = F.log((n + 0.5) / (toxic + 1)) - F.log((m + 0.5) / (clean + 1)) - F.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        passes = passes | ((odds[without] >= LEAST_ODDS - 1e-9) & (n > 0))
    all_bad = sum((F.col(f"bad{f}") for f in range(FOLDS)), F.lit(0))
    return counts.where((all_bad >= LEAST_ROWS) & passes).withColumn("odds", odds[None]).orderBy(F.desc("odds"), "token").limit(most).collect()


def _lexicon(rows: list, sizes: dict, without: int | None) -> dict[str, float]:
    """Weights of the tokens that toxic documents have far more often, from all folds but ``without``."""
    toxic, clean = (sum(sizes.get((f, x), 0) for f in _folds(without)) for x in (True, False))
    out = {}
    for r in rows:
        n, m = (sum(r[f"{kind}{f}"] for f in _folds(without)) for kind in ("bad", "good"))
        odds = log((n + 0.5) / (toxic + 1)) - log((m + 0.5) / (clean + 1))
        # the odds less one standard error, so that chance tokens of few documents stay out
        if n and odds - sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) >= LEAST_ODDS:
            out[r["token"]] = odds
    return out


def _takes(toxic: int, clean: int, most: int) -> dict[bool, int]:
    """How many rows of each class are drawn: all if they fit, else half of each, or what the smaller class leaves to the larger."""
    few = min(toxic, max(most // 2, most - clean))
    return {True: few, False: min(clean, most - few)}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, fold, text) of the rows of ``docs`` that have a label."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    near = HashSet(marks.select(F.xxhash64("doc_id"))).marked(rows.where("doc_id is not null"), F.xxhash64("doc_id"), "near").where("near")
    return near.select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("doc_id", "toxic", fold, "text")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from all rows of ``docs`` whose doc_id has a label."""
    spark = docs.sparkSession
    ready_for_python(spark)
    known = written(labelled(docs, labels), "labelled")
    sizes = {(r.fold, r.toxic): r["count"] for r in known.groupBy("fold", (F.col("toxic") > 0).alias("toxic")).count().collect()}
    many = {x: sum(n for (_, t), n in sizes.items() if t is x) for x in (True, False)}
    mean = many[True] / max(1, sum(many.values()))
    if not all(many.values()):
        drop_written(known)
        return ToxicityModel({}, mean)
    found = _telling(_document_counts(known), sizes, LEXICON)
    lexicon = _lexicon(found, sizes, None)
    # A training row is measured by the lexicon of the other folds, as a new text would be.
    others = [_lexicon(found, sizes, f) for f in range(FOLDS)]

    takes = _takes(many[True], many[False], sample_rows)
    # A little more than the share, so that chance leaves enough; the limit then bounds what is collected.
    shares = {x: min(1_000_000, int(1_050_000 * takes[x] / many[x]) + 1000) for x in many}
    shared = spark.sparkContext.broadcast(others)

    def measure(batches):
        per_worker()
        features = [Features(own) for own in shared.value]
        for batch in batches:
            values = np.array([features[f].of(t) for f, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["draw", "toxic", "features"])

    draw = F.xxhash64("doc_id", "text")
    near = F.pmod(draw, F.lit(1_000_000)) < F.when(F.col("toxic") > 0, shares[True]).otherwise(shares[False])
    sample = written(known.where(near).select(draw.alias("draw"), "toxic", "fold", "text").mapInArrow(measure, "draw long, toxic int, features array<double>"), "sample")
    drop_written(known)
    drawn = [r for x in (True, False) for r in sample.where((F.col("toxic") > 0) == x).orderBy("draw", "features").limit(takes[x]).collect()]
    drop_written(sample)
    x, y = np.array([r.features for r in drawn]).reshape(len(drawn), len(FEATURES)), np.array([float(r.toxic > 0) for r in drawn])
    weight = np.where(y > 0, *(many[k] / max(1, sum((r.toxic > 0) is k for r in drawn)) for k in (True, False)))
    fold = np.array([r.draw // 1_000_003 % 4 == 0 for r in drawn], dtype=bool)
    if len({*y[~fold]}) < 2:
        return ToxicityModel(lexicon, mean)
    trees = BoostedTrees().fit(x[~fold], y[~fold], weight[~fold])
    check = fold if len({*y[fold]}) == 2 else ~fold
    return ToxicityModel(lexicon, mean, trees, isotonic(trees.margin(x[check]), y[check], weight[check]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with the score ``out``, from 0 to 1."""
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def scan(batches):
        per_worker()
        own = shared.value
        features = Features(own.lexicon)
        for batch in batches:
            scores = own.score(features.table(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``; learned from the labelled rows that aren't held out."""
    model = train(docs.where(~held_out("doc_id")), labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = with_toxicity(rows, model, out="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
