"""Language identification of spans by Viterbi over per-word scores with a switching penalty.

Training counts the character trigrams of all training texts by language, and in which scripts a
language's letters are. A word's script range narrows its candidates to the languages that use it;
their trigrams score the word. Over the words of a text, Viterbi with a penalty for each switch
labels spans of one language; the predicted language is the one whose spans have most letters.

Most texts are of one language, which a bound proves without a path search: if no stretch of words
prefers another language to the overall best one by more than half the penalty, no switch can pay. Only the
other texts are searched, many at once. No shuffle but that of trigram counts.

All training texts are counted. The model keeps the trigrams with a share of ``LEAST_SHARE`` or more of their language's trigrams (a
documented bound on its size: 500,000 a language at most); the others score as unknown ones do.

Defined cases: a very long text is read in slices, its path searched whole; a null text, or one without a letter, is ``und`` with score 0; training rows with null
text or language are ignored; without any training row every text is ``und``; of equally good languages
the one with more training letters wins, then the smaller name; repeated rows get equal results; an empty
table gives an empty result; columns of the input with the names of new columns are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import drop_written, per_worker, ready_for_python, written
from tidelog.llm.lattice import slices

SWITCH_PENALTY = 12.0
#: Word scores are capped this far below the best language's.
WORST_WORD = 8.0
#: A trigram below this share of its language's trigrams is left out, which bounds the model.
LEAST_SHARE = 2e-6
#: A language uses a script if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
KEPT_WORDS, KEPT_CHARS = 400_000, 16_000_000
TRIGRAMS_AT_ONCE = 1_000_000
UNKNOWN = "und"
#: First code point of Unicode's script ranges (rough blocks), each up to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
]
MARKS = ".,;:!?\"'()[]{}*%$&#-_/|"
_STARTS = np.array([a for a, _ in SCRIPTS])
#: Characters before it are of the first range.
FIRST_OTHER = chr(SCRIPTS[1][0])


def script(char: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(char), side="right")) - 1][1]


def letters(word: str) -> str:
    low = word.lower()
    if low.isalpha() or (low := low.strip(MARKS)).isalpha():
        return low
    return "".join(c for c in low if c.isalpha())


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class LanguageModel:
    """Trigram log odds by language, and the scripts of each language."""

    def __init__(self, grams: dict[str, Counter], scripts: dict[str, Counter]):
        self.languages = sorted(grams, key=lambda x: (-sum(scripts[x].values()), x))
        totals = [sum(grams[x].values()) for x in self.languages]
        every = sorted(set().union(*grams.values())) if grams else []
        # row 0 is for unknown trigrams
        self.index = {gram: i + 1 for i, gram in enumerate(every)}
        self.table = np.zeros((len(every) + 1, len(self.languages)))
        for j, (x, t) in enumerate(zip(self.languages, totals, strict=True)):
            self.table[1:, j] = np.log((np.array([grams[x][gram] for gram in every]) + 0.5) / (t + 0.5 * len(every)))
        if self.languages:
            self.table -= self.table.max(axis=1, keepdims=True)
        self.key = uuid.uuid4().hex
        names = {s for _, s in SCRIPTS}
        self.uses = {s: np.array([scripts[x][s] >= SCRIPT_SHARE * sum(scripts[x].values()) for x in self.languages], dtype=bool) for s in names}

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, 0 for the best, and their numbers of letters."""
        own = list(map(letters, tokens))
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        total = np.zeros((len(own), len(self.languages)))
        spoken = np.flatnonzero(sizes)
        if not len(spoken) or not self.languages:
            return total, sizes
        get, rows, at = self.index.get, [], []
        for i in spoken.tolist():
            padded, size = f"^{own[i]}$", int(sizes[i])
            for lo in range(0, size, TRIGRAMS_AT_ONCE):  # more than one turn for a very long word
                part = range(lo, min(lo + TRIGRAMS_AT_ONCE, size))
                at.append((i, len(rows)))
                rows += [get(padded[j : j + 3], 0) for j in part]
                if len(rows) >= TRIGRAMS_AT_ONCE:
                    self._add(total, rows, at)
        if rows:
            self._add(total, rows, at)
        ranges: dict[str, list[int]] = {}
        for i in spoken.tolist():
            char = own[i][0]
            ranges.setdefault("latin" if char < FIRST_OTHER else script(char), []).append(i)
        for name, at in ranges.items():
            candidates = self.uses[name]
            if candidates.any() and not candidates.all():
                total[np.ix_(at, ~candidates)] = -np.inf
        total[spoken] = np.maximum(total[spoken] - total[spoken].max(axis=1, keepdims=True), -WORST_WORD)
        return total, sizes


    def _add(self, total: np.ndarray, rows: list[int], at: list[tuple[int, int]]) -> None:
        """Add the sums of stretches of trigram rows to their words, and empty the lists."""
        words, starts = np.array(at).T
        np.add.at(total, words, np.add.reduceat(self.table[rows], starts))
        rows.clear()
        at.clear()


class Labeller:
    """Labels the words of texts; remembers the scores of recent words in bounded memory."""

    def __init__(self, model: LanguageModel, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty, self.many = model, penalty, len(model.languages)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.scores, self.sizes = np.zeros((1024, self.many), dtype=np.float32), np.zeros(1024, dtype=np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.place)
        self.chars += sum(map(len, new))
        if (len(self.place) + len(new) > KEPT_WORDS or self.chars > KEPT_CHARS) and self.place:
            self._forget()
            return self._rows(words)
        while len(self.place) + len(new) > len(self.sizes):
            self.scores, self.sizes = np.concatenate((self.scores, np.zeros_like(self.scores))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        if new:
            at = len(self.place)
            fresh = list(new)
            self.scores[at : at + len(fresh)], self.sizes[at : at + len(fresh)] = self.model.words(fresh)
            self.place.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [(self.scores[rows], self.sizes[rows]) for part in slices(text) if len(rows := self._rows(part.split()))]
        if not parts:
            return np.zeros((0, self.many), dtype=np.float32), np.zeros(0, dtype=np.int64)
        return np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts])

    def _single(self, scores: np.ndarray, best: int) -> bool:
        """Whether no stretch of words prefers another language by more than half the penalty."""
        run = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.vstack((np.zeros(self.many), run)), axis=0)[:-1]
        return bool((run - low).max() <= self.penalty / 2)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per text: language, score, spans (first word, end, language)."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        hard: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, text in enumerate(texts):
            scores, sizes = self._words(text) if text and self.many else (np.zeros((0, self.many)), np.zeros(0))
            if not sizes.sum():
                continue
            best = int(scores.sum(axis=0, dtype=np.float64).argmax())
            if self._single(scores, best):
                out[i] = self._verdict(scores, sizes, np.array([0, len(sizes)]), np.array([best]))
            else:
                hard.append((i, scores, sizes))
        hard.sort(key=lambda x: len(x[2]))
        while hard:
            most = len(hard[0][2])
            take = 1
            while take < len(hard) and (take + 1) * len(hard[take][2]) <= 1_000_000 and len(hard[take][2]) <= 2 * most:
                take += 1
            group, hard = hard[:take], hard[take:]
            for (i, scores, sizes), path in zip(group, viterbi([s for _, s, _ in group], self.penalty), strict=True):
                cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
                out[i] = self._verdict(scores, sizes, cut, path[cut[:-1]])
        return out

    def _verdict(self, scores, sizes, cut, labels) -> tuple[str, float, list[tuple[int, int, str]]]:
        total = np.bincount(labels, weights=np.add.reduceat(sizes, cut[:-1]), minlength=self.many)
        best = int(total.argmax())
        own = np.zeros(len(sizes), dtype=bool)
        for a, b, k in zip(cut[:-1], cut[1:], labels, strict=True):
            own[a:b] = k == best
        odds = scores[own].sum(axis=0, dtype=np.float64)
        sure = 1.0 / np.exp(np.clip(odds - odds[best], -700, 30)).sum()
        names = self.model.languages
        spans = [(int(a), int(b), names[k]) for a, b, k in zip(cut[:-1], cut[1:], labels, strict=True)]
        return names[best], float(min(1.0, sure) * total[best] / total.sum()), spans


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label sequence of each score matrix (words by languages); of equal paths one stays with its language, then takes the first."""
    lens = np.array([len(s) for s in scores])
    order = np.argsort(-lens, kind="stable")
    longest, many = int(lens.max()), scores[0].shape[1]
    grid = np.zeros((longest, len(scores), many), dtype=np.float32)
    for j, i in enumerate(order):
        grid[: lens[i], j] = scores[i]
    ends = lens[order]
    stay = np.zeros(grid.shape, dtype=bool)
    leader = np.zeros(grid.shape[:2], dtype=np.int16)
    now = grid[0].astype(np.float64)
    alive = np.searchsorted(-ends, -np.arange(longest), side="left")  # documents longer than t come first
    for t in range(1, longest):
        n = alive[t]
        own = now[:n]
        leader[t, :n] = own.argmax(axis=1)
        jump = own.max(axis=1)[:, None] - penalty
        stay[t, :n] = own >= jump
        now[:n] = grid[t, :n] + np.maximum(own, jump)
    label = np.zeros(grid.shape[:2], dtype=np.int16)
    last = now.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        label[t, :n] = last[:n]
        if t:
            last[:n] = np.where(stay[t, np.arange(n), last[:n]], last[:n], leader[t, :n])
    paths: list[np.ndarray] = [np.zeros(0)] * len(scores)
    for j, i in enumerate(order):
        paths[i] = label[: lens[i], j].astype(np.int64)
    return paths


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows of ``docs`` with text and language."""
    spark = docs.sparkSession
    ready_for_python(spark)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()

    def count(batches):
        words: dict[str, Counter] = {}

        def flush():
            kinds, langs, names, counts = [], [], [], []
            for language, seen in words.items():
                grams: dict[str, int] = {}
                ranges: dict[str, int] = {}
                for token, n in seen.items():
                    own = letters(token)
                    padded = f"^{own}$"
                    for i in range(len(own)):
                        gram = padded[i : i + 3]
                        grams[gram] = grams.get(gram, 0) + n
                    others = [c for c in own if c >= FIRST_OTHER] if not own.isascii() else ()
                    ranges["latin"] = ranges.get("latin", 0) + n * (len(own) - len(others))
                    for char in others:
                        name = script(char)
                        ranges[name] = ranges.get(name, 0) + n
                for kind, found in (("gram", grams), ("script", ranges)):
                    kinds += [kind] * len(found)
                    langs += [language] * len(found)
                    names += list(found)
                    counts += list(found.values())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["kind", "lang", "name", "n"])

        for batch in batches:
            for value, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in slices(value):
                    words.setdefault(language, Counter()).update(part.split())
                if len(value) > KEPT_CHARS:  # it may hold words of millions of letters
                    yield flush()
            if sum(map(len, words.values())) > KEPT_WORDS:
                yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "kind string, lang string, name string, n long").groupBy("kind", "lang", "name").agg(F.sum("n").alias("n"))
    counts = written(counts, "trigrams")
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), ["kind", "lang"]).where((F.col("kind") == "script") | (F.col("n") >= LEAST_SHARE * F.col("total")))
    grams: dict[str, Counter] = {}
    scripts: dict[str, Counter] = {}
    for r in kept.select("kind", "lang", "name", "n").collect():
        (grams if r.kind == "gram" else scripts).setdefault(r.lang, Counter())[r.name] = r.n
    drop_written(counts)
    return LanguageModel(grams, {k: scripts.get(k, Counter()) for k in grams})


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``lang_score`` and, if asked for, ``lang_spans`` (of word numbers, half-open)."""
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())] + [T.StructField("lang_spans", SPANS)] * spans
    docs = docs.drop(*(f.name for f in new))
    at = docs.columns.index(text)

    def scan(batches):
        labeller = per_worker(("labeller", shared.value.key), lambda: Labeller(shared.value))
        for batch in batches:
            found = labeller.label(batch.column(at).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                columns.append(pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in x[2]] for x in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *new]))


def language_predictions(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``; learned from the rows that aren't held out."""
    model = train(docs.where(~held_out("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return with_language(rows, model, spans=False).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
