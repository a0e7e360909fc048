"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

What is compared with the templates are a file's units: each line, each block (consecutive lines with words), the header (the
comment lines at its top) and, in a file that is named like a licence file, the whole text. Terms are runs of ASCII letters and digits,
lower-cased; a term weighs its count times ln((1 + lines) / (1 + lines with it)) + 1 over the non-empty lines of all files. A unit's
licence is that of the nearest template if their cosine is ``LEAST_COSINE`` or more; a line with an SPDX tag states its licence, as a
cosine of 1. A file's own licence is that of its best unit. A file that is named like a licence file, or has a share of ``FILE_SHARE`` of
its words in licence units of one kind, speaks for its directory; a file without its own licence inherits from the nearest
directory above it, its own included, that has such a file.

A first pass counts the lines with each term (partial sums in every task). The second finds candidates: by Cauchy's inequality a
unit without any of the templates' ``needed`` terms cannot reach the threshold, nor can one that would miss it if all its
other words had the least weight of a term, which is 1. Words of candidates that no template has get their weights by a join with the counted
terms. Directories are resolved once each, by equality joins of their ancestor paths with the directories that have a licence.

Defined cases: a null or empty text has no licence of its own but may inherit; a null path has directory
null, gives nothing and inherits nothing; of equal cosines the smaller licence name wins, of several licence
files in a directory the smallest path; repeated rows get equal results; very long texts and lines are read whole, a line over 1 MB in
slices; an empty table gives an empty result; other columns of the input are kept, whatever their names, but those
with names of the result's columns, which are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from math import log, sqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import as_bytes, byte_slices, drop_written, ready_for_python, written
from tidelog.llm.licence_texts import TEMPLATES

LEAST_COSINE = 0.6
FILE_SHARE = 1 / 3
#: Names of files that speak for their directory.
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
#: Beginnings of comment lines, and SPDX tags (patterns for Python, Java and RE2 alike).
COMMENT = r"^[ \t]*(#|//|/[*]|[*]|--|;|%|<!--)"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9][a-z0-9.+-]*)"
LINE, BLOCK, HEADER, WHOLE = range(4)
KEPT_TERMS = 500_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_COMMENT, _SPDX, _NAMED = re.compile(COMMENT.encode()), re.compile(SPDX.encode()), re.compile(LICENCE_NAME)
UNITS = "array<struct<kind int, name string, x double, known double, words long, rest_key string, rest array<struct<term string, n long>>>>"


def terms(line: bytes) -> list[bytes]:
    return line.translate(FOLD).split()


def bag(lines: list[bytes]) -> Counter:
    """Counts of the terms of some lines."""
    out: Counter = Counter()
    for line in lines:
        for part in byte_slices(line):
            out.update(terms(part))
    return out


class TemplateIndex:
    """Template vectors by term, and the terms without which no unit reaches the threshold."""

    def __init__(self, templates: list[tuple[str, str]], lines: int, lines_with: dict[bytes, int], least: float):
        self.least = least
        counted = [(name, Counter(terms(text.encode()))) for name, text in templates]
        self.idf = {t: log((1 + lines) / (1 + lines_with.get(t, 0))) + 1 for _, c in counted for t in c}
        lengths = [sqrt(sum((n * self.idf[t]) ** 2 for t, n in sorted(c.items()))) for _, c in counted]
        vectors = [{t: n * self.idf[t] for t, n in c.items()} for _, c in counted]
        common: set[bytes] = set()
        for t in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            if any(sqrt(sum(w * w for x, w in v.items() if x in common or x == t)) >= 0.999 * least * n for v, n in zip(vectors, lengths, strict=True)):
                break
            common.add(t)
        self.needed = frozenset(self.idf) - common
        self.posted: dict[bytes, list[tuple[int, float]]] = {}  # by term: templates and their weights as unit vectors
        for i, (v, n) in enumerate(zip(vectors, lengths, strict=True)):
            for t, w in v.items():
                self.posted.setdefault(t, []).append((i, w / n))
        self.names = [name for name, _ in counted]

    def candidate(self, kind: int, counts: Counter) -> tuple | None:
        """A unit that may reach the threshold: its best template's share of the cosine and what the length still lacks."""
        score = [0.0] * len(self.names)
        known, rest = 0.0, []
        for t, n in counts.items():
            if (idf := self.idf.get(t)) is None:
                rest.append((t, n))
                continue
            known += (n * idf) ** 2
            for i, w in self.posted[t]:
                score[i] += n * idf * w
        x, name = max(zip(score, self.names, strict=True), key=lambda s: (round(s[0], 9), [-ord(c) for c in s[1]]))
        if x < 0.999 * self.least * sqrt(known + sum(n * n for _, n in rest)):
            return None
        rest.sort()
        key = xxhash.xxh128_hexdigest(b" ".join(b"%b %d" % r for r in rest)) if rest else None
        return kind, name, x, known, counts.total(), key, [(t.decode(), n) for t, n in rest] or None

    def scan(self, path: str | None, text: bytes) -> tuple[int, list[tuple]]:
        """Words of a text and its candidate units."""
        lines = text.split(b"\n")
        hot, sizes, out = [], [], []
        for i, line in enumerate(lines):
            some, size = False, 0
            for part in byte_slices(line):
                own = terms(part)
                size += len(own)
                some = some or not self.needed.isdisjoint(own)
            sizes.append(size)
            if some:
                hot.append(i)
                out.append(self.candidate(LINE, bag([line])))
                for tag in _SPDX.findall(line):
                    out.append((LINE, tag.decode(), 1.0, 1.0, size, None, None))
        done = -1
        for i in hot:
            if i > done:
                a = done = i
                while a and sizes[a - 1]:
                    a -= 1
                while done + 1 < len(lines) and sizes[done + 1]:
                    done += 1
                out.append(self.candidate(BLOCK, bag(lines[a : done + 1])))
        if hot:
            top = next((i for i, line in enumerate(lines) if sizes[i] and not _COMMENT.match(line)), len(lines))
            if hot[0] < top:
                out.append(self.candidate(HEADER, bag(lines[:top])))
            if path and _NAMED.match(path.rsplit("/", 1)[-1]):
                out.append(self.candidate(WHOLE, bag(lines)))
        return sum(sizes), [u for u in out if u]


def _line_counts(files: DataFrame, at: int) -> DataFrame:
    """Lines of all files that hold each term, and under the empty term the non-empty lines."""

    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for line in (text or b"").split(b"\n"):
                    own: set[bytes] = set()
                    for part in byte_slices(line):
                        own.update(terms(part))
                    if own:
                        own.add(b"")
                        seen.update(own)
            if len(seen) > KEPT_TERMS:
                yield flush()
        yield flush()

    return files.select(files.columns[at]).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """A written table of ``files`` (the last two columns are path and text) without the text, with ``own_license``, ``cosine`` and ``__mostly``."""
    spark = files.sparkSession
    at = len(files.columns) - 1
    counts = written(_line_counts(files, at), "terms")
    asked = spark.createDataFrame([(t.decode(),) for t in {b"", *(t for _, x in templates for t in terms(x.encode()))}], "term string")
    lines_with = {r.term.encode(): r.n for r in counts.join(F.broadcast(asked), "term").collect()}  # a row for each term of the templates
    lines = lines_with.pop(b"", 0)
    index = spark.sparkContext.broadcast(TemplateIndex(templates, lines, lines_with, least))
    kept = files.schema.names[:at]

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("name", pa.string()), ("x", pa.float64()), ("known", pa.float64()), ("words", pa.int64()), ("rest_key", pa.string()), ("rest", pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))]))
        names, rests = ["kind", "name", "x", "known", "words", "rest_key", "rest"], ["term", "n"]
        run, number = uuid.uuid4().hex, 0
        for batch in batches:
            found = [index.value.scan(p, t) if t else (0, []) for p, t in zip(batch.column(at - 1).to_pylist(), as_bytes(batch.column(at)), strict=True)]
            units = [[dict(zip(names, (*u[:6], [dict(zip(rests, r, strict=True)) for r in u[6]] if u[6] else None), strict=True)) for u in own] for _, own in found]
            rows = [f"{run}{number + i}" for i in range(len(found))]
            number += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(rows, pa.string()), pa.array([n for n, _ in found], pa.int64()), pa.array(units, kind)], names=[*kept, "__row", "__words", "__units"])

    # Written before it is used: a row's name is made anew by every attempt.
    scanned = written(files.mapInArrow(scan, files.drop(files.columns[at]).schema.add("__row", "string").add("__words", "long").add("__units", T.DataType.fromDDL(UNITS))), "scanned")
    units = scanned.where(F.size("__units") > 0).select("__row", "__words", F.explode("__units").alias("u")).select("__row", "__words", "u.*")
    rest = units.where("rest_key is not null").groupBy("rest_key").agg(F.first("rest").alias("rest")).select("rest_key", F.explode("rest").alias("t")).select("rest_key", "t.term", F.col("t.n").alias("own"))
    weight = F.col("own") * (F.log(F.lit(1.0 + lines) / (1 + F.col("n"))) + 1)
    lengths = rest.join(counts, "term").groupBy("rest_key").agg(F.sum(weight * weight).alias("length"))
    cosine = F.round(F.col("x") / F.sqrt(F.col("known") + F.coalesce("length", F.lit(0.0))), 6)
    near = units.join(lengths, "rest_key", "left").withColumn("cosine", cosine).where(F.col("cosine") >= least)
    kinds = near.groupBy("__row", "kind").agg(F.sum("words").alias("inside"), F.max("__words").alias("words"), F.min(F.struct((-F.col("cosine")).alias("minus"), "name")).alias("best"))
    best = kinds.groupBy("__row").agg(F.max("inside").alias("inside"), F.max("words").alias("words"), F.min("best").alias("best"))
    best = best.select("__row", F.col("best.name").alias("own_license"), (-F.col("best.minus")).alias("cosine"), (F.col("inside") >= FILE_SHARE * F.col("words")).alias("__mostly"))
    found = written(scanned.drop("__units", "__words").join(best, "__row", "left").drop("__row"), "licences")
    drop_written(scanned)
    drop_written(counts)
    return found


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE, path: str = "path", text: str = "text") -> DataFrame:
    """Per file: the other columns, ``path``, ``directory``, ``own_license``, ``cosine``, ``license``, ``inherited_from``, ``origin`` (own, inherited or none)."""
    ready_for_python(files.sparkSession)
    made = {"path", "directory", "own_license", "cosine", "license", "inherited_from", "origin"}
    others = [c for c in files.columns if c not in (path, text) and c.lower() not in made]
    inner = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)]
    files = files.select(*inner, F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    scanned = own_licences(files, templates, least).withColumn("directory", F.regexp_extract("path", "^(.*/)?", 0))

    speaks = F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("__mostly") | F.rlike(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENCE_NAME)))
    sources = scanned.where(speaks).groupBy("directory").agg(F.min_by("own_license", F.struct("path", "own_license")).alias("license")).withColumnRenamed("directory", "source")
    # a/b/ has the ancestors a/b/, a/ and the empty path
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    asks = scanned.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select("directory").distinct()
    nearest = asks.select("directory", F.explode(above).alias("source")).join(sources, "source")
    found = nearest.groupBy("directory").agg(F.max_by(F.struct("source", "license"), F.length("source")).alias("up"))
    found = written(found.select(F.col("directory").alias("of"), F.col("up.source").alias("inherited_from"), F.col("up.license").alias("from_above")), "nearest")

    joined = scanned.join(found, (F.col("directory") == F.col("of")) & F.col("own_license").isNull(), "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("from_above").isNotNull(), "inherited").otherwise("none")
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(others)]
    return joined.select(*back, "path", "directory", "own_license", "cosine", F.coalesce("own_license", "from_above").alias("license"), "inherited_from", origin.alias("origin"))
