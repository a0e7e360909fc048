"""Benchmark decontamination by n-gram windows.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased. A
window is ``WINDOW`` consecutive words of a benchmark item; an item with fewer words, but not none, is
one window. Every occurrence of a window in a document is a hit on the words it covers.

The benchmark's words become small integers, its windows rows of integers with a hash each, and the set
of them is broadcast. Its size is checked first: a benchmark over ``BROADCAST_BYTES`` is dealt by item
into as many parts as needed, written to the shared folder; a task takes about ``CHUNK_BYTES`` of documents at a time through one part after
another, so the documents are read once and memory follows one part and one chunk. A scan turns a batch of documents into
integers (0 for a word that no item has), finds the places with enough known words in a row, looks up
the hashes there and verifies each hit word by word. No shuffle.

Spans are cut once: words that meet over a cut are not scanned again.

Defined cases: null has no words; a very long text is read in slices and scanned whole; a document without words has no hits; items with null id or without
words are ignored; repeated items count once; an empty benchmark leaves all documents clean; an empty
table gives an empty result; columns of the input with the names of new columns are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import as_bytes, byte_slices, mapped, open_output, per_worker, ready_for_python
from tidelog.session import shared_path

WINDOW = 13
BROADCAST_BYTES, CHUNK_BYTES = 8 << 20, 64 << 20
CONTAMINATED_SHARE = 20  # one hit word in so many makes a document contaminated
#: ASCII letters lower-cased, digits and bytes from 0x80 kept, all else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowSet:
    """The windows of some items, by length: sorted hashes, the windows themselves and the items that have them."""

    def __init__(self, items: list[tuple[str, str]]):
        self.words: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text.encode())]
            n = min(WINDOW, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                windows.setdefault(n, {}).setdefault(tuple(ids[at : at + n]), set()).add(item)
        self.tables = []
        for n, found in sorted(windows.items()):
            rows = np.array(list(found), dtype=np.uint64)
            for salt in range(64):
                factors = np.random.default_rng(salt).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
                with np.errstate(over="ignore"):
                    hashes = (rows * factors).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
            else:
                raise ValueError("no hash separates the windows")
            order = np.argsort(hashes)
            owners = [tuple(sorted(x)) for x in found.values()]
            self.tables.append((n, factors, hashes[order], rows[order], [owners[i] for i in order]))

    def ids(self, text: bytes) -> np.ndarray:
        parts = []
        for part in byte_slices(text):
            words = words_of(part)
            parts.append(np.fromiter((self.words.get(w, 0) for w in words), dtype=np.uint64, count=len(words)))
        return np.concatenate(parts)

    def hits(self, ids: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, window length, rows of the window table) of all verified occurrences; zeros separate documents."""
        out = []
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for k, (n, factors, hashes, rows, _) in enumerate(self.tables):
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    value += ids[at + j] * factors[j]
            row = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[row] == value
            at, row = at[same], row[same]
            same = (ids[at[:, None] + np.arange(n)] == rows[row]).all(axis=1)
            if same.any():
                out.append((at[same], k, row[same]))
        return out

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: words, merged half-open spans of hit words, items."""
        gap = np.zeros(1, dtype=np.uint64)
        flat, sizes = [], []
        for text in texts:
            ids = self.ids(text) if text else gap[:0]
            flat += [ids, gap]
            sizes.append(len(ids))
        starts = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)))
        result = [(n, [], set()) for n in sizes]
        if not flat:
            return result
        ids = np.concatenate(flat)
        mark = np.zeros(len(ids) + 1, dtype=np.int64)
        for at, k, row in self.hits(ids):
            n, owners = self.tables[k][0], self.tables[k][4]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n, -1)
            for doc, r in set(zip((np.searchsorted(starts, at, side="right") - 1).tolist(), row.tolist(), strict=True)):
                result[doc][2].update(owners[r])
        hit = np.concatenate(([False], np.cumsum(mark[:-1]) > 0, [False]))
        edge = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        docs = np.searchsorted(starts, edge[:, 0], side="right") - 1
        for doc, (a, b) in zip(docs.tolist(), (edge - starts[docs][:, None]).tolist(), strict=True):
            result[doc][1].append((a, b))
        return result


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[Callable[[], WindowSet]]:
    """Loaders of the benchmark's parts: one broadcast, or files."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    if parts == 1:
        shared = spark.sparkContext.broadcast(WindowSet([(r.item, r.text) for r in items.distinct().collect()]))
        return [lambda: shared.value]
    folder, out = shared_path(spark, "benchmark"), []
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).distinct().collect()  # about ``limit`` bytes
        with open_output(f"{folder}/{k}") as file:
            file.write(pickle.dumps(WindowSet([(r.item, r.text) for r in own])))
        out.append(partial(_loaded, f"{folder}/{k}"))
    return out


def _loaded(path: str) -> WindowSet:
    return pickle.loads(mapped(path, np.uint8).tobytes())


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined up to a number of bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _found(batches, at: int, windows: list[Callable[[], WindowSet]]):
    """(batch, [(words, spans, items)]) of the texts in column ``at``, over all parts."""
    per_worker()
    for batch in batches if len(windows) == 1 else _chunks(batches, CHUNK_BYTES):
        texts = as_bytes(batch.column(at))
        found = windows[0]().scan(texts)
        for load in windows[1:]:
            more = load().scan(texts)
            found = [(n, _merged(a + b), i | j) if b else (n, a, i) for (n, a, i), (_, b, j) in zip(found, more, strict=True)]
        yield batch, found


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_hit``, ``spans`` (of word numbers, half-open) and ``items``."""
    ready_for_python(docs.sparkSession)
    windows = _windows(docs, benchmark, item_id, item_text, limit)
    docs = docs.drop(*(f.name for f in FOUND))
    at = docs.columns.index(text)

    def scan(batches):
        for batch, found in _found(batches, at, windows):
            spans = [s for _, s, _ in found]
            flat = [x for s in spans for x in s]
            cuts = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in (0, 1)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _, _ in found], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.ListArray.from_arrays(cuts, pairs), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))],
                names=[*batch.schema.names, *(f.name for f in FOUND)],
            )

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *FOUND]))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word in ``CONTAMINATED_SHARE`` is hit."""
    return (F.col(n_hit) > 0) & (CONTAMINATED_SHARE * F.col(n_hit) >= F.col(n_words))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the spans of words, from the first byte of a span's first word to the last of its last."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents; from the others, hit spans are cut out (``n_chars`` follows the text), in one pass over the documents."""
    ready_for_python(docs.sparkSession)
    windows = _windows(docs, benchmark, "item_id", "text", limit)
    names, at = docs.columns, docs.columns.index(text)

    def clean(batches):
        for batch, found in _found(batches, at, windows):
            keep = [i for i, (n, spans, _) in enumerate(found) if not spans or CONTAMINATED_SHARE * sum(b - a for a, b in spans) < n]
            yield _cut(batch.take(pa.array(keep, pa.int64())), names, at, [found[i][1] for i in keep])

    return docs.mapInArrow(clean, docs.schema)


def _cut(batch: pa.RecordBatch, names: list[str], at: int, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """A batch of columns ``names`` with the spans cut from the texts in column ``at``."""
    columns = list(batch.columns)
    if any(spans):
        texts = [None if t is None else (without_spans(t, s) if s else t).decode() for t, s in zip(as_bytes(columns[at]), spans, strict=True)]
        columns[at] = pa.array(texts, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            columns[i] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, columns[i].to_pylist(), strict=True)], columns[i].type)
    return pa.RecordBatch.from_arrays(columns, names=names)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
