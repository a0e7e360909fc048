"""Token-id files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A corpus is a set of shards in document order. Shard k has

* ``.bin``: the ids of its documents, one after another, little-endian, 2 bytes an id if the
  vocabulary fits, else 4;
* ``.idx``: little-endian unsigned 64-bit offsets into ``.bin`` in ids, one more than documents;
* ``.doc``: little-endian signed 64-bit document ids (the smallest such number stands for null).

Global positions are a shard's base plus its own offsets; bases are prefix sums of the shards' sizes.

The text is range-partitioned by document id, with a hash of the text and a row's place in its input as further keys, so that
one id or one repeated row with a third of all rows is spread over partitions, and sorted; there are enough ranges for about
``SHARD_BYTES`` of input each. A task tokenises its range
and writes one shard under a name of its own attempt. The list of shards is the result of that job, so
what a lost or repeated attempt leaves behind is never read.

Defined cases: null and empty texts have only the end id; rows are in the order of document id (null
first), then of the text's hash, so repeated rows are adjacent; a very long text goes through the tokenizer in
slices of about 1 MB, a run without spaces in pieces of about 64 kB, if it has a digit or mark to cut at; an empty table gives no shards and an
empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import as_bytes, byte_slices, drop_path, input_bytes, mapped, open_output, per_worker, ready_for_python
from tidelog.session import shared_path

END_ID = 1
KEPT_CHUNKS = 800_000
GROUP_BYTES = 4 << 20
SHARD_BYTES = 256 << 20
GROUP_WORDS, LONG_CHUNK, CUT_FROM = 1000, 200, 1 << 16
NULL_ID = -(2**63)
SHARDS = "shard int, path string, id_bytes int, n_docs long, n_tokens long, doc_base long, token_base long"
#: ASCII letters and digits; a stop or comma after one is a pre-token by itself, unless another mark follows.
ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Where a very long chunk may be cut: at ASCII digits, each a pre-token by itself, before or after marks that no contraction starts with, after
#: ideographic commas and stops before an ideograph.
CUT = re.compile(rb"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9;!?()\[\]{}=+*/])|(?<=[;!?()\[\]{}=+*/])(?=[A-Za-z0-9])|(?<=\xe3\x80[\x81\x82])(?=[\xe5-\xe9])|(?<=\xef\xbc\x8c)(?=[\xe5-\xe9])")
MARKS = b".,;:!?\"'()[]{}*%$&#-_/|"


def folded(text: bytes, gap: np.ndarray) -> np.ndarray:
    """ASCII lower-cased, chunks in which a capital may compose with a mark left as they are; ``gap``: where ``text`` has white space.

    A mark may be any character from U+0300 on, as none before it is one.
    """
    raw, lower = np.frombuffer(text, dtype=np.uint8), np.frombuffer(bytearray(text.lower()), dtype=np.uint8)
    at = np.flatnonzero((raw[1:] >= 0xCC) & (raw[:-1] <= ord("Z")) & (raw[:-1] >= ord("A")))
    if len(at):
        gaps = np.concatenate(([-1], np.flatnonzero(gap), [len(raw)]))
        after = np.unique(np.searchsorted(gaps, at))
        for i, j in zip((gaps[after - 1] + 1).tolist(), gaps[after].tolist(), strict=True):
            lower[i:j] = raw[i:j]
    return lower


class Encoder:
    """Ids of whole texts by a word-wise tokenizer of the tokenizers library.

    The tokenizer's rules never look across a space or line feed: white space is only removed, and
    neither composition nor lower-casing nor its pattern crosses it. So a text's ids are those of its
    space-separated chunks, and a chunk is encoded once for as long as it is remembered. Many texts are cut into chunks at once, by
    arrays, and only their distinct chunks are looked up. What no lookup met while half of ``KEPT_CHUNKS`` were learnt is forgotten. ASCII is lower-cased
    first, but in chunks where a mark may compose with a capital: the tokenizer composes before it
    lower-cases. Encoding a word and the ASCII punctuation after it apart changes nothing, as
    the pattern never joins letters or digits with it. Only special tokens are spelled otherwise, so
    chunks with ``<|`` are encoded as they are. New words of letters are encoded many at once, and told apart
    by the ids that end a word.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.word_end[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember the ids of all chunks."""
        words = [c for c in chunks if len(c) <= LONG_CHUNK and (c.isalpha() or c.decode().isalpha())]
        parts = {c: self._halves(c) if len(c) <= CUT_FROM else tuple(self._pieces(c)) for c in set(chunks).difference(words)}
        new = {p for halves in parts.values() for p in halves}.difference(self.known, words)
        words += [c for c in new if len(c) <= LONG_CHUNK and (c.isalpha() or c.decode().isalpha())]
        new.difference_update(words)
        for at in range(0, len(words), GROUP_WORDS):
            group = words[at : at + GROUP_WORDS]
            ids = np.array(self._ids([b" ".join(group)])[0], dtype=self.dtype)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(group):  # each word is one pre-token, with one last id
                data, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                self.known.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                new.update(group)
        rest: list[bytes] = []
        for chunk in [*new, b""]:  # the empty one closes the last group
            if rest and (not chunk or len(rest) >= GROUP_WORDS or len(chunk) > LONG_CHUNK):
                self.known.update((c, array(self.code, ids).tobytes()) for c, ids in zip(rest, self._ids(rest), strict=True))
                rest = []
            rest += [chunk] if chunk else []
        self.known.update((c, b"".join(map(self.known.__getitem__, own))) for c, own in parts.items())
        for c in {p for c, own in parts.items() for p in own if len(p) > LONG_CHUNK and p not in parts}:
            del self.known[c]

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    @staticmethod
    def _pieces(chunk: bytes) -> Iterator[bytes]:
        """A very long chunk in pieces of at least ``CUT_FROM`` bytes; one without a place to cut stays whole."""
        at = 0
        while b"<|" not in chunk and (cut := CUT.search(chunk, at + CUT_FROM)):
            yield chunk[at : cut.start()]
            at = cut.start()
        yield chunk[at:]

    @staticmethod
    def _halves(chunk: bytes) -> tuple[bytes, bytes]:
        word = chunk.rstrip(MARKS)
        if b"<|" in chunk or len(word) in (0, len(chunk)):
            return chunk, b""
        last = chr(word[-1]) if word[-1] < 128 else word.decode()[-1]
        if not last.isalnum() or last == "İ":  # a mark, also one that lower-casing makes, would join what follows
            return chunk, b""
        return word, chunk[len(word) :]

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        new = [c for c in chunks if c not in self.known]
        if new:
            if 2 * (len(self.known) + len(new)) > KEPT_CHUNKS:
                self.older, self.known = self.known, {b"": b""}
                new = chunks
            self.known.update((c, self.older[c]) for c in new if c in self.older)
            new = [c for c in new if c not in self.known]
            self._learn(new)
        out = list(map(self.known.__getitem__, chunks))
        for c in new:
            if len(c) > LONG_CHUNK:  # not remembered
                del self.known[c]
        return out

    def _many(self, texts: list[bytes], special: bool) -> list[bytes]:
        """The ids of texts all with or all without the start of a special token."""
        joined = b" ".join([*texts, b""])
        raw = np.frombuffer(joined, dtype=np.uint8)
        gap = (raw == ord(" ")) | (raw == ord("\n"))
        own = ~gap
        start = own.copy()
        start[1:] &= gap[:-1]
        if not special:
            stop = (raw[1:-1] == ord(".")) | (raw[1:-1] == ord(","))
            stop &= gap[2:]
            stop &= ALNUM[raw[:-2]]
            start[1:-1] |= stop
            raw = folded(joined, gap)
        data = raw[own]
        cuts = np.append(np.flatnonzero(start[own]), len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._found(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        ends = np.cumsum([len(t) + 1 for t in texts])
        at = np.frombuffer(ids.buffers()[1], dtype=np.int32)[np.searchsorted(np.flatnonzero(start), ends)].tolist() if len(ids) else [0] * len(texts)
        out = memoryview(ids.buffers()[2] or b"")
        return [bytes(out[i:j]) for i, j in zip([0, *at], at, strict=False)]

    def encode(self, text: bytes | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of each text."""
        plain: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            special, long = b"<|" in text, len(text) > GROUP_BYTES
            if plain and (special or long or size + len(text) > GROUP_BYTES):
                yield from self._many(plain, False)
                plain, size = [], 0
            if special or long:
                yield b"".join(self._many([part], special)[0] for part in byte_slices(text))
            else:
                plain.append(text)
                size += len(text)
        if plain:
            yield from self._many(plain, False)


def write_token_files(docs: DataFrame, definition: bytes, path: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise ``docs`` and write the shards under ``path`` (a new folder in the shared one if not given).

    Returns the list of shards with their bases; ``definition`` is the tokenizer's JSON.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    path = path or shared_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(definition)

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, encoder, name = TaskContext.get().partitionId(), None, None
        sizes: list[np.ndarray] = []
        tail = b""
        for batch in batches:
            if not batch.num_rows:
                continue
            if name is None:
                encoder = per_worker(("encoder", hash(shared.value)), lambda: Encoder(shared.value))
                tail = np.array([end_id], dtype=encoder.dtype).tobytes()
                name = f"{path}/{part:06d}-{uuid.uuid4().hex}"
                ids, keys = open_output(f"{name}.bin"), open_output(f"{name}.doc")
            many = []
            for data in encoder.encode_all(as_bytes(batch.column(1))):
                many.append(len(data) // encoder.dtype.itemsize + 1)
                ids.write(data + tail)
            sizes.append(np.array(many, dtype=np.int64))
            keys.write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if name is not None:
            ids.close()
            keys.close()
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            with open_output(f"{name}.idx") as out:
                out.write(offsets.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [name], "id_bytes": pa.array([encoder.dtype.itemsize], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs, text) // SHARD_BYTES))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
    made = ordered.select("doc_id", "text").mapInArrow(write, "shard int, path string, id_bytes int, n_docs long, n_tokens long")
    shards, base = [], (0, 0)  # one short row for each task
    for r in sorted(made.collect(), key=lambda r: r.shard):
        shards.append((r.shard, r.path, r.id_bytes, r.n_docs, r.n_tokens, *base))
        base = (base[0] + r.n_docs, base[1] + r.n_tokens)
    return spark.createDataFrame(shards, SHARDS)


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document from the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    spark = shards.sparkSession

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                ids = mapped(f"{s['path']}.bin", f"<u{s['id_bytes']}")
                offsets = mapped(f"{s['path']}.idx", "<u8").astype(np.int64)
                keys = mapped(f"{s['path']}.doc", "<i8")
                for at in range(0, len(keys), 10_000):
                    cut = offsets[at : at + 10_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    own = keys[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(cut[:-1] + s["token_base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    many = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards.count()))
    return shards.repartition(many).mapInArrow(read, T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long"))


def delete_token_files(spark: SparkSession, shards: DataFrame) -> None:
    """Delete the folders that hold the shards."""
    for r in shards.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().collect():
        drop_path(spark, r.folder)
