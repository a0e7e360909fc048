"""Sampled sentencepiece segmentations and their lossless decoding.

Forward filtering, backward sampling over the piece lattice: the forward sums of every distinct
pre-token are computed over a shared trie, then a path is drawn from its terminal node back to the
root, edge by edge, by the exact conditional probabilities. The draws come from a counter-based
generator keyed by the row's key, the pre-token's place in the text and the step, so a row gets the
same segmentation in any batch, partition, attempt and cluster. No shuffle.

Encoding puts one space before the text, as the model's pieces expect; decoding takes it off.
Characters without a piece, and a literal U+2581, are spelled in byte pieces, so
``decode(encode(text)) == text`` for every text.

Pre-tokens over ``LONG`` characters are sampled by themselves, a window at a time, and never remembered, so a text of one unbroken
run needs memory of about its own size.

Defined cases: a null or empty text has no pieces and decodes to the empty text (null stays null in
:func:`with_pieces`); a null key draws as one fixed key; rows with equal key and text are encoded
alike; an empty table gives an empty result; columns of the input with the names of new columns are
replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import mix64, per_worker, ready_for_python
from tidelog.llm.lattice import LONG, TOKEN, PieceModel, Run, loaded, slices, tries

THETA, SEED = 1.0, 42
KEPT_TOKENS, KEPT_EDGES = 150_000, 1_000_000
GROUP_TOKENS, GROUP_CHARS = 100_000, 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Segments texts; keeps the lattices of recent pre-tokens in bounded memory."""

    def __init__(self, model: PieceModel, theta: float = THETA):
        self.model, self.theta = model, theta
        self._forget()

    def _forget(self) -> None:
        self.term: dict[str, int] = {}
        self.nodes = 0
        self.first = np.zeros(0, dtype=np.int32)
        self.cum, self.src, self.piece = np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _learn(self, tokens: list[str], new: set[str]) -> None:
        if len(self.term) + len(new) > KEPT_TOKENS or len(self.cum) > KEPT_EDGES:
            self._forget()
            new = set(tokens)
        first, cum, src, piece, edges = [self.first], [self.cum], [self.src], [self.piece], len(self.cum)
        for words, trie in tries(self.model, new):
            first.append((trie.ptr[:-1] + edges).astype(np.int32))
            edges += len(trie.dst)
            cum.append(trie.forward(self.theta))
            src.append(np.where(trie.src == 0, -1, trie.src + self.nodes).astype(np.int32))
            piece.append(trie.piece.astype(np.int32))
            self.term.update(zip(words, (trie.term + self.nodes).tolist(), strict=True))
            self.nodes += trie.nodes
        self.first, self.cum, self.src, self.piece = (np.concatenate(x) for x in (first, cum, src, piece))

    def _draws(self, key: np.ndarray):
        """The uniform numbers of one pre-token, step by step: those that :meth:`_draw` takes."""
        step = np.arange(1, 4097, dtype=np.uint64)
        while True:
            with np.errstate(over="ignore"):
                yield from ((mix64(key + step * GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            step += np.uint64(4096)

    def _run(self, word: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one long pre-token."""
        piece = Run(self.model, word).sample(self.theta, self._draws(key))
        return self._spelled(piece, np.array([len(piece)]))

    def _draw(self, tokens: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the tokens, one after another, and how many pieces each has."""
        if new := set(tokens).difference(self.term):
            self._learn(tokens, new)
        node = np.fromiter(map(self.term.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        live, steps = np.arange(len(tokens)), []
        while len(live):
            with np.errstate(over="ignore"):
                draw = mix64(key + np.uint64(len(steps) + 1) * GOLDEN)
            at = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            over = np.flatnonzero(self.cum[edge] <= at)
            while len(over):  # a node has few edges, the last of which ends at 1
                edge[over] += 1
                over = over[self.cum[edge[over]] <= at[over]]
            steps.append((live, self.piece[edge]))
            node = self.src[edge]
            more = node >= 0
            live, node, key = live[more], node[more], key[more]
        many = np.zeros(len(tokens), dtype=np.int64)
        for i, (who, _) in enumerate(steps):
            many[who] = i + 1
        last = np.cumsum(many) - 1
        out = np.zeros(int(many.sum()), dtype=np.int32)
        for i, (who, piece) in enumerate(steps):
            out[last[who] - i] = piece
        return self._spelled(out, many)

    def _spelled(self, piece: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(piece >= self.model.size)
        if not len(odd):
            return piece, many
        spelling = [chr(c).encode() for c in (piece[odd] - self.model.size).tolist()]
        width = np.ones(len(piece), dtype=np.int64)
        width[odd] = [len(x) for x in spelling]
        owner = np.repeat(np.arange(len(many)), many)
        out = np.repeat(piece, width)
        out[np.repeat(piece >= self.model.size, width)] = self.model.byte_id[np.frombuffer(b"".join(spelling), dtype=np.uint8)]
        return out, np.bincount(owner, weights=width, minlength=len(many)).astype(np.int64)

    def encode(self, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after another, and the number of pieces of each."""
        totals, ids = np.zeros(len(texts), dtype=np.int64), []
        tokens: list[str] = []
        owner: list[tuple[int, int, int]] = []

        chars = 0

        def close() -> None:
            if tokens:
                row, start, many = np.array(owner).T
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                with np.errstate(over="ignore"):
                    key = mix64(np.repeat(seeds[row], many) ^ mix64(place.astype(np.uint64) * GOLDEN + np.uint64(1)))
                owned = np.repeat(row, many)
                some = chars > LONG and any(len(t) > LONG for t in set(tokens).difference(self.term))  # long ones are never remembered
                long = [i for i, t in enumerate(tokens) if len(t) > LONG] if some else []
                at = 0
                for i in [*long, len(tokens)]:  # stretches of ordinary pre-tokens, and the runs between them
                    for own, made in ((slice(at, i), self._draw), (slice(i, i + 1), None)):
                        if not tokens[own]:
                            continue
                        piece, each = made(tokens[own], key[own]) if made else self._run(tokens[i], key[i])
                        ids.append(piece.astype(np.int32))
                        np.add.at(totals, owned[own], each)
                    at = i + 1
                tokens.clear()
                owner.clear()

        for i, text in enumerate(texts):
            place = 0
            for part in slices(" " + text) if text else ():
                found = TOKEN.findall(part)
                tokens.extend(found)
                owner.append((i, place, len(found)))
                place += len(found)
                chars += len(part)
                if len(tokens) > GROUP_TOKENS or chars > GROUP_CHARS:
                    close()
                    chars = 0
        close()
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), totals


def row_seeds(keys: pa.Array, seed: int = SEED) -> np.ndarray:
    """One 64-bit seed for each row key; null counts as one fixed key."""
    plain = np.array([0 if k is None else k for k in keys.to_pylist()], dtype=np.int64).astype(np.uint64)
    return mix64(mix64(plain + np.uint64(seed)) ^ np.uint64(seed) * np.uint64(3))


def with_pieces(docs: DataFrame, proto: bytes, theta: float = THETA, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``piece_ids`` array<int>, the sampled segmentation of ``text``."""
    return _mapped(docs, proto, theta, seed, key, text, "piece_ids", T.ArrayType(T.IntegerType()))


def decoded(docs: DataFrame, proto: bytes, pieces: str = "piece_ids", out: str = "decoded_text") -> DataFrame:
    """All columns of ``docs`` and ``out``, the text of the piece ids; null ids give null."""
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(proto)
    docs = docs.drop(out)
    at = docs.columns.index(pieces)

    def scan(batches):
        model = loaded(shared.value)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def _mapped(docs, proto, theta, seed, key, text, out, kind):
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(proto)
    docs = docs.drop(out)
    key_at, text_at = docs.columns.index(key), docs.columns.index(text)

    def scan(batches):
        sampler = per_worker(("sampler", hash(shared.value), theta), lambda: Sampler(loaded(shared.value), theta))
        for batch in batches:
            ids, many = sampler.encode(batch.column(text_at).to_pylist(), row_seeds(batch.column(key_at), seed))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def piece_digest(docs: DataFrame, proto: bytes, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Per document: ``n_pieces``, ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers, ``lossless`` (the decoded ids are the text)."""
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(proto)

    def scan(batches):
        model = loaded(shared.value)
        sampler = per_worker(("sampler", hash(shared.value), theta), lambda: Sampler(model, theta))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, many = sampler.encode(texts, row_seeds(batch.column(0), seed))
            ends = np.cumsum(many)
            crc, same = [], []
            for text, lo, hi in zip(texts, (ends - many).tolist(), ends.tolist(), strict=True):
                crc.append(zlib.crc32(ids[lo:hi].astype("<u4").tobytes()))
                same.append(model.spells(ids[lo:hi], text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
