"""Token counts by dynamic programming over a trie of pre-tokens.

Every document's text is segmented by the best path of a unigram model; the count of a document is
the sum of the counts stored at its pre-tokens' terminal nodes. Distinct pre-tokens are inserted in
a trie, the forward score of a shared prefix is computed once, and the terminal counts are kept for
later batches in a table of bounded size. Pre-tokens over ``LONG`` characters are counted by themselves, a window at a time, and
only short ones are remembered, so a text of one unbroken run needs little more memory than the text. No shuffle.

Defined cases: a null or empty text has no tokens; of equally good segmentations the one with the longest last piece counts; a repeated row gives a repeated result; an empty
table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import per_worker, ready_for_python
from tidelog.llm.lattice import LONG, SHORT, TOKEN, Run, loaded, slices, tries

KEPT_TOKENS, GROUP_TOKENS, GROUP_CHARS = 400_000, 1_000_000, 8_000_000
SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


def counter(proto: bytes):
    """Function from texts to (pre-token counts, token counts), with a bounded memory of pre-tokens."""
    model = loaded(proto)
    known: dict[str, int] = {}

    def piece_counts(tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(known)
        if len(known) + len(new) > KEPT_TOKENS:
            known.clear()
            new = set(tokens)
        runs = {t for t in new if len(t) > LONG}
        own = {t: Run(model, t).count() for t in runs}
        for words, trie in tries(model, new - runs):
            own.update(zip(words, trie.counts()[trie.term].tolist(), strict=True))
        known.update(own)
        found = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        for t in own:
            if len(t) > SHORT:  # not remembered
                del known[t]
        return found

    def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words, pieces = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        tokens: list[str] = []
        owners: list[tuple[int, int]] = []

        def close() -> None:
            if tokens:
                row, many = np.array(owners).T
                ends = np.cumsum(many)
                total = np.concatenate(([0], np.cumsum(piece_counts(tokens))))
                np.add.at(words, row, many)
                np.add.at(pieces, row, total[ends] - total[ends - many])
                tokens.clear()
                owners.clear()

        chars = 0
        for i, text in enumerate(texts):
            if text:
                for part in slices(" " + text):
                    found = TOKEN.findall(part)
                    tokens.extend(found)
                    owners.append((i, len(found)))
                    chars += len(part)
                    if len(tokens) > GROUP_TOKENS or chars > GROUP_CHARS:
                        close()
                        chars = 0
        close()
        return words, pieces

    return count


def token_counts(docs: DataFrame, proto: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every row of ``docs``; ``proto``: a sentencepiece model's bytes."""
    spark = docs.sparkSession
    ready_for_python(spark)
    shared = spark.sparkContext.broadcast(proto)

    def scan(batches):
        count = per_worker(("counter", hash(shared.value)), lambda: counter(shared.value))
        for batch in batches:
            words, pieces = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pieces)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
