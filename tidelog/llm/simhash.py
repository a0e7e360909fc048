"""SimHash near-duplicates by one-wildcard segment variants.

A fingerprint bit is 1 if over half of a text's shingle hashes have it. To link fingerprints that
differ in at most k bits they are cut into ceil((k + 1) / 2) segments, half of what exact matching
needs: then one segment differs by at most one bit. Segment values are indexed under all their
one-wildcard variants and joined by equality of variants. The index holds distinct values of a segment,
so a bucket has two members at most, however common a value is.

A value that several distinct fingerprints have, or that has neighbours one bit apart, names a group: its
fingerprints, and those of rarer neighbours. A group is searched breadth first against what is not yet reached, each
link is verified on all bits, and only a spanning forest of the links leaves the task: no pairs within
a group of copies. A group over ``GROUP_LIMIT`` is dealt further by pieces of its other bits: of as many pieces more
than bits may differ as its size asks, every choice, as a linked pair shares at least that many pieces; so groups of any size are split without
losing a link. Links then go through distributed connected components.

:func:`without_near_copies` takes its candidates from fingerprints too, and then links two texts by the exact Jaccard similarity of their
shingle sets. At 0.8 two fingerprints differ in 15 of 100 bits, most of them bits that were nearly even. So in a segment the ``WEAK`` bits
of the closest votes are the wildcards, all at once, and there are as many segments as leave a chance of ``MISSED`` that a pair at the
threshold shares no variant of any. A shingle votes by a byte of its hash, not by a bit, as the votes of a few shingles would often be even.
Segments are as wide as the number of texts asks; texts that meet are candidates if 256 bits of their fingerprints are near enough, and
what candidates connect is compared as one group.

With ``max_distance`` above what the segments guarantee (2 * segments - 1 of the indexed bits), links up to
the guarantee are all found, and those beyond it if one segment is still within a bit.

Defined cases: a very long text is hashed a bounded number of shingles at a time; a null or empty text has no words and fingerprint zero, linked like any other; fewer
words than a shingle make one shingle; copies and repeated rows share a fingerprint; a null doc_id
never becomes a component's id unless all are null; an empty table gives an empty result; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import HashSet, as_bytes, byte_slices, drop_written, mix64, per_worker, ready_for_python, shielded, written
from tidelog.llm.components import connected_components

SEED = 42
GROUP_LIMIT, MOST_SHARED = 5000, 4
HASHES_AT_ONCE = 200_000
WEAK, MISSED = 3, 1e-6  # of near-dedup: wildcards of a segment, chance that a pair at the threshold is not named
SPARE_BITS, CHECK_BITS = 7, 256  # of a segment beyond the logarithm of the number of texts; compared where texts meet
SEGMENTS_AT_ONCE, SLICE_BYTES = 16, 16 << 20
HUB_TURNS, HUB_PAIRS = 3, 100
#: Members of a key that are compared in one task, by number and bytes of their sets; more are dealt in blocks.
BLOCK_NODES, BLOCK_BYTES = 400, 16 << 20


def _shingle_hashes(text: bytes, size: int):
    """Hashes of the shingles of a whole text, a bounded number at a time."""
    carry: list[bytes] = []
    seen = 0
    for part in byte_slices(text.lower()):
        carry += part.split()
        if len(carry) < size:
            continue
        grams = map(b" ".join, zip(*(carry[i:] for i in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(carry) - size + 1)
        seen += len(hashes)
        yield hashes
        carry = carry[len(carry) - size + 1 :]
    if not seen and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None, size: int, bits: int, distinct: bool) -> bytes:
    """Big-endian fingerprint; ``distinct`` counts a repeated shingle once. Bits beyond 64 come from a mix of the hash."""
    words = bits // 64
    ones, total = np.zeros((words, 64), dtype=np.int64), 0
    parts = _shingle_hashes(text, size) if text else ()
    if distinct:
        parts = list(parts)
        parts = [np.unique(np.concatenate(parts))] if parts else []
    for part in parts:
        for at in range(0, len(part), HASHES_AT_ONCE):
            own = part[at : at + HASHES_AT_ONCE]
            total += len(own)
            for k in range(words):
                with np.errstate(over="ignore"):
                    mixed = mix64(own + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) if k else own
                ones[k] += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total).tobytes()


def fingerprints(docs: DataFrame, size: int = 3, bits: int = 64, distinct: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and ``fp`` of every row."""
    ready_for_python(docs.sparkSession)

    def scan(batches):
        per_worker()
        for batch in batches:
            made = [fingerprint(t, size, bits, distinct) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "tie", "fp"])

    text = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(scan, "doc_id long, tie long, fp binary")


def _bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    edges = [round(i * bits / segments) for i in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), -1), axis=1)


def _values(bits: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Value of each segment (column) of each fingerprint (row)."""
    return np.stack([bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1)) for a, b in bounds], axis=1)


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (rows of 64-bit words), breadth first."""
    out, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1) <= most
            reached = left[near]
            out += [(at, x) for x in reached.tolist()]
            queue += reached.tolist()
            left = left[~near]
    return out


def _links(groups: DataFrame, most: int) -> DataFrame:
    """Forest edges of every group (group, fp), which come dealt and sorted by group."""

    def search(batches):
        kept_group, kept_fp = None, []

        def edges(fps: list[bytes]):
            fps = sorted(set(fps))
            words = np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(fps), -1)
            found = _forest(words, most)
            return [fps[a] for a, _ in found], [fps[b] for _, b in found]

        for batch in batches:
            if not batch.num_rows:
                continue
            group, fps = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if kept_fp:
                group, fps = np.concatenate((np.full(len(kept_fp), kept_group), group)), kept_fp + fps
            cut = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
            kept_group, kept_fp = group[-1], fps[cut[-2] :]
            size = np.diff(cut)[:-1]
            a, b = [], []
            two = cut[:-2][size == 2]
            if len(two):
                left = np.frombuffer(b"".join(fps[i] for i in two), dtype=np.uint64).reshape(len(two), -1)
                right = np.frombuffer(b"".join(fps[i + 1] for i in two), dtype=np.uint64).reshape(len(two), -1)
                near = two[np.bitwise_count(left ^ right).sum(axis=1) <= most]
                a += [fps[i] for i in near]
                b += [fps[i + 1] for i in near]
            for i in np.flatnonzero(size > 2):
                x, y = edges(fps[cut[i] : cut[i + 1]])
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        if kept_fp:
            a, b = edges(kept_fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(search, "a binary, b binary")


def _dealt_bits(rest: int, most: int, shared: int) -> int:
    """Bits that agree at least in a group that is dealt by ``shared`` of its pieces."""
    return shared * (rest // (most + shared)) if shared else 0


def near_edges(distinct_fps: DataFrame, indexed: int, max_distance: int, segments: int, group_limit: int = GROUP_LIMIT, most_shared: int = MOST_SHARED) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) among distinct fingerprints that connect whatever is within ``max_distance`` bits; the first ``indexed`` bits are cut into segments.

    Also the written tables behind the links, to be dropped once the links are used.
    """
    bounds = _bounds(indexed, segments)
    if max(b - a for a, b in bounds) > 32:
        raise ValueError("a segment may have 32 bits at most")

    def cut(batches):
        for batch in batches:
            fps = batch.column(0)
            if batch.num_rows:
                values = _values(_bits(fps.to_pylist()), bounds)
                for s in range(segments):
                    yield pa.RecordBatch.from_arrays([fps, pa.array(np.full(len(fps), s, dtype=np.int32)), pa.array(values[:, s])], names=["fp", "segment", "value"])

    parts = written(distinct_fps.select("fp").mapInArrow(cut, "fp binary, segment int, value long"), "segments")
    values = written(parts.groupBy("segment", "value").agg(F.count("*").alias("n")), "values")
    width = F.element_at(F.array(*(F.lit(b - a) for a, b in bounds)), F.col("segment") + 1)
    # Dealt evenly first, as each row becomes many; then by variant, so that no map task sums what hardly repeats.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wild = values.select("segment", "value").repartition(tasks).select("segment", "value", F.explode(F.sequence(F.lit(0), width - 1)).alias("place"))
    one = F.expr("shiftleft(1L, place)")
    key = F.expr("shiftleft(segment * 64L + place, 32)").bitwiseOR(F.col("value").bitwiseAND(F.bitwise_not(one)))
    # A variant has two values at most, told apart by the bit at the wildcard: 1 and 2 mark which are there.
    mark = F.when(F.col("value").bitwiseAND(one) == 0, 1).otherwise(2).cast("byte")
    both = wild.select(key.alias("variant"), mark.alias("mark")).repartition("variant").groupBy("variant").agg(F.bit_or("mark").alias("marks")).where("marks = 3")
    low = F.expr("variant & 4294967295L")
    apart = both.select(F.expr("cast(shiftright(variant, 38) as int)").alias("segment"), low.alias("a"), low.bitwiseOR(F.expr("shiftleft(1L, cast(shiftright(variant, 32) & 63 as int))")).alias("b"))
    # Of two values a bit apart, the fingerprints of the rarer one visit the group of the other: all pairs between
    # them meet there, and a common value is not repeated for each of its neighbours.
    apart = apart.join(values.select("segment", F.col("value").alias("a"), F.col("n").alias("n_a")), ["segment", "a"]).join(values.select("segment", F.col("value").alias("b"), F.col("n").alias("n_b")), ["segment", "b"])
    first = F.col("n_a") >= F.col("n_b")
    visits = written(apart.select("segment", F.when(first, F.col("b")).otherwise(F.col("a")).alias("value"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("target"), F.least("n_a", "n_b").alias("n"), F.greatest("n_a", "n_b").alias("own")), "visits")
    homes = visits.select("segment", F.col("target").alias("value"), "target", F.col("own").alias("n")).unionByName(values.where("n > 1").select("segment", "value", F.col("value").alias("target"), "n")).distinct()
    sized = written(visits.drop("own").unionByName(homes).withColumn("group", F.xxhash64("segment", "target")), "pairs")
    shared = F.lit(0)  # pieces that a group is dealt by
    for more in range(most_shared):
        shared = F.when(F.col("all") > group_limit << _dealt_bits(indexed - max(b - a for a, b in bounds), max_distance, more), more + 1).otherwise(shared)
    large = sized.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") > group_limit).select("group", shared.alias("shared"))
    members = written(sized.join(large, "group", "left").select("segment", "value", "group", F.coalesce("shared", F.lit(0)).alias("shared")), "members")
    grouped = parts.join(members, ["segment", "value"]).select("group", "fp", "segment", "shared")

    def deal(batches):
        for batch in batches:
            pieces = batch.column(3).to_numpy()
            small = np.flatnonzero(pieces == 0)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(small)) for c in batch.columns[:2]], names=["group", "fp"])
            if len(small) == len(pieces):
                continue
            segment, fps = batch.column(2).to_numpy(), batch.column(1)
            for s, many in {*zip(segment[pieces > 0].tolist(), pieces[pieces > 0].tolist(), strict=True)}:
                at = pa.array(np.flatnonzero((segment == s) & (pieces == many)))
                own, group = fps.take(at), batch.column(0).take(at).to_numpy().astype(np.uint64)
                rest = np.delete(_bits(own.to_pylist()), np.arange(*bounds[s]), axis=1)
                cuts = [np.packbits(rest[:, x:y], axis=1).astype(np.uint64) for x, y in _bounds(rest.shape[1], max_distance + many)]
                for chosen in itertools.combinations(range(len(cuts)), many):
                    new = group
                    with np.errstate(over="ignore"):
                        for p in chosen:
                            new = mix64(new + np.uint64(p + 1))
                            for column in cuts[p].T:
                                new = mix64(new * np.uint64(3) + column)
                    yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64)), own], names=["group", "fp"])

    dealt = grouped.mapInArrow(deal, "group long, fp binary")
    return _links(dealt, max_distance), [parts, values, visits, sized, members]


def near_components(prints: DataFrame, indexed: int = 64, max_distance: int = 3, segments: int | None = None) -> DataFrame:
    """(fp, component_id) of a written table of :func:`fingerprints`; the id is the smallest doc_id reachable."""
    segments = segments or -(-(max_distance + 1) // 2)
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    edges, behind = near_edges(own, indexed, max_distance, segments)
    roots = written(connected_components(edges, "a", "b"), "roots")
    named = written(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    found = written(named.join(ids, "root").select("fp", "component_id"), "components")
    for table in (*behind, own, roots, named, ids):
        drop_written(table)
    return found


def simhash_duplicates(docs: DataFrame, size: int = 3, max_distance: int = 3) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` in 16 hexadecimal digits, ``component_id``."""
    prints = written(fingerprints(docs, size), "prints")
    found = near_components(prints, 64, max_distance)
    return prints.join(found, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    parts = list(_shingle_hashes(text, size)) if text else []
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def votes(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Twice the votes for each bit of a shingle set's fingerprint, which is 1 where they are positive; a shingle votes -127.5 to 127.5."""
    turns = mix64(np.arange(1, bits // 8 + 1, dtype=np.uint64))
    sums = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(shingles), 128):
        own = mix64(shingles[at : at + 128, None] + turns).view(np.int8)
        sums += own.astype(np.int16).sum(axis=0, dtype=np.int16)
    return 2 * sums + len(shingles)


def segment_values(sums: np.ndarray) -> np.ndarray:
    """Value of each segment (the last axis holds votes for its bits), with the places of its weak bits above bit 32."""
    values = (sums > 0).astype(np.int64) @ (1 << np.arange(sums.shape[-1]))
    weak = np.argpartition(np.abs(sums), WEAK - 1, axis=-1)[..., :WEAK].astype(np.int64)
    return values | (weak << (32 + 5 * np.arange(WEAK))).sum(axis=-1)


def variants(values: np.ndarray) -> np.ndarray:
    """Values of a segment under all settings of its weak bits, along a new last axis."""
    made = (values & 0xFFFFFFFF)[..., None]
    for w in range(WEAK):
        made = np.concatenate((made, made ^ (1 << (values >> (32 + 5 * w) & 31))[..., None]), axis=-1)
    return made


def segments_needed(width: int, least: float, missed: float = MISSED) -> int:
    """Segments of ``width`` bits of which two sets at a Jaccard similarity of ``least`` share none with a chance of ``missed``, by drawing votes."""
    draw, cosine = np.random.default_rng(SEED), 2 * least / (1 + least)
    x, y = draw.standard_normal((2, 20_000, width))
    x, y = (variants(segment_values(v)) for v in (x, cosine * x + np.sqrt(1 - cosine * cosine) * y))
    found = np.any([(x == y[:, [i]]).any(axis=1) for i in range(y.shape[1])], axis=0).mean()
    return 1 if found == 1 else int(np.ceil(np.log(missed) / np.log1p(-found)))


def most_apart(least: float) -> int:
    """Bits of ``CHECK_BITS`` that two sets at a Jaccard similarity of ``least`` may differ in: 5.5 standard deviations beyond the mean."""
    chance = np.arccos(2 * least / (1 + least)) / np.pi
    return int(CHECK_BITS * chance + 5.5 * np.sqrt(CHECK_BITS * chance * (1 - chance)))


def _printed(docs: DataFrame, size: int, width: int, segments: int) -> DataFrame:
    """``id`` (0 if ``none``), ``tie``, ``node`` (a hash of the shingle set), ``segments`` (:func:`segment_values`) and ``bits`` of the fingerprint of every row."""
    many = -(-max(width * segments, CHECK_BITS) // 8) * 8

    def scan(batches):
        per_worker()
        for batch in batches:
            nodes, cut, bits = [], [], []
            for text in as_bytes(batch.column(3)):
                own = shingle_set(text, size)
                sums = votes(own, many)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                cut.append(segment_values(sums[: width * segments].reshape(segments, width)))
                bits.append(np.packbits(sums[:CHECK_BITS] > 0).tobytes())
            made = [pa.array(np.array(nodes, dtype=np.uint64).astype(np.int64)), pa.array(cut, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "none", "tie", "node", "segments", "bits"])

    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNull().alias("none"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(scan, "id long, none boolean, tie long, node long, segments array<long>, bits binary")


def _least_reached(many: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``many`` numbers reaches over the links (a, b)."""
    least = np.arange(many)
    while True:
        low, now = np.minimum(least[a], least[b]), least.copy()
        np.minimum.at(now, least[a], low)
        np.minimum.at(now, least[b], low)
        now = now[now]
        if np.array_equal(now, least):
            return least
        least = now


def _near_links(values: np.ndarray, rows: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints (rows of 64-bit words) within ``most`` bits of each other among the ``rows`` of each value."""
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    cut = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
    size = np.diff(cut)
    two = cut[:-1][size == 2]
    two = two[np.bitwise_count(fps[rows[two]] ^ fps[rows[two + 1]]).sum(axis=1, dtype=np.int64) <= most]
    a, b = [rows[two]], [rows[two + 1]]
    for i in np.flatnonzero(size > 2):
        own = rows[cut[i] : cut[i + 1]]
        found = np.array(_forest(fps[own], most), dtype=np.int64).reshape(-1, 2)
        a.append(own[found[:, 0]])
        b.append(own[found[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def _meetings(own: DataFrame, slices: int, first: int, last: int, most: int) -> DataFrame:
    """(a, b) that connect the nodes that share a variant of one of the segments from ``first`` to ``last`` and are within ``most`` bits; a is the smallest they reach.

    A segment's value is dealt once to each slice that holds variants of it, with the bits. Slices (a power of two) are told by the lowest bits of a
    variant, few of which are weak, so that is to one or two slices. Values go as packed arrays by segment and slice: a row is a batch's share.
    A part of a segment sends a row a node at most, however many variants the nodes of a group share.
    """
    kind = np.dtype([("node", "<i8"), ("value", "<i8"), ("bits", "<u8", CHECK_BITS // 64)])

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            each = np.zeros(batch.num_rows, dtype=kind)
            each["node"] = batch.column(0).to_numpy()
            each["bits"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
            cut = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for s in range(first, last):
                each["value"] = cut[:, s]
                part = np.sort(variants(cut[:, s]) & (slices - 1), axis=1)
                row, place = np.nonzero(np.insert(part[:, 1:] != part[:, :-1], 0, True, axis=1))
                part = part[row, place]
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=slices))
                some = [p for p in range(slices) if ends[p] > (ends[p - 1] if p else 0)]
                made = [each[row[order[ends[p - 1] if p else 0 : ends[p]]]].tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([pa.array([s * slices + p for p in some], pa.int64()), pa.array(made, pa.binary())], names=["part", "packed"])

    def search(batches):
        per_worker()
        at, kept = None, []

        def close():
            each = np.frombuffer(b"".join(kept), dtype=kind)
            kept.clear()
            each = each[np.argsort(each["node"])]
            values = variants(each["value"])
            row, place = np.nonzero(values & (slices - 1) == at % slices)
            a, b = _near_links(values[row, place], row, each["bits"], most)
            least = _least_reached(len(each), a, b)
            new = np.flatnonzero(least != np.arange(len(each)))
            return pa.RecordBatch.from_arrays([pa.array(each["node"][least[new]]), pa.array(each["node"][new])], names=["a", "b"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at and kept:
                    yield close()
                at = part
                kept.append(packed)
        if kept:
            yield close()

    dealt = own.select("node", "segments", "bits").mapInArrow(deal, "part long, packed binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(search, "a long, b long")


def near_members(own: DataFrame, least: float, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, node) of the nodes of ``own`` (a written table: node, segments, bits) that share a variant with another one near in bits, a row a node.

    Nodes that meet, and those that they meet, have one key: the smallest node of them. A written table. Segments are searched some at a time,
    so the disk holds the values of those only.
    """
    spark, size = own.sparkSession, own.agg(F.count("*").alias("nodes"), F.max(F.size("segments")).alias("segments")).first()
    slices = 1 << (-(-size.nodes * 8 * 2**WEAK // slice_bytes) - 1).bit_length() if size.nodes else 1
    passes = []
    for first in range(0, size.segments or 0, SEGMENTS_AT_ONCE):
        passes.append(written(_meetings(own, slices, first, min(first + SEGMENTS_AT_ONCE, size.segments), most_apart(least)).distinct(), "near"))
        spark.sparkContext._jvm.System.gc()  # Spark deletes a pass's shuffle files once nothing refers to them
    every = spark.createDataFrame([], "a long, b long")
    for one in passes:
        every = every.unionByName(one)
    found = written(connected_components(every, "a", "b").select(F.col("root").alias("key"), "node"), "near")
    for one in passes:
        drop_written(one)
    return found


def _row_hash(doc_id: str = "doc_id", text: str = "text"):
    """The hash of a row's id and text, as of their columns in :func:`_printed`."""
    own = F.col(doc_id).cast("long")
    return F.xxhash64(F.coalesce(own, F.lit(0).cast("long")), own.isNull(), F.xxhash64(F.col(text).cast("string")))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """Shingle sets of (node, text)."""

    def scan(batches):
        per_worker()
        for batch in batches:
            made = [shingle_set(t, size).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(scan, "node long, shingles binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more; an ``a`` of many pairs is dealt to many tasks."""
    many = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")).where("parts > 1"))
    part = F.coalesce("parts", F.lit(1))
    left = sets.withColumnsRenamed({"node": "a", "shingles": "x"}).join(many, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), part).cast("int").alias("part"))
    both = dealt.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").join(left, ["a", "part"]).select("a", "b", "x", "y")

    def compare(batches):
        per_worker()
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in (x, y))
                near.append(alike(x, y, least))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """A pair (hub, node) for each node that shares a key of more than ``BLOCK_NODES`` nodes with a hub of another component: the first of the key in this turn's order."""
    order = F.xxhash64("node", F.lit(turn))
    hubs = rows.groupBy("key").agg(F.min_by("node", order).alias("a"), F.min_by("root", order).alias("hub_root"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    hubs = hubs.where(f"low < high and n > {BLOCK_NODES}")
    return rows.join(hubs, "key").where("root != hub_root").select("a", F.col("node").alias("b"))


class SetGroup:
    """Shingle sets that are compared with one another: a pair is linked by its exact Jaccard similarity, and components grow as links are found.

    A bitmap of the parity of each set's shingles spares most comparisons: two bitmaps differ in no more bits than two sets in shingles.
    """

    def __init__(self, sets: list[np.ndarray], roots: list[int], least: float):
        self.sets, self.least = sets, least
        self.size = np.array([len(x) for x in sets])
        _, self.part = np.unique(np.array(roots, dtype=np.int64), return_inverse=True)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(self.size) + 1)), 10, 16))
        parity = [np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1) for x in sets]
        self.maps = np.stack(parity).view(np.uint64)

    def links(self, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
        """Links that join what is within the threshold, between the members ``first`` and ``second`` (by number); no more than members."""
        out = []
        share = (1 - self.least) / (1 + self.least)
        for i in first.tolist():
            other = second[second > i] if first is second else second
            other = other[self.part[other] != self.part[i]]
            n, m = self.size[i], self.size[other]
            other = other[np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-9]
            if not len(other):
                continue
            apart = np.bitwise_count(self.maps[other] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
            for j in other[apart <= share * (n + self.size[other]) + 1e-9].tolist():
                if self.part[i] != self.part[j] and alike(self.sets[i], self.sets[j], self.least):
                    self.part[self.part == self.part[j]] = self.part[i]
                    out.append((i, j))
        return out


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more; sets without elements are alike to none."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and shared / (len(x) + len(y) - shared) >= least


def _key_links(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) among the nodes of each key that are in different components (key, node, root); the links of a key are a forest.

    A key with many nodes is dealt in blocks, and each pair of blocks is searched by itself.
    """
    sized = rows.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    keys = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    keys = keys.select("key", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root")
    group = ["key", "lo", "hi"]
    ready = dealt.join(sets, "node").select(*group, "block", "node", "root", "shingles").repartition(*group).sortWithinPartitions(*group)

    def search(batches):
        per_worker()
        at, kept = None, []

        def close():
            blocks = np.array([r[0] for r in kept])
            found = SetGroup([np.frombuffer(r[3], dtype=np.uint64) for r in kept], [r[2] for r in kept], least)
            one, two = np.flatnonzero(blocks == at[1]), np.flatnonzero(blocks == at[2])
            pairs = found.links(one, one if at[1] == at[2] else two)
            ends = [pa.array([kept[p[i]][1] for p in pairs], pa.int64()) for i in (0, 1)]
            kept.clear()
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            for *own, block, node, root, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at and kept:
                    yield close()
                at = own
                kept.append((block, node, root, shingles))
        if kept:
            yield close()

    return ready.mapInArrow(search, "a long, b long")


def shingle_components(docs: DataFrame, own: DataFrame, size: int, least: float) -> DataFrame:
    """(node, root) of the nodes of ``own`` (a written table: node, id, none, tie, rows, segments, bits) linked to others; every link is verified on the shingle sets.

    Nodes of a large key (:func:`near_members`) are compared with a hub first, a hub a key and turn, which settles groups of near copies without their pairs.
    Nodes of a key that are then in different components are compared within a task, which emits a forest of the links.
    """
    members = near_members(own, least)
    rows = written(members.withColumn("root", F.col("node")), "members")
    drop_written(members)
    spoken = own.join(rows.select("node"), "node").select("node", F.col("id").alias("__id"), F.col("none").alias("__none"), F.col("tie").alias("__tie"), "rows")
    same = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("__id"), F.col("doc_id").cast("long").isNull() == F.col("__none"), F.xxhash64(F.col("text")) == F.col("__tie")]
    rows_of = HashSet(spoken.select(F.xxhash64("__id", "__none", "__tie"))).marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _row_hash(), "near").where("near")
    sets = written(_sets(rows_of.join(spoken, same).select("node", "text"), size), "sets")
    if not spoken.where("rows > 1").isEmpty():
        once = written(sets.dropDuplicates(["node"]), "sets")
        drop_written(sets)
        sets = once
    tried, links, behind = None, None, [sets]
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for turn in range(HUB_TURNS):
        pairs = _hub_pairs(rows, turn).withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
        pairs = written(pairs.join(tried, ["low", "high"], "left_anti") if tried else pairs, "pairs")
        behind.append(pairs)
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs.select("low", "high")) if tried else pairs.select("low", "high")
        found = written(_alike(pairs.select("a", "b"), sets, least), "links")
        behind.append(found)
        links = links.unionByName(found) if links else found
        roots = written(connected_components(links, "a", "b"), "roots")
        new = written(rows.drop("root").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "members")
        drop_written(rows)
        rows = new
    found = written(_key_links(rows, sets, least), "links")
    behind.append(found)
    if not found.isEmpty():
        roots = written(connected_components(links.unionByName(found) if links else found, "a", "b"), "roots")
    for table in (*behind, rows):
        drop_written(table)
    return roots


def without_near_copies(docs: DataFrame, size: int = 5, least: float = 0.8, width: int | None = None, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id (of equal ids, the smallest hash of the text).

    Near copies have sets of distinct shingles with a Jaccard similarity of ``least`` or more, verified on the sets of every link.
    Pairs to compare share a variant of a segment of their SimHash fingerprints: at ``least`` all but one in a million do.
    """
    ready_for_python(docs.sparkSession)
    width = width or min(32, max(12, docs.count().bit_length() + SPARE_BITS))
    prints = written(_printed(docs, size, width, segments or segments_needed(width, least)), "prints")
    each = written(prints.groupBy("node", "none", "id", "tie").agg(F.count("*").alias("rows")), "each")
    heads = prints.groupBy("node").agg(F.first("segments").alias("segments"), F.first("bits").alias("bits"))
    own = written(each.groupBy("node").agg(F.min(F.struct("none", "id", "tie", "rows")).alias("k")).join(heads, "node").select("node", "k.*", "segments", "bits"), "nodes")
    drop_written(prints)
    roots = shingle_components(docs, own, size, least)
    named = own.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("none", "id", "tie", "rows").alias("k"))
    best = named.groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    best = written(best.withColumnsRenamed({"id": "__id", "none": "__none", "tie": "__tie", "rows": "__rows"}), "kept")
    # Only rows that may go, or that have repeats, are shuffled; all others stay where they are.
    stay = best.where("__rows = 1").select(F.col("__none").alias("none"), F.col("__id").alias("id"), F.col("__tie").alias("tie"))
    gone = written(each.select("none", "id", "tie").join(stay, ["none", "id", "tie"], "left_anti"), "gone")
    drop_written(own)
    drop_written(each)
    inner, back = shielded(docs, [*best.columns, "__near", "__place", "__part", "__bits"])
    marked = HashSet(gone.select(F.xxhash64("id", "none", "tie"))).marked(inner, _row_hash(), "__near")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col("__id"), F.col("doc_id").cast("long").isNull() == F.col("__none"), F.xxhash64(F.col("text").cast("string")) == F.col("__tie")]
    kept = marked.where("__near").join(best, own)
    out = marked.where("not __near").select(*back).unionByName(kept.where("__rows = 1").select(*back))
    if not best.where("__rows > 1").isEmpty():
        # of rows with equal id and text that of the smallest hash over all columns that can be hashed
        plain = [f"`{f.name}`" for f in inner.schema.fields if "map<" not in f.dataType.simpleString()]
        many = kept.where("__rows > 1").select("__id", "__none", "__tie", F.struct(*back).alias("row"), F.xxhash64(*plain).alias("order"))
        out = out.unionByName(many.groupBy("__id", "__none", "__tie").agg(F.min_by("row", "order").alias("row")).select("row.*"))
    return out
