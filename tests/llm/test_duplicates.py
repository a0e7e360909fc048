"""SimHash, components and decontamination against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidelog.llm import simhash
from pyspark.sql import functions as F

from tidelog.llm.common import HashSet, written
from tidelog.llm.components import connected_components
from tidelog.llm.decontamination import contamination_digest, decontaminated, find_contamination


def brute_fp(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, values, most):
    least = list(range(len(ids)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 350)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = start
                todo += near[at]
    assert found == want
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def sample_texts():
    draw = random.Random(9)
    base = [" ".join(draw.choices("a b c d e f g h i j k l m n o p".split(), k=draw.randint(1, 60))) for _ in range(60)]
    near = []
    for text in base[:25] * 3:
        words = text.split()
        words[draw.randrange(len(words))] = "z"
        near.append(" ".join(words))
    return [*base, *near, *base[:5], None, "", " \n ", "Word", "word"]


def test_simhash_is_brute_force(spark):
    texts = sample_texts()
    rows = [(i if i != 7 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    found = {(r.doc_id): (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_duplicates(docs).collect()}
    values = [brute_fp(t) for t in texts]
    want = brute_components([r[0] for r in rows], values, 3)
    assert found == {r[0]: (v, c) for r, v, c in zip(rows, values, want, strict=True)}
    assert simhash.simhash_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("limit", "bits"), [(5000, None), (2, None), (2, 0)])
def test_planted_links_survive_splitting(spark, monkeypatch, limit, bits):
    """Fingerprints up to three bits apart, also where every group is dealt further, by one piece or by four."""
    if bits is not None:
        monkeypatch.setattr(simhash, "_dealt_bits", lambda rest, most, shared: bits)
    draw = random.Random(3)
    values = set()
    for _ in range(12):
        seed = draw.getrandbits(64)
        for _ in range(20):
            values.add(seed)
            for bit in draw.sample(range(64), draw.randint(0, 3)):
                seed ^= 1 << bit
    values = sorted(values)
    fps = written(spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary"), "test")
    edges, _ = simhash.near_edges(fps, 64, 3, 2, group_limit=limit)
    roots = {bytes(r.node): bytes(r.root) for r in connected_components(edges, "a", "b").collect()}
    want = brute_components(values, values, 3)
    found = [int.from_bytes(roots.get(v.to_bytes(8, "big"), v.to_bytes(8, "big")), "big") for v in values]
    assert found == want


def test_one_of_each_group_stays(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(draw.sample(words, 200)) for _ in range(8)]
    rows = []
    for i, text in enumerate(texts):
        rows.append((100 + i, text, "x"))
        rows.append((200 + i, text, "x"))  # an exact copy
        own = text.split()
        own[50] = "changed"
        rows.append((i, " ".join(own), "x"))  # a near copy
    rows += [(500, "", "x"), (501, None, "x"), (500, "", "x"), (900, "alone", "x"), (900, "alone", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rows string")
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == sorted([(False, i) for i in [*range(8), 500, 900]] + [(True, None)])
    assert simhash.without_near_copies(docs.limit(0)).collect() == []


def edited(words, share, draw):
    """A copy whose five-word shingles have about the Jaccard similarity ``share`` with those of ``words``."""
    words, many = list(words), len(words) - 4
    lost = round(many * (1 - share) / (1 + share) - 1e-9)
    for i in range(lost // 5):
        words[4 + i * (many // (lost // 5 + 1))] = f"new{draw.random()}"
    return words[lost % 5 :] + [f"tail{draw.random()}" for _ in range(lost % 5)]


def similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def planted(shares, each, seed):
    draw = random.Random(seed)
    rows, similar = [], {}
    for share in shares:
        for _ in range(each):
            words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
            near = edited(words, share, draw)
            at = len(rows)
            rows += [(at, " ".join(words)), (at + 1, " ".join(near))]
            similar[at + 1] = similarity(words, near)
    return rows, similar


def test_all_near_copies_go_and_no_others(spark):
    """Pairs from 0.8 on lose their second document; of a chain one stays."""
    rows, similar = planted([0.95, 0.9, 0.85, 0.82, 0.805], 30, 5)
    assert all(0.8 <= s < 0.97 for s in similar.values())
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {r[0] for r in rows} - set(similar)
    chain = [f"c{i}" for i in range(300)]
    steps = [" ".join([f"s{j}" for j in range(i * 25)] + chain[i * 25 :]) for i in range(6)]
    kept = [r.doc_id for r in simhash.without_near_copies(spark.createDataFrame([(5 - i, t) for i, t in enumerate(steps)], "doc_id long, text string")).collect()]
    assert kept == [0]


@pytest.mark.parametrize("block", [400, 7])
def test_groups_around_the_threshold_are_brute_force(spark, monkeypatch, block):
    """Many texts at 0.6 to 0.95 of one original and of one another, as one bucket or in blocks: the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_NODES", block)
    monkeypatch.setattr(simhash, "HUB_TURNS", 1)
    draw = random.Random(12)
    texts = []
    for _ in range(3):
        original = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        middle = [edited(original, s, draw) for s in (0.75, 0.78, 0.85)]
        texts += [edited(m, s, draw) for m in (original, *middle) for s in (0.7, 0.76, 0.79, 0.82, 0.9) for _ in range(3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(least) and 20 < len(kept) < len(rows) - 20


def test_bitmaps_miss_nothing():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((draw.choice(base, n, replace=False), draw.integers(0, 2**63, m, dtype=np.uint64)))) for n, m in [(400, 0), (370, 20), (360, 45), (380, 40), (300, 0), (330, 90), (200, 200), (5, 0)] * 3]
    group = simhash.SetGroup(sets, list(range(len(sets))), 0.8)
    every = np.arange(len(sets))
    found = group.links(every, every)
    assert all(simhash.alike(sets[i], sets[j], 0.8) for i, j in found) and len(found) < len(sets)
    assert all(group.part[i] == group.part[j] for i in every for j in every if simhash.alike(sets[i], sets[j], 0.8))


def test_rows_of_equal_text_have_one_choice(spark):
    rows = [(1, "a b c d e f", x) for x in ("p", "q", "r", "s")]
    kept = [simhash.without_near_copies(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n)).collect() for order, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_documents_below_the_threshold_stay(spark):
    """No document goes for a similarity that the fingerprints only estimate."""
    rows, similar = planted([0.79, 0.78, 0.76], 30, 7)
    assert all(0.7 < s < 0.8 for s in similar.values())
    assert simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def short_pairs(each, seed):
    """Pairs of four and five five-word shingles, and of nine with one changed: similarity exactly 0.8."""
    draw = random.Random(seed)
    rows = []
    for i in range(each):
        words = [f"w{draw.randrange(10**6)}" for _ in range(14)]
        rows += [" ".join(words[: 8 if i % 2 else 13]), " ".join(words[:9] if i % 2 else [*words[:12], "end"])]
    return list(enumerate(rows))


@pytest.mark.parametrize("slice_bytes", [16 << 20, 2000])
def test_near_dedup_names_pairs_by_fingerprints(spark, slice_bytes):
    """Every pair at 0.8 or more shares a key of near_members, whose nodes are near in bits; clusters of three or more too."""
    rows, _ = planted([0.95, 0.85, 0.8], 30, 21)
    middle = rows[0][1].split()
    rows += [(1000 + i, " ".join([*middle[i:], *(f"x{i}y{j}" for j in range(i))])) for i in range(1, 12)]
    rows += [(2000 + i, t) for i, t in short_pairs(60, 22)]
    width = len(rows).bit_length() + simhash.SPARE_BITS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = written(simhash._printed(docs, 5, width, simhash.segments_needed(width, 0.8)), "test")
    ids = {r.node: (r.id, int.from_bytes(r.bits, "big")) for r in own.collect()}
    groups = {}
    for r in simhash.near_members(own, 0.8, slice_bytes).collect():
        groups.setdefault(r.key, set()).add(ids[r.node])
    met = {frozenset((a[0], b[0])) for g in groups.values() for a in g for b in g if a < b}
    sets = [(i, {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}) for i, t in rows]
    want = {frozenset((a, b)) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if len(s & t) >= 0.8 * len(s | t)}
    assert len(want) > 150 and want <= met and len(met) < 2 * len(want)
    assert all(any(a != b and (a[1] ^ b[1]).bit_count() <= simhash.most_apart(0.8) for b in g) for g in groups.values() for a in g)


def test_near_copies_have_one_key_however_many_variants_they_share(spark):
    """A row a node, so that no join on keys makes more rows than there are nodes; a node's value goes to one or two slices of a segment."""
    draw = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[: 5 * i], f"own{draw.random()}", *words[5 * i + 1 :]])) for i in range(40)] + planted([0.9], 5, 32)[0]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    own = written(simhash._printed(docs, 5, 14, 20), "test")
    for slice_bytes in (16 << 20, 200):
        members = simhash.near_members(own, 0.8, slice_bytes).collect()
        sizes = {}
        for r in members:
            sizes[r.key] = sizes.get(r.key, 0) + 1
        assert len(members) == len({r.node for r in members}) == 50 and sorted(sizes.values()) == [2] * 5 + [40]


def test_least_reached():
    a, b = np.array([5, 7, 3, 9, 8]), np.array([7, 3, 1, 8, 9])
    assert simhash._least_reached(10, a, b).tolist() == [0, 1, 2, 1, 4, 1, 6, 1, 8, 8]
    steps = np.random.default_rng(4).permutation(500)
    assert not simhash._least_reached(500, steps[1:], steps[:-1]).any()


def test_pipeline_takes_candidates_from_fingerprints_only(spark, monkeypatch):
    rows, similar = planted([0.9, 0.82], 10, 23)
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in short_pairs(40, 24)], "doc_id long, text string")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == len(rows) - len(similar) + 40
    monkeypatch.setattr(simhash, "most_apart", lambda least: -1)
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == len(rows) + 80


def test_variants_of_weak_bits():
    sums = np.array([[9, -1, 8, 2, -7, 3, 50, -60]])
    value = simhash.segment_values(sums)
    base = 0b01101101
    assert value[0] & 0xFFFFFFFF == base
    assert sorted(simhash.variants(value)[0].tolist()) == sorted(base ^ a ^ b ^ c for a in (0, 2) for b in (0, 8) for c in (0, 32))


def test_repeated_shingles_and_chunks():
    text = ("A b c " * 500 + "\n").encode()
    assert int.from_bytes(simhash.fingerprint(text, 3, 64, False), "big") == brute_fp(text.decode())
    wide = simhash.fingerprint(text, 3, 256, True)
    assert len(wide) == 32 and wide[:8] != wide[8:16]


def test_contamination(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (2, "short item"), (3, None), (4, "!!"), (None, "null id item")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(400))
    rows = [
        (1, f"{filler} ONE two, three four five six seven eight nine ten eleven twelve thirteen {filler}"),
        (2, "x short item y short-item"), (3, None), (4, ""), (5, "short; thing item"), (6, f"{filler} short item"), (7, item), (8, "null id item"),
    ]
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, items string, n_chars long")
    for limit in (8 << 20, 10):  # the second deals the items into many parts
        found = {r.doc_id: r for r in find_contamination(docs, bench, limit=limit).collect()}
        assert (found[1].n_words, found[1].n_hit, found[1].items) == (813, 13, ["1"])
        assert [(s.start, s.end) for s in found[2].spans] == [(1, 3), (4, 6)] and found[2].items == ["2"]
        assert found[3].n_words == found[4].n_words == found[5].n_hit == found[8].n_hit == 0
        assert (found[7].n_hit, found[7].items) == (14, ["1"])
    digest = {r.doc_id: r.contaminated for r in contamination_digest(docs, bench).collect()}
    assert digest == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False}
    for limit in (8 << 20, 10):
        clean = {r.doc_id: r for r in decontaminated(docs, bench, limit=limit).collect()}
        assert sorted(clean) == [1, 3, 4, 5, 6, 8] and {r.items for r in clean.values()} == {"c"}
        assert clean[6].text == filler + " " and clean[6].n_chars == len(filler) + 1 and clean[8].n_chars == 3
    assert decontaminated(docs, bench.limit(0)).count() == len(rows) and contamination_digest(docs.limit(0), bench).collect() == []


def test_forest_connects_what_pairs_connect():
    draw = np.random.default_rng(0)
    fps = np.unique(draw.integers(0, 64, (40, 1), dtype=np.uint64), axis=0)
    edges = simhash._forest(fps, 1)
    assert len(edges) == len(fps) - 1 or all((int(fps[a, 0]) ^ int(fps[b, 0])).bit_count() <= 1 for a, b in edges)


def test_hash_sets_miss_nothing(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id k")
    rows = spark.range(20_000)
    marked = HashSet(keys.selectExpr("xxhash64(k) h")).marked(rows, F.xxhash64("id"), "near")
    found = {r.id for r in marked.where("near").collect()}
    wanted = {r.k for r in keys.collect()}
    assert wanted <= found and len(found) < len(wanted) + 0.15 * 20_000 and marked.count() == 20_000
    nothing = HashSet(keys.limit(0).selectExpr("xxhash64(k) h")).marked(rows, F.xxhash64("id"), "near")
    assert nothing.where("near").isEmpty() and nothing.count() == 20_000
