"""Language ID, toxicity and the permutation index: brute force and held-out accuracy."""

import itertools
import math
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.boosting import BoostedTrees, isotonic
from tidelog.llm.language_id import Labeller, held_out, train, viterbi, with_language
from tidelog.llm.permutation_index import Shard, choose_pivots, lengthened, nearest_neighbours, pivot_order
from tidelog.llm.queries import op7_toxicity, op9_language_id
from tidelog.llm.toxicity import SECOND_PERSON, Features, _takes, labelled, normal, tokens, toxicity_scores, with_toxicity
from tidelog.llm.toxicity import train as train_toxicity

SF = "/root/testdata/sf0.01"
EN = "the cat sat on the mat and the dog ran with a ball through this house while she was there"
FR = "le chat est sur la table et le chien court avec une balle dans cette maison pendant que nous sommes"
RU = "кошка сидит на столе и собака бежит через дом"


def corpus(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(text.split(), k=30)), lang) for i, (text, lang) in enumerate(list(zip((EN, FR, RU), ("en", "fr", "ru"), strict=True)) * 20)]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")


def test_viterbi_is_brute_force():
    draw = np.random.default_rng(2)
    for penalty in (0.5, 2.0):
        scores = [draw.normal(size=(n, 3)).astype(np.float32) for n in (1, 4, 6, 2)]
        for s, path in zip(scores, viterbi(scores, penalty), strict=True):
            value = lambda p, s=s: sum(float(s[i, k]) for i, k in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))
            assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(s)))))


def test_bound_and_search_agree(spark):
    model = train(corpus(spark))
    assert model.languages and set(model.languages) == {"en", "fr", "ru"}
    labeller = Labeller(model)
    mixed = f"{EN} {FR} {RU}"
    language, score, spans = labeller.label([mixed])[0]
    assert [lang for _, _, lang in spans] == ["en", "fr", "ru"] and 0 < score < 1
    assert spans[0][0] == 0 and spans[-1][1] == len(mixed.split()) and spans[0][1] == pytest.approx(len(EN.split()), abs=2)
    for text in (EN, FR, RU, "the le", "кошка cat"):
        words = labeller._words(text)[0]
        single = labeller._single(words, int(words.sum(axis=0).argmax()))
        path = viterbi([words], labeller.penalty)[0]
        assert not single or len(set(path.tolist())) == 1


def test_language_cases(spark):
    model = train(corpus(spark))
    rows = [(1, None, "lang"), (2, "", "x"), (3, "123 ... !", "x"), (4, EN, "x"), (4, EN, "x"), (5, "the " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = [(r.doc_id, r.lang_pred, len(r.lang_spans)) for r in with_language(docs, model).orderBy("doc_id").collect()]
    assert found == [(1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 1), (4, "en", 1), (5, "en", 1)]
    nothing = train(corpus(spark).limit(0))
    assert [r.lang_pred for r in with_language(docs, nothing, spans=False).collect()] == ["und"] * 6
    assert with_language(docs.limit(0), model).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, SF).join(docs, "doc_id")
    right = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] > 0.98 and right[1] > 100
    assert rows.count() == docs.count()


def test_words_of_millions_of_letters(spark, monkeypatch):
    """An unbroken run is scored in turns and not remembered for long; shorter turns give the same scores."""
    from tidelog.llm import language_id

    model = train(corpus(spark))
    words = ["the", EN.replace(" ", ""), "", "кошка" * 50, "cat"]
    want = model.words(words)
    monkeypatch.setattr(language_id, "TRIGRAMS_AT_ONCE", 7)
    assert np.allclose(model.words(words)[0], want[0])
    monkeypatch.undo()
    labeller = Labeller(model)
    run = EN.replace(" ", "") * 20_000
    assert [x[0] for x in labeller.label([run, FR, run[5:], None])] == ["en", "fr", "en", "und"] and labeller.chars < 20_000_000
    assert np.isfinite(Features({"bad": 1.0}).of("ab1" * 2_000_000)).all()


def test_language_needs_no_labels_at_scoring(spark):
    model = train(corpus(spark))
    one = corpus(spark).where("doc_id < 60")
    two = one.withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 1000})
    predict = lambda d: Counter((r.text, r.lang_pred) for r in with_language(d, model).collect())
    assert predict(one) == predict(two)


def test_words_are_normalised():
    assert normal("IDIOT!!") == ("idiot", False, False)
    assert normal("1d10t") == ("idiot", True, False)
    assert normal("i.d.i.o.t")[0] == "idiot" and normal("looooser")[0] == "looser" and normal("looooser")[2]
    assert normal("123") == ("", False, False) and normal("") == ("", False, False)
    assert tokens("idiots") == ["idiots", "idio*", "idiot*"]


def test_features_of_edge_cases():
    features = Features({"bad": 2.0})
    assert not features.of(None).any() and not features.of("").any()
    own = features.of("you are BAD, so bad!")
    assert own[0] == pytest.approx(2 / 5) and own[4] > 0
    assert np.isfinite(features.table([" \n ", "!", "bad " * 300_000])).all()


def test_trees_and_calibration():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    margin = BoostedTrees().fit(x, y).margin(x)
    assert ((margin > 0) == y).mean() > 0.97
    knots, values = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and np.interp([1, 2, 3, 4], knots, values).tolist() == [0, 0.5, 0.5, 1]


def test_toxicity_cases_and_accuracy(spark):
    rows = op7_toxicity(spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert rows.count() == docs.count() and rows.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()
    held = rows.where("held_out").join(labels, "doc_id").where("toxic is not null").toPandas()
    order = held["score"].rank()
    toxic = held["toxic"] == 1
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.8 and (held["predicted"] == held["toxic"]).mean() > 0.9


def plain_features(lexicon, text):
    """The dense features by plain loops."""
    if not text:
        return [0.0] * 15
    words = [normal(w) for w in text.split()]
    weight = [max([lexicon.get(t, 0.0) for t in tokens(w)], default=0.0) for w, _, _ in words]
    hits = [i for i, w in enumerate(weight) if w > 0]
    person = [w in SECOND_PERSON for w, _, _ in words]
    n, chars, raw = max(1, len(words)), len(text.encode()), text.split()
    near = sum(any(person[max(0, i - 3) : i + 4]) for i in hits)
    mean = lambda flags: sum(flags) / n
    return [
        len(hits) / n, math.log1p(len(hits)), max(weight, default=0.0), sum(weight) / n, near / n, mean(person), sum(c in string.ascii_uppercase for c in text) / chars,
        (text.count("!") + text.count("?")) / n, sum(c in string.punctuation for c in text) / chars, mean([o for _, o, _ in words]), mean([s for _, _, s in words]), math.log1p(n),
        mean([len(w) > 2 and w.isupper() for w in raw]), mean([w > 0 and o for w, (_, o, _) in zip(weight, words, strict=True)]), sum(c.isdigit() and c.isascii() for c in text) / chars,
    ]


def test_features_are_plain_loops():
    draw = random.Random(5)
    lexicon = {"idiot": 3.0, "stup*": 1.5, "you": 0.2}
    parts = ["You", "IDIOT!!", "1d10t", "stupidity", "i.d.i.o.t", "the", "cat", "WHAT?", "noooo", "\n", "123", "dein", "é", "...", "u"]
    texts = [" ".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(300)] + [None, "", " "]
    assert np.allclose(Features(lexicon).table(texts), [plain_features(lexicon, t) for t in texts], atol=1e-6)


def toxic_corpus(seed, many=400):
    draw = random.Random(seed)
    good, bad = [f"good{i}" for i in range(60)], ["vile", "nasty", "h0rrid", "scum"]
    rows = []
    for i in range(many):
        toxic = i % 4 == 0
        words = draw.choices(good, k=draw.randint(3, 30)) + draw.choices(bad, k=2 if toxic else i % 37 == 0)
        rows.append((i, " ".join(draw.sample(words, len(words))), int(toxic)))
    return rows


def test_lexicon_is_brute_force(spark):
    rows = toxic_corpus(3)
    docs = spark.createDataFrame([*((i, t, "x") for i, t, _ in rows), (None, "vile", "x"), (5000, "not labelled vile", "x"), (4, "again vile", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(9999, 1, 1), (0, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    known = labelled(docs, labels)
    assert sorted(r.doc_id for r in known.collect()) == sorted([*range(len(rows)), 4])
    fold = {r.doc_id: r.fold for r in known.collect()}
    every = [*rows, (4, "again vile", 1)]
    model = train_toxicity(docs, labels)
    want = {}
    toxic, clean = (sum((x > 0) is k for _, _, x in every) for k in (True, False))
    held = [{t for w in text.split() for t in tokens(normal(w)[0])} for _, text, _ in every]
    for token in set().union(*held):
        n, m = (sum(token in h and (x > 0) is k for h, (_, _, x) in zip(held, every, strict=True)) for k in (True, False))
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1))
        if n >= 3 and odds - math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) >= 1.5:
            want[token] = odds
    assert model.lexicon == pytest.approx(want) and "vile" in want and "horrid" in want and set(fold.values()) == {0, 1, 2, 3}
    scores = {r.doc_id: r.toxicity for r in with_toxicity(docs, model).where("doc_id < 400").collect()}
    right = [(scores[i] >= 0.5) == (x > 0) for i, _, x in rows]
    assert sum(right) / len(right) > 0.97
    assert with_toxicity(docs, model).columns == ["doc_id", "text", "toxic", "toxicity"]


def test_sample_is_bounded_and_weighted(spark):
    """Few rows are drawn, also where one id has a third of them; the scores still answer the shares of the whole."""
    assert _takes(10, 1000, 100) == {True: 10, False: 90} and _takes(500, 1000, 100) == {True: 50, False: 50}
    assert _takes(5, 6, 100) == {True: 5, False: 6} and _takes(1000, 20, 100) == {True: 80, False: 20}
    rows = toxic_corpus(4, 600) + [(1, "good1 good2 good3", 0)] * 300
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int").distinct()
    model = train_toxicity(docs, labels, sample_rows=120)
    scores = [r.toxicity for r in with_toxicity(docs, model).collect()]
    assert sum(scores) / len(scores) == pytest.approx(150 / 900, abs=0.06)


def test_weights_stand_for_rows():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(60, 3)), (draw.random(60) < 0.4).astype(float)
    weight = draw.integers(1, 4, 60)
    again = np.repeat(np.arange(60), weight)
    one, two = BoostedTrees(trees=5, bins=400).fit(x, y, weight.astype(float)), BoostedTrees(trees=5, bins=400).fit(x[again], y[again])
    assert one.base == pytest.approx(two.base)
    margin = draw.normal(size=60).round(1)
    a, b = isotonic(margin, y, weight.astype(float)), isotonic(margin[again], y[again])
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
    # the fit by pooling is the least-squares one: no other non-decreasing fit found by brute force is better
    pts = np.array([0, 1, 2, 3])
    levels = np.linspace(0, 1, 11)
    own = np.array([0.0, 1, 0, 1])
    knots = isotonic(pts.astype(float), own)
    loss = lambda v: ((np.array(v) - own) ** 2).sum()
    assert loss(np.interp(pts, *knots)) <= min(loss(v) for v in itertools.combinations_with_replacement(levels, 4)) + 1e-9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a text"), (3, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity_scores(docs, none).collect()] == [0.0] * 4
    few = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity_scores(docs, few).collect()} == {1.0}
    assert toxicity_scores(docs.limit(0), few).collect() == []


def test_held_out_rows(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def brute(vectors, ids, query, k):
    scores = [(-(np.array(v, dtype=float) * np.array(vectors[ids.index(query)], dtype=float)).sum(), i) for v, i in zip(vectors, ids, strict=True) if i != query]
    return [i for _, i in sorted(scores)[:k]]


def test_neighbours_recall(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = frame.collect()
    ids, vectors = [r.vec_id for r in data], [r.embedding for r in data]
    found = {}
    for r in nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        own = (np.array(vectors[ids.index(r.vec_id)], dtype=float) * np.array(vectors[ids.index(r.query_id)], dtype=float)).sum()
        assert r.score == pytest.approx(own, abs=1e-12)
    assert set(found) == {i for i in ids if i % 20 == 0} and all(len(v) == 20 for v in found.values())
    recall = np.mean([len(set(v) & set(brute(vectors, ids, q, 20))) / 20 for q, v in found.items()])
    assert recall >= 0.95


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (20, [0.0, -1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [2.0, 0.0])]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(docs).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 2.0), (0, 2, 10, 2.0), (0, 3, 2, 0.5), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 10, 0.0), (20, 4, 2, -0.5)]
    assert nearest_neighbours(docs.limit(0)).collect() == [] and nearest_neighbours(docs.where("vec_id = 0")).collect() == []


def test_copies_that_tie_are_all_ranked():
    """A third of the rows are one vector: of its copies the smallest ids are the neighbours."""
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(3000, 16))
    copies = draw.permutation(3000)[:1000]
    vectors[copies] = vectors[copies[0]]
    long = lengthened(vectors, np.sqrt((vectors**2).sum(axis=1)).max())
    pivots = choose_pivots(long, 64)
    order = pivot_order(long, pivots, 16)
    query = pivot_order(np.hstack((vectors[copies[:1]], [[0.0]])), pivots, 16)[0]
    found, _ = Shard(np.arange(3000), vectors, order, 64).search(-1, vectors[copies[0]], query, 20, 0.15)
    assert found.tolist() == sorted(copies.tolist())[:20]


def test_a_repeated_id_takes_one_place(spark):
    """A third of the rows have one id: queries near it, and it as a query, still get all their other neighbours."""
    draw = np.random.default_rng(6)
    centre = draw.normal(size=16)
    rows = [(0, (2 * centre + 0.01 * draw.normal(size=16)).tolist()) for _ in range(500)] + [(i, (centre + draw.normal(size=16)).tolist()) for i in range(1, 1001)]
    found = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=100).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    values, own = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    right = 0
    for q in range(0, 1001, 100):
        query = values[own == q] if q else np.array([min(v for i, v in rows if i == 0)])
        best = {}
        for i, score in zip(own.tolist(), (values * query[0]).sum(axis=1).tolist(), strict=True):
            best[i] = max(score, best.get(i, score))
        want = sorted((i for i in best if i != q), key=lambda i: (-best[i], i))[:20]
        assert len(found[q]) == len(set(found[q])) == 20
        right += len(set(want) & set(found[q]))
    assert right >= 0.9 * 20 * 11


def test_overlap_is_the_footrule():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(50, 8))
    long = lengthened(vectors, np.sqrt((vectors**2).sum(axis=1)).max())
    pivots = choose_pivots(long, 16)
    order = pivot_order(long, pivots, 6)
    shard = Shard(np.arange(50), vectors, order, 16)
    place = lambda row, p: list(row).index(p) if p in row else 6
    foot = np.array([sum(abs(place(order[3], p) - place(o, p)) for p in range(16)) for o in order])
    assert (2 * shard.overlap(order[3]) + foot == 2 * 21).all()
