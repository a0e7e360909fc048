"""Token files, sampled pieces, token counts: exact round trips and brute force."""

import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import lattice
from tidelog.llm.lattice import BYTE_LOGP, TOKEN, PieceModel, Run, Trie, slices
from tidelog.llm.piece_sampling import Sampler, decoded, piece_digest, row_seeds, with_pieces
from tidelog.llm.queries import PIECES, TOKENIZER, op5_token_files, vocabulary
from tidelog.llm.token_counts import counter, token_counts
from tidelog.llm.common import mapped
from tidelog.llm.token_files import Encoder, delete_token_files, read_token_files, write_token_files

ODD = ["", None, "a", " a  b ", "\n\n x\n", "▁ü▁", "a\x00b", "日本語 テキスト😀", "x" * 3000, " " * 40, "The thing, the\tthing.", "<s> </s> <0x41>"]
SCHEMA = "doc_id long, text string, lang string, piece_ids string, n_tokens long"


@pytest.fixture(scope="module")
def proto():
    return vocabulary(PIECES)


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, None, "x", 7) for i, t in enumerate(texts)], SCHEMA)


def paths(model: PieceModel, word: str):
    """All segmentations of a pre-token as (log probability, pieces): brute force."""
    if not word:
        yield 0.0, ()
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in model.ids:
            own = (model.logp[model.ids[head]], (model.ids[head],))
        elif n == 1:
            ids = tuple(int(model.byte_id[b]) for b in head.encode())
            own = (BYTE_LOGP * len(ids), ids)
        else:
            continue
        for logp, rest in paths(model, word[n:]):
            yield own[0] + logp, own[1] + rest


def test_tries_agree_with_enumeration(proto):
    model = PieceModel(proto)
    words = sorted({" the", " then", " there", "the", " ", "  ", "\n", "é▁", " hat😀", "than"})
    trie = Trie(model, words)
    counts, inside = trie.counts()[trie.term], trie.forward(1.0)
    for w, word in enumerate(words):
        every = list(paths(model, word))
        assert counts[w] == len(max(every, key=lambda x: x[0])[1])
        # the chance of each path by the sampler's conditionals is its share of all paths
        total = sum(math.exp(p) for p, _ in every)
        chance = np.diff(np.concatenate(([0.0], inside)))
        chance[trie.ptr[:-1][trie.ptr[:-1] < len(inside)]] = inside[trie.ptr[:-1][trie.ptr[:-1] < len(inside)]]

        def walk(node):
            if node == 0:
                yield 1.0, ()
            for e in range(trie.ptr[node], trie.ptr[node + 1]) if node else ():
                for p, before in walk(trie.src[e]):
                    yield p * chance[e], (*before, int(trie.piece[e]))

        found = sorted(p for p, _ in walk(trie.term[w]))
        assert np.allclose(found, sorted(math.exp(p) / total for p, _ in every))


def test_sampling_is_reproducible_and_lossless(spark, proto):
    rows = frame(spark, ODD)
    made = with_pieces(rows, proto)
    assert made.columns == ["doc_id", "text", "lang", "n_tokens", "piece_ids"]
    back = decoded(made, proto).collect()
    assert sorted((r.decoded_text for r in back)) == sorted(t or "" for t in ODD)
    one = {(r.doc_id, r.text): r.piece_ids for r in back}
    two = {(r.doc_id, r.text): r.piece_ids for r in with_pieces(rows.repartition(5).union(rows), proto).collect()}
    assert one == two
    assert all(r.lossless for r in piece_digest(rows, proto).collect())
    assert with_pieces(rows.limit(0), proto).collect() == []


def test_samples_follow_the_distribution(proto):
    model = PieceModel(proto)
    every = {ids: p for p, ids in paths(model, " that")}
    total = sum(map(math.exp, every.values()))
    sampler, many = Sampler(model), 20_000
    ids, sizes = sampler.encode(["that"] * many, row_seeds(pa.array(range(many))))
    ends = np.cumsum(sizes)
    seen = {}
    for a, b in zip(ends - sizes, ends, strict=True):
        key = tuple(ids[a:b].tolist())
        seen[key] = seen.get(key, 0) + 1
    for key, n in seen.items():
        p = math.exp(every[key]) / total
        assert abs(n / many - p) < 5 * math.sqrt(p * (1 - p) / many) + 1e-9


def test_slices_change_nothing():
    text = "".join(random.Random(2).choices("ab  \n", k=5000))
    parts = list(slices(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert [t for p in parts for t in TOKEN.findall(p)] == TOKEN.findall(text)


def test_token_counts_are_brute_force(spark, proto):
    model = PieceModel(proto)
    texts = ["the then", None, "", "a b\nc", "hat😀 é"]
    found = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), proto).collect()}
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(" " + text) if text else []
        assert found[i] == (len(tokens), sum(len(max(paths(model, t), key=lambda x: x[0])[1]) for t in tokens))


def test_token_counts_cases(spark, proto):
    count = counter(proto)
    texts = [" \n ", "the " * 400_000, "the" * 5000, "▁ü▁"]
    rows = [(1, None, 5), (None, "", 5), (2, texts[0], 5), (2, texts[0], 5), (3, texts[1], 5), (4, texts[2], 5), (5, texts[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = sorted(((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in token_counts(docs, proto).collect()))
    words, pieces = (x.tolist() for x in count(texts))
    assert found == sorted([(1, 0, 0), (-1, 0, 0), *2 * [(2, words[0], pieces[0])], *((i, words[i - 2], pieces[i - 2]) for i in (3, 4, 5))])
    assert words[1] == 400_001 and words[2] == 1 and pieces[2] <= 5001
    assert token_counts(docs.limit(0), proto).collect() == []


def test_runs_agree_with_tries(proto, monkeypatch):
    model, draw = PieceModel(proto), random.Random(5)
    monkeypatch.setattr(lattice, "WINDOW", 97)
    for alphabet in ("ab", "thean", "é日本語the😀▁ab", "aGVsbG8gd29ybGQ="):
        word = " " + "".join(draw.choices(alphabet, k=1500))
        assert Run(model, word).count() == Trie(model, [word]).counts()[-1]
        long, short = Sampler(model), Sampler(model)
        key = np.array([7], dtype=np.uint64)
        one, n_one = long._run(word, key[0])
        two, n_two = short._draw([word], key)
        assert one.tolist() == two.tolist() and n_one.tolist() == n_two.tolist()


def test_unbroken_text_of_millions(proto):
    model, draw = PieceModel(proto), random.Random(6)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=500_000)) * 3 + " end"
    sampler = Sampler(model)
    ids, many = sampler.encode(["a b", text, None], np.arange(3, dtype=np.uint64))
    assert model.spells(ids[many[0] : many[0] + many[1]], text) and not model.spells(ids[many[0] :], text[:-1]) and not many[2]
    assert len(sampler.cum) < 1000  # the run left nothing behind
    words, pieces = counter(proto)([text])
    assert words[0] == 2 and 300_000 < pieces[0] < len(text)


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    definition = vocabulary(TOKENIZER)
    library, own = Tokenizer.from_buffer(definition), Encoder(definition)
    draw = random.Random(3)
    alphabet = [*"aZé'sİΣς0٣ \n\t!.,_-<|>", "<|endoftext|>", "'s", "'LL", "ﬁ", "́", " ", "日", "\x0b", "\x1c", "\u0085"]
    for _ in range(4000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 12)))
        assert np.frombuffer(own.encode(text.encode()), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_takes_many_texts_at_once(monkeypatch):
    from tokenizers import Tokenizer

    from tidelog.llm import token_files

    definition = vocabulary(TOKENIZER)
    library, draw, asked = Tokenizer.from_buffer(definition), random.Random(9), []
    alphabet = [*"aTZé'sİΣς0٣ \n\t!.,_-<|>", "<|endoftext|>", ". ", ",\n", ".. ", "T\u0308", "H\u0331", "A\u201d", "'LL", "日", "\x0b", "\u0085"]
    texts = [*ODD, *("".join(draw.choices(alphabet, k=draw.randint(0, 12))) for _ in range(4000)), *("one. Two, " * k for k in range(30)), ""]
    for size in (40, 1000, 1 << 20):
        monkeypatch.setattr(token_files, "GROUP_BYTES", size)
        own = Encoder(definition)
        found = list(own.encode_all(None if t is None else t.encode() for t in texts))
        assert len(found) == len(texts)
        for text, ids in zip(texts, found, strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    own, ids_of = Encoder(definition), own._ids
    monkeypatch.setattr(own, "_ids", lambda batch: asked.append(batch) or ids_of(batch))
    assert len(list(own.encode_all(f"new{'x' * k} word".encode() for k in range(150)))) == 150
    assert len(asked) == 1  # new words of all texts together


def test_chunks_in_use_stay_known(monkeypatch):
    from tidelog.llm import token_files

    monkeypatch.setattr(token_files, "KEPT_CHUNKS", 40)
    own, asked = Encoder(vocabulary(TOKENIZER)), []
    ids_of = own._ids
    monkeypatch.setattr(own, "_ids", lambda batch: asked.extend(b" ".join(batch).split(b" ")) or ids_of(batch))
    for a in string.ascii_lowercase:
        for b in string.ascii_lowercase:
            own.encode(f"the q{a}{b}".encode())
    assert asked.count(b"the") == 1 and asked.count(b"qzz") == 1
    assert len(own.known) + len(own.older) <= 42  # with the empty chunk of each


def test_long_chunks_are_cut_where_nothing_changes(monkeypatch):
    from tokenizers import Tokenizer

    from tidelog.llm import token_files

    definition = vocabulary(TOKENIZER)
    library = Tokenizer.from_buffer(definition)
    monkeypatch.setattr(token_files, "CUT_FROM", 3)
    monkeypatch.setattr(token_files, "LONG_CHUNK", 5)
    own, draw = Encoder(definition), random.Random(8)
    alphabet = [*"abTHWΣσé0159+/=;!?()[]{}*.:'’,、。，日本語語かﾊ", "\u0308", "\u3099", "'s", "'LL", "<|endoftext|>", " "]
    for k in range(12_000):
        text = "".join(draw.choices(alphabet if k % 2 else "ab0+/=;'s1", k=draw.randint(1, 40)))
        assert np.frombuffer(own.encode(text.encode()), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert all(len(c) <= 5 for c in own.known)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_buffer(vocabulary(TOKENIZER))
    rows = frame(spark, ODD).union(frame(spark, ["a"])).repartition(3)
    shards = write_token_files(rows, vocabulary(TOKENIZER))
    found = read_token_files(shards).collect()
    want = sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [i for i, _ in want]
    for row in by_start:
        assert row.start == at
        at += row.n_tokens
    digests = sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in found)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in want]
    assert digests == sorted((i or -1, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids)
    one = shards.where("n_docs > 0").first()
    assert mapped(f"{one.path}.bin", "<u2")[-1] == 1 and len(mapped(f"{one.path}.idx", "<u8")) == one.n_docs + 1
    delete_token_files(spark, shards)
    assert read_token_files(write_token_files(rows.limit(0), vocabulary(TOKENIZER))).collect() == []


def test_query_over_the_sample(spark):
    rows = op5_token_files(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert len(rows) == 200 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
