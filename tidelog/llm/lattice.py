"""The piece lattice of a unigram model over a trie of pre-tokens.

A text is cut into pre-tokens (a run of spaces with what follows it up to the next space, or one
line feed). No piece crosses such a cut, so the lattice of a text is the chain of the lattices of
its pre-tokens. Distinct pre-tokens go into a trie; forward scores belong to trie nodes, so a prefix
that many pre-tokens share is scored once. Sorted pre-tokens with the lengths of their common
prefixes are that trie: a row opens only the nodes that the row before it lacks.

A pre-token over ``LONG`` characters (base64, minified code, scripts without spaces) is a :class:`Run` of its own:
its edges are found ``WINDOW`` characters at a time and scored left to right with a window of the longest piece, so a
run of any length needs little more than its own characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import exp, log

import numpy as np

#: Rank offset of the Zipf law that turns a piece's rank into a log probability.
ZIPF_OFFSET = 10.0
#: Log probability of one byte piece, below that of any ordinary piece.
BYTE_LOGP = -16.0
CHUNK_WORDS, CHUNK_CELLS = 10_000, 1_000_000
SLICE_CHARS = 1_000_000
#: A longer pre-token is a run; one that is longer than ``SHORT`` is not remembered.
LONG, SHORT, WINDOW = 2_000, 64, 1 << 16
TOKEN = re.compile(r"\n| *[^ \n]+| +")
CUT = re.compile(r"\n|(?<=[^ ]) ")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut only where no piece can cross."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        end = cut.start() + (cut.group() == "\n")
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class PieceModel:
    """Pieces of a sentencepiece model as a unigram model: log probability by Zipf's law of the piece's rank.

    Spaces stand for the model's U+2581. A character that no piece spells falls back to its UTF-8
    bytes; so does a literal U+2581, which keeps decoding lossless.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor()
        model.LoadFromSerializedProto(proto)
        self.size = model.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.spelling: list[bytes] = [b""] * self.size
        ids: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.spelling[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                if "\n" in piece or " " in piece.lstrip(" "):
                    raise ValueError(f"piece {i} crosses a pre-token's end")
                ids[piece] = i
                self.spelling[i] = piece.encode()
        self.ids = ids
        self.logp = -np.log(np.arange(self.size) + ZIPF_OFFSET)
        self.logp -= np.log(np.exp(self.logp).sum())
        self._reversed_trie()

    def _reversed_trie(self) -> None:
        step: dict[tuple[int, str], int] = {}
        final = [-1]
        for piece, i in self.ids.items():
            state = 0
            for char in reversed(piece):
                state = step.setdefault((state, char), len(final))
                if state == len(final):
                    final.append(-1)
            final[state] = i
        self.longest = max(map(len, self.ids), default=1)
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[self.byte_id] = True
        keys = np.fromiter(((s << 21) | ord(c) for s, c in step), dtype=np.int64, count=len(step))
        order = np.argsort(keys)
        self._keys, self._next = keys[order], np.fromiter(step.values(), dtype=np.int64, count=len(step))[order]
        self._final = np.array(final, dtype=np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states of the trie of reversed pieces, -1 where there is none."""
        key = (state << 21) | char
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._next[at], -1)

    def final(self, state: np.ndarray) -> np.ndarray:
        return self._final[state]

    def endings(self, many: int, char: Callable[[np.ndarray, int], np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lattice edges that end at each of ``many`` places: place, length, piece, sorted by place and falling length.

        ``char(places, back)`` are the code points that many places before, ``depth`` the characters up to a place. ``piece`` is a piece
        id, or ``size`` + code point for a character spelled in bytes.
        """
        found: list[tuple[np.ndarray, ...]] = []
        live, state, m = np.arange(many), np.zeros(many, dtype=np.int64), 0
        while len(live):
            m += 1
            own = char(live, m - 1).astype(np.int64)
            state = self.step(state, own)
            piece = np.where(state >= 0, self.final(np.maximum(state, 0)), -1)
            if m == 1:
                piece = np.where(piece >= 0, piece, np.where(own < 128, self.byte_id[np.minimum(own, 127)], self.size + own))
            good = piece >= 0
            found.append((live[good], np.full(int(good.sum()), m), piece[good]))
            keep = (state >= 0) & (depth[live] > m)
            live, state = live[keep], state[keep]
        place, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-length, place))
        return place[order], length[order], piece[order]

    def costs(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and number of pieces of each edge's piece."""
        spelled = piece >= self.size
        point = np.where(spelled, piece - self.size, 0)
        size = np.where(spelled, 2 + (point >= 0x800) + (point >= 0x10000), 1)
        plain = np.where(spelled, 0, piece)
        return np.where(spelled | self.is_byte[plain], BYTE_LOGP * size, self.logp[plain]), size

    def decode(self, ids) -> str:
        """The text of piece ids; the space put before the first pre-token goes."""
        return b"".join(map(self.spelling.__getitem__, ids)).decode()[1:]

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether piece ids decode to the text; a bounded number at a time."""
        want, at = memoryview((" " + text if text else "").encode()), 0
        for lo in range(0, len(ids), 1 << 18):
            own = b"".join(map(self.spelling.__getitem__, ids[lo : lo + (1 << 18)].tolist()))
            if want[at : at + len(own)] != own:
                return False
            at += len(own)
        return at == len(want)


class Trie:
    """Trie of sorted distinct pre-tokens with the lattice edges that end at each node.

    ``term[w]`` is the node of pre-token w; node 0 is the root. Edges are sorted by ``dst`` and,
    within it, by falling piece length; edge e goes from node ``src[e]`` and costs ``logp[e]``.
    ``piece[e]`` is a piece id, or ``model.size`` + code point for a character spelled in bytes.
    """

    def __init__(self, model: PieceModel, words: list[str]):
        width = max(map(len, words))
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        shared = np.zeros(len(words), dtype=np.int64)
        if len(words) > 1:
            differ = chars[1:] != chars[:-1]
            shared[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(lens[1:], lens[:-1]))
        column = np.arange(width)
        new = ((column >= shared[:, None]) & (column < lens[:, None])).T
        depth, row = np.nonzero(new)
        node = np.zeros(new.shape, dtype=np.int32)
        node[depth, row] = np.arange(1, len(depth) + 1)
        node = np.maximum.accumulate(node, axis=1)
        self.nodes = len(depth) + 1
        self.level = np.searchsorted(depth, np.arange(width + 1)) + 1
        self.term = node[lens - 1, np.arange(len(words))]

        at, length, self.piece = model.endings(len(depth), lambda live, back: chars[row[live], depth[live] - back], depth + 1)
        self.dst, before = at + 1, depth[at] - length
        self.src = np.where(before >= 0, node[np.maximum(before, 0), row[at]], 0)
        self.ptr = np.searchsorted(self.dst, np.arange(self.nodes + 1))
        self.logp, self.size = model.costs(self.piece)

    def _levels(self):
        for lo, hi in zip(self.level[:-1], self.level[1:], strict=True):
            if hi > lo:
                a, b = self.ptr[lo], self.ptr[hi]
                yield lo, hi, a, b, self.ptr[lo:hi] - a

    def counts(self) -> np.ndarray:
        """Pieces of the best segmentation of each node's prefix; of equal scores the longest last piece wins."""
        best, count = np.zeros(self.nodes), np.zeros(self.nodes, dtype=np.int64)
        for lo, hi, a, b, cut in self._levels():
            value = best[self.src[a:b]] + self.logp[a:b]
            top = np.maximum.reduceat(value, cut)
            wins = value == np.repeat(top, np.diff(np.append(cut, b - a)))
            first = np.minimum.reduceat(np.where(wins, np.arange(b - a), b - a), cut) + a
            best[lo:hi] = top
            count[lo:hi] = count[self.src[first]] + self.size[first]
        return count

    def forward(self, theta: float) -> np.ndarray:
        """Cumulative probability, within each node, of the edge by which a sampled path enters it."""
        alpha, chance = np.zeros(self.nodes), np.zeros(len(self.dst))
        for lo, hi, a, b, cut in self._levels():
            value = alpha[self.src[a:b]] + theta * self.logp[a:b]
            many = np.diff(np.append(cut, b - a))
            top = np.maximum.reduceat(value, cut)
            alpha[lo:hi] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many)), cut))
            chance[a:b] = np.exp(value - np.repeat(alpha[lo:hi], many))
        total = np.cumsum(chance)
        start = np.concatenate(([0.0], total))[self.ptr[self.dst]]
        inside = np.minimum(total - start, 1.0)
        inside[self.ptr[1:][self.ptr[1:] > self.ptr[:-1]] - 1] = 1.0
        return inside


class Run:
    """The lattice of one long pre-token, found a window at a time; node i is the place after i characters."""

    def __init__(self, model: PieceModel, word: str):
        self.model, self.many = model, len(word)
        self.chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)

    def _edges(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Edges into nodes lo + 1 to hi: first edge of each node, length, piece, log probability, number of pieces."""
        at, length, piece = self.model.endings(hi - lo, lambda live, back: self.chars[lo + live - back], np.arange(lo + 1, hi + 1))
        return np.searchsorted(at, np.arange(hi - lo + 1)), length, piece, *self.model.costs(piece)

    def count(self) -> int:
        """Pieces of the best segmentation, by the rule of :meth:`Trie.counts`; keeps the last nodes that a piece can reach back to."""
        best, count, back = [0.0], [0], self.model.longest
        for lo in range(0, self.many, WINDOW):
            ptr, length, _, logp, size = (x.tolist() for x in self._edges(lo, min(lo + WINDOW, self.many)))
            for a, b in zip(ptr[:-1], ptr[1:], strict=True):
                top, first = best[-length[a]] + logp[a], a
                for e in range(a + 1, b):
                    if (value := best[-length[e]] + logp[e]) > top:
                        top, first = value, e
                count.append(count[-length[first]] + size[first])
                best.append(top)
            best, count = best[-back:], count[-back:]
        return count[-1]

    def sample(self, theta: float, draws: Iterator[float]) -> np.ndarray:
        """Pieces of a path drawn backwards from the forward sums, a uniform number for each piece.

        Forward sums are kept for every node (8 bytes a character); the edges of a window are found again on the way back.
        """
        alpha = np.empty(self.many + 1)
        recent, back = [0.0], self.model.longest
        alpha[0] = 0.0
        for lo in range(0, self.many, WINDOW):
            hi = min(lo + WINDOW, self.many)
            ptr, length, _, logp, _ = (x.tolist() for x in self._edges(lo, hi))
            for a, b in zip(ptr[:-1], ptr[1:], strict=True):
                if b == a + 1:
                    recent.append(recent[-length[a]] + theta * logp[a])
                    continue
                values = [recent[-length[e]] + theta * logp[e] for e in range(a, b)]
                top = max(values)
                recent.append(top + log(sum([exp(v - top) for v in values])))
            alpha[lo + 1 : hi + 1] = recent[lo - hi :]
            recent = recent[-back:]
        out: list[np.ndarray] = []
        node = self.many
        for lo in range((self.many - 1) // WINDOW * WINDOW, -1, -WINDOW):
            hi = min(lo + WINDOW, self.many)
            ptr, length, piece, logp, _ = self._edges(lo, hi)
            into = lo + np.repeat(np.arange(1, hi - lo + 1), np.diff(ptr))
            chance = np.exp(alpha[into - length] + theta * logp - alpha[into]).tolist()
            ptr, length, kinds, own = ptr.tolist(), length.tolist(), piece.tolist(), []
            while node > lo:
                u, a, b = next(draws), ptr[node - lo - 1], ptr[node - lo] - 1
                while a < b and u >= chance[a]:
                    u -= chance[a]
                    a += 1
                own.append(kinds[a])
                node -= length[a]
            out.append(np.array(own, dtype=np.int32))
        return np.concatenate(out)[::-1]


def tries(model: PieceModel, words) -> Iterator[tuple[list[str], Trie]]:
    """Sorted chunks of distinct non-empty pre-tokens of up to ``LONG`` characters, each with its trie; the work of a chunk is bounded."""
    words = sorted(words)
    short = [w for w in words if len(w) <= SHORT]
    for at in range(0, len(short), CHUNK_WORDS):
        yield (chunk := short[at : at + CHUNK_WORDS]), Trie(model, chunk)
    chunk: list[str] = []
    for word in sorted((w for w in words if len(w) > SHORT), key=len):
        if chunk and (len(chunk) + 1) * len(word) > CHUNK_CELLS:
            yield (chunk := sorted(chunk)), Trie(model, chunk)
            chunk = []
        chunk.append(word)
    if chunk:
        yield (chunk := sorted(chunk)), Trie(model, chunk)


_MODELS: dict[int, PieceModel] = {}


def loaded(proto: bytes) -> PieceModel:
    """The model of these bytes, built once in a Python worker."""
    key = hash(proto)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]
