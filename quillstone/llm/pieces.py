"""Encoding to pieces and decoding, with exact N-best segmentations.

The pieces come from a SentencePiece model file; a segmentation's score is the sum of its pieces' log probabilities. A
merge model's file holds ranks, whose sum says nothing: its pieces are put in order by them, and the piece at place r
has a probability in proportion to 1 / (r + SHIFT), as Zipf's and Mandelbrot's law gives it, so that nothing is trained. A
character without a piece is written as its bytes and scores ten below the lowest piece. The merge model's own encoding
is found beside the N best, a stretch at a time, by the file's library; it is one path of the same lattice. Forward Viterbi scores
are the exact best scores of all prefixes; A* searches backwards from the end of the piece lattice with them as its
heuristic, so that each complete path it takes from its queue is the next best.

No piece holds a blank behind another character, so a lattice falls apart at the blanks, and between letters and other
characters where no piece mixes them. A text's N best differ from its best one only in stretches whose
second best is among the N - 1 nearest to their best; A* runs on these, and their lists are merged best first.

Texts come many at a time. They are cut in numpy, each different stretch is looked up once, and those that aren't known
yet go through the forward search together, all lattices edge by edge in numpy; what is found is kept in arrays under the
stretch's number until the task ends.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from functools import lru_cache
from itertools import chain, pairwise, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, ids array<int>, n_pieces long, score double, nbest_scores array<double>, second_ids_sha256 string, decoded_sha256 string, round_trip boolean"
MERGED = "n_merged long, merged_score double, merged_ids_sha256 string"
#: Of 1, 2, 11, 101 and 1,001, the one whose best segmentations have most nearly as many pieces as the merges give.
SHIFT = 11
KEPT = 500_000
#: Longer stretches have the forward search to themselves.
SHORT = 48


def by_rank(normal: list, shift: int = SHIFT) -> list:
    """Pieces with log probabilities in place of scores that give no more than their order; they add up to one."""
    ranked = sorted(normal, key=lambda x: (-x[1], x[2]))
    total = math.log(math.fsum(1 / (r + shift) for r in range(len(ranked))))
    return [(p, -math.log(r + shift) - total, i) for r, (p, _, i) in enumerate(ranked)]


def load(model: str | bytes = MODEL, ranks: bool = True) -> tuple[list, list, list]:
    """Normal pieces as (text, log probability, id), ids of the 256 bytes, and what each id decodes to, from a model's file or its bytes. ``ranks``: the file's scores are ranks of merges."""
    sp = _library(model if isinstance(model, bytes) else Path(model).read_bytes())
    normal, of_byte, shown = [], [0] * 256, []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            shown.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            shown.append(b"")
        else:
            piece = piece.replace("▁", " ")
            normal.append((piece, sp.get_score(i), i))
            shown.append(piece.encode())
    return by_rank(normal) if ranks else normal, of_byte, shown


def _library(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


#: Behind a model's file: its normalizer_spec.add_dummy_prefix is false, as a later value counts.
NO_PREFIX = b"\x1a\x02\x18\x00"
BLANK, LETTER, MARK, OTHER = range(4)


def kinds(pieces) -> np.ndarray:
    """By code point: blank, Latin letter, ASCII mark or digit, other. All but the blank are others if a piece mixes letters and marks."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for a, b in ("AZ", "az", "ÀÖ", "Øö", "øɏ"):
        kind[ord(a) : ord(b) + 1] = LETTER
    kind[:128][kind[:128] == OTHER] = MARK
    kind[32] = BLANK
    if any({kind[ord(a)], kind[ord(b)]} == {LETTER, MARK} for p in pieces for a, b in pairwise(p)):
        kind[kind != BLANK] = OTHER
    return kind


def cut(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where stretches that no piece crosses begin, in texts put together that begin at ``first``, by the kinds of their characters.

    A word is its blanks and what follows up to the next. It is cut where letters meet marks, but not behind its first
    run of either that others follow.
    """
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(len(kind), bool)
    begins[first] = opens[first] = True
    run = np.flatnonzero(begins)
    kind = kind[run]
    word = (kind == BLANK) | opens[run]
    others = np.cumsum(kind == OTHER)
    before = (others - (kind == OTHER))[word]
    plain = others == before[np.cumsum(word) - 1]
    plain[1:] &= kind[:-1] != BLANK
    return run[word | plain]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Lattices:
    """The forward search over many stretches at once; the trie of the pieces is a table of (node, character) to node."""

    def __init__(self, piece: dict):
        chars = sorted({c for p in piece for c in p})
        self.of_char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.of_char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nodes: dict[str, int] = {"": 0}
        for p in piece:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.width = len(chars) + 1
        keys = np.array([nodes[x[:-1]] * self.width + int(self.of_char[ord(x[-1])]) for x in nodes if x], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.arange(1, len(nodes))[order]
        self.root = np.zeros(self.width, np.int64)
        self.root[self.keys[self.keys < self.width]] = self.to[self.keys < self.width]
        self.score, self.id = np.full(len(nodes), -np.inf), np.full(len(nodes), -1)
        for p, (v, i) in piece.items():
            self.score[nodes[p]], self.id[nodes[p]] = v, i

    def whole(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which stretches have a piece for each of their characters."""
        return np.logical_and.reduceat(self.id[self.root[self.of_char[code]]] >= 0, first)

    def edges(self, code: np.ndarray, end: np.ndarray):
        """(places where pieces begin, nodes they lead to) for each length of a piece. ``end``: of the stretch, by place."""
        char = self.of_char[code]
        at, node, n = np.arange(len(code)), self.root[char], 1
        while len(at):
            at, node = at[node > 0], node[node > 0]
            is_piece = self.id[node] >= 0
            yield at[is_piece], node[is_piece]
            more = at + n < end[at]
            at = at[more]
            key = node[more] * self.width + char[at + n]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[found] == key, self.to[found], 0)
            n += 1

    def search(self, code: np.ndarray, size: np.ndarray) -> tuple:
        """(ids one after the other, numbers of ids, scores, losses of the second best) of stretches of up to SHORT characters that all are pieces, as Segmenter.one_best finds them."""
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        at, node, length = [], [], []
        for n, (a, b) in enumerate(self.edges(code, (first + size)[of]), 1):
            at.append(a)
            node.append(b)
            length.append(np.full(len(a), n))
        at, node, length = map(np.concatenate, (at, node, length))
        # Edges by the place in the stretch where they end, long ones first; none of a group ends where another does.
        group = ((at - first[of[at]] + length) * (SHORT + 1) + SHORT - length).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        at, node, length, group = at[order], node[order], length[order], group[order]
        start, score, ids = at + of[at], self.score[node], self.id[node]  # a stretch has a place more than characters
        best, second = np.full((2, len(code) + len(size)), -np.inf)
        back = np.zeros(len(best), np.int64)
        best[first + np.arange(len(size))] = 0
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            x, y = start[a:b], start[a:b] + length[a]
            v, was = best[x] + score[a:b], best[y]
            second[y] = np.maximum(np.maximum(second[y], second[x] + score[a:b]), np.minimum(v, was))
            best[y] = np.maximum(v, was)
            back[y[v > was]] = np.flatnonzero(v > was) + a
        last = first + size + np.arange(len(size))
        which, place, path = np.arange(len(size)), last.copy(), []
        while len(which):
            edge = back[place]
            path.append((which, ids[edge]))
            place = start[edge]
            more = place > (first + np.arange(len(size)))[which]
            which, place = which[more], place[more]
        counts = np.bincount(np.concatenate([w for w, _ in path]), minlength=len(size))
        out, ends = np.zeros(counts.sum(), np.int32), np.cumsum(counts)
        for step, (which, found) in enumerate(path):
            out[ends[which] - 1 - step] = found
        return out, counts, best[last], best[last] - second[last]


class Segmenter:
    """Segmentations of texts; the best ones of their stretches are kept, up to a bound, until forget()."""

    def __init__(self, normal: list, of_byte: list, shown: list, nbest: int = 4, proto: bytes | None = None, merges: bool = True):
        self.merges = merges
        self.library = _library(proto + NO_PREFIX) if proto else None
        self.piece = {p: (s, i) for p, s, i in normal}
        if any(" " in p.lstrip(" ") for p in self.piece):
            raise ValueError("a piece holds a blank behind another character")
        self.trie: dict[str, list] = {}  # character: [what may follow, score or None, id]
        for p, (score, i) in self.piece.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, [{}, None, None])[0]
            node.setdefault(p[-1], [{}, None, None])[1:] = score, i
        self.of_byte, self.nbest = of_byte, nbest
        self.shown, self.sizes = np.frombuffer(b"".join(shown), np.uint8), np.fromiter(map(len, shown), np.int64, len(shown))  # what ids decode to, one after the other
        self.places = np.cumsum(self.sizes) - self.sizes
        self.unknown = min((s for _, s, _ in normal), default=0.0) - 10
        self.value = np.zeros(1 + max([*of_byte, *(i for _, _, i in normal)]))  # by id; a character's first byte has that of the character
        for b, i in enumerate(of_byte):
            self.value[i] = 0 if 0x80 <= b < 0xC0 else self.unknown
        for _, s, i in normal:
            self.value[i] = s
        self.kind = kinds(self.piece)
        self.lattices = Lattices(self.piece)
        self.lists = lru_cache(20_000)(self.best_of)
        self.forget()

    def forget(self) -> None:
        """Drop what is kept: an idle worker, of which an executor can have many, holds no more than the pieces."""
        self.number: dict[str, int] = {}  # of a stretch
        self.score, self.loss = np.zeros((2, 0))
        self.ids, self.own = (np.zeros(0, np.int32), np.zeros(1, np.int64)), (np.zeros(0, np.int32), np.zeros(1, np.int64))  # one after the other, and ends
        self.lists.cache_clear()

    def learn(self, new: list[str]) -> None:
        """Number stretches, and keep their best ids, score, loss of the second best, and ids by merges."""
        short = [t for t in new if len(t) <= SHORT]
        found = []
        if short:
            code = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.fromiter(map(len, short), np.int64, len(short))
            whole = self.lattices.whole(code, np.cumsum(size) - size)
            if whole.any():
                found.append(self.lattices.search(code[np.repeat(whole, size)], size[whole]))
            rest = [t for t, w in zip(short, whole.tolist()) if not w] + [t for t in new if len(t) > SHORT]
            new = [t for t, w in zip(short, whole.tolist()) if w] + rest
        else:
            rest = new
        if rest:
            ids, score, loss = zip(*map(self.one_best, rest))
            found.append((np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64), np.array(score), np.array(loss)))
        ids, counts, score, loss = (np.concatenate(x) for x in zip(*found))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.ids = self._longer(self.ids, ids, counts)
        if self.merges:
            own = self._own(new)
            self.own = self._longer(self.own, np.fromiter(chain.from_iterable(own), np.int32), np.fromiter(map(len, own), np.int64))

    @staticmethod
    def _longer(kept: tuple, ids: np.ndarray, counts: np.ndarray) -> tuple:
        return np.concatenate([kept[0], ids.astype(np.int32)]), np.concatenate([kept[1], kept[1][-1] + np.cumsum(counts)])

    @staticmethod
    def _of(kept: tuple, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered stretches one after the other, and where each begins, with the end of all."""
        first, count = kept[1][numbers], kept[1][numbers + 1] - kept[1][numbers]
        return kept[0][ranges(first, count)], np.concatenate([[0], np.cumsum(count)])

    def lattice(self, text: str) -> list[list[tuple]]:
        """Edges (start, score, id or None for bytes) by end."""
        ends: list[list[tuple]] = [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            if text[i] not in self.piece:
                ends[i + 1].append((i, self.unknown, None))
            node = self.trie
            for j in range(i, len(text)):
                if (hit := node.get(text[j])) is None:
                    break
                node, s, k = hit
                if s is not None:
                    ends[j + 1].append((i, s, k))
        return ends

    @staticmethod
    def forward(ends: list[list[tuple]]) -> tuple[list[float], list]:
        """Best score of each prefix, and the edge that reaches it; the longest piece wins ties."""
        best, back = [0.0], [None]
        for edges in ends[1:]:
            top, by = -math.inf, None
            for e in edges:
                if (s := best[e[0]] + e[1]) > top:
                    top, by = s, e
            best.append(top)
            back.append(by)
        return best, back

    def ids_of(self, text: str, start: int, end: int, k) -> list[int]:
        return [k] if k is not None else [self.of_byte[b] for b in text[start:end].encode()]

    def one_best(self, text: str) -> tuple:
        """(ids, score, loss of the second best) of a stretch that is long or has characters without a piece."""
        # Forward Viterbi with the two best scores of each prefix, edge by edge as the lattice unfolds.
        n, low, trie, piece = len(text), -math.inf, self.trie, self.piece
        best, next_, back = [0.0] + [low] * n, [low] * (n + 1), [None] * (n + 1)
        for i, c in enumerate(text):
            one, two, j = best[i], next_[i], i
            if c not in piece:
                best[j + 1], next_[j + 1], back[j + 1] = self._two(best[j + 1], next_[j + 1], back[j + 1], one + self.unknown, two + self.unknown, (i, None))
            node = trie
            while j < n:
                hit = node.get(text[j])
                if hit is None:
                    break
                node, s, k = hit
                j += 1
                if s is not None:
                    v = one + s
                    if v > best[j]:
                        if (w := best[j]) > next_[j]:
                            next_[j] = w
                        best[j], back[j] = v, (i, k)
                    elif v > next_[j]:
                        next_[j] = v
                    if (w := two + s) > next_[j]:
                        next_[j] = w
        path, j = [], n
        while j:
            i, k = back[j]
            path.append(self.ids_of(text, i, j, k))
            j = i
        total = best[n]
        return [k for p in reversed(path) for k in p], total, total - next_[n]

    def _own(self, texts: list[str]) -> list[list[int]]:
        """Ids by merges. The library reads a U+2581 as a blank, so it gets stretches that hold none."""
        if self.library is None:
            return list(map(self.merged, texts))
        if "▁" not in "".join(texts):
            return self.library.encode(texts, num_threads=1)
        some = iter(self.library.encode([t for t in texts if "▁" not in t], num_threads=1))
        return [self.merged(t) if "▁" in t else next(some) for t in texts]

    def merged(self, text: str) -> list[int]:
        """Ids by merges, without the library: of all neighbours that make a piece the likeliest become one, the first of equals, until none are left."""
        piece, n = self.piece, len(text)
        ends, before, queue = list(range(1, n + 1)), list(range(-1, n)), []  # of the symbol that starts at a place; 0: none does

        def offer(i: int, j: int, k: int) -> None:
            if (hit := piece.get(text[i:k])) is not None:
                heapq.heappush(queue, (-hit[0], i, j, k))

        for i in range(n - 1):
            offer(i, i + 1, i + 2)
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if ends[i] != j or ends[j] != k:
                continue
            ends[i], ends[j] = k, 0
            before[k] = i
            if k < n:
                offer(i, k, ends[k])
            if i:
                offer(before[i], i, k)
        ids, i = [], 0
        while i < n:
            ids += self.ids_of(text, i, ends[i], piece.get(text[i : ends[i]], (0, None))[1])
            i = ends[i]
        return ids

    @staticmethod
    def _two(best, next_, back, v, w, edge):
        """The two best scores of a prefix and the best one's edge, once another edge has come."""
        return (v, max(next_, best, w), edge) if v > best else (best, max(next_, v, w), back)

    def best_of(self, text: str) -> list[tuple[float, tuple]]:
        """The N best (score, ids) of a stretch: A* backwards, the forward scores as its heuristic."""
        ends = self.lattice(text)
        best, _ = self.forward(ends)
        # Of equal estimates the path that has come furthest goes first, or ties would be searched breadth first.
        queue, order, out = [(-best[-1], len(text), 0, 0.0, ())], 0, []
        while queue and len(out) < self.nbest:
            total, j, _, behind, tail = heapq.heappop(queue)
            if j == 0:
                out.append((behind, tuple(k for ids in _unrolled(tail) for k in ids)))
                continue
            for i, s, k in ends[j]:
                order += 1
                heapq.heappush(queue, (-round(best[i] + s + behind, 6), i, order, s + behind, (self.ids_of(text, i, j, k), tail)))
        return out

    def encode(self, text: str) -> tuple[list[int], float, list[float], list[int], list[int], float]:
        """Ids and score of the best segmentation, scores of the N best, ids of the second best (none: empty), ids and score by merges."""
        ids, score, scores, second, merged, by_merges = next(self.encode_all([text]))
        return ids.tolist(), score, scores, second.tolist(), merged.tolist(), by_merges

    def encode_all(self, texts: list[str]):
        """The same for each of many texts, ids as arrays."""
        texts = [" " + t if t else "" for t in texts]
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = cut(self.kind[np.frombuffer(joined.encode("utf-32-le"), np.uint32)], (ends - sizes)[sizes > 0])
        raw = joined.encode()
        place = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)  # of each character
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(place[starts], len(raw))), pa.py_buffer(raw)).dictionary_encode()
        known, of = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        numbers = self._numbers(known)
        if (new := numbers < 0).any():
            if len(self.number) + np.count_nonzero(new) > KEPT:
                self.forget()
                new[:] = True
            self.learn(some := known[new].tolist())
            numbers[new] = self._numbers(some)
        numbers = numbers[of]
        ids, begin = self._of(self.ids, numbers)
        own, own_begin = self._of(self.own, numbers) if self.merges else (ids[:0], np.zeros_like(begin))
        scores, losses, b = self.score[numbers].tolist(), self.loss[numbers], 0
        for end in np.searchsorted(starts, ends).tolist():
            a, b = b, end
            yield self._encode(known, of[a:b], ids[begin[a] : begin[b]], begin[a : b + 1] - begin[a], math.fsum(scores[a:b]), losses[a:b], own[own_begin[a] : own_begin[b]])

    def _numbers(self, stretches) -> np.ndarray:
        """-1: not known."""
        return np.fromiter(map(self.number.get, stretches, repeat(-1)), np.int64, len(stretches))

    def _encode(self, known: np.ndarray, of: np.ndarray, ids: np.ndarray, begin: np.ndarray, score: float, loss: np.ndarray, merged: np.ndarray) -> tuple:
        near = np.argsort(loss, kind="stable")[: self.nbest - 1] if len(loss) < 64 else self._nearest(loss)
        near = [i for i in near.tolist() if loss[i] < math.inf]
        lists = [self.lists(known[of[i]]) for i in near]
        # Best first over the places in the lists; a place is reached from the one with its last step undone.
        queue, picks = [(0.0, (0,) * len(lists))], []
        while queue and len(picks) < self.nbest:
            cost, at = heapq.heappop(queue)
            picks.append((cost, at))
            last = max((i for i, a in enumerate(at) if a), default=0)
            for i in range(last, len(at)):
                if at[i] + 1 < len(lists[i]):
                    step = lists[i][at[i]][0] - lists[i][at[i] + 1][0]
                    heapq.heappush(queue, (cost + step, (*at[:i], at[i] + 1, *at[i + 1 :])))
        second = ids[:0]
        if len(picks) > 1:
            put, at = [], 0
            for i, nth, own in sorted(zip(near, picks[1][1], lists)):
                if nth:
                    put += [ids[at : begin[i]], np.array(own[nth][1], np.int32)]
                    at = begin[i + 1]
            second = np.concatenate([*put, ids[at:]])
        return ids, score, [score - c for c, _ in picks], second, merged, float(self.value[merged].sum()) if len(merged) else 0.0

    def _nearest(self, loss: np.ndarray) -> np.ndarray:
        """Places of the N - 1 smallest, the first of equals."""
        bound = np.partition(loss, self.nbest - 2)[self.nbest - 2]
        some = np.flatnonzero(loss <= bound)
        return some[np.argsort(loss[some], kind="stable")][: self.nbest - 1]

    def decode(self, ids) -> str:
        """The text: pieces and bytes put together, without the blank that encoding sets before it."""
        return self.raw(ids).decode()

    def raw(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        some = (ids[a : a + (1 << 16)] for a in range(0, len(ids), 1 << 16))
        return b"".join(self.shown[ranges(self.places[x], self.sizes[x])].tobytes() for x in some)[1:]


def _unrolled(tail):
    while tail:
        yield tail[0]
        tail = tail[1]


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


@lru_cache(1)
def _segmenter(proto: bytes, ranks: bool, nbest: int, merges: bool) -> Segmenter:
    """One for all tasks of a worker, which forget what they have kept."""
    return Segmenter(*load(proto, ranks), nbest, proto, merges)


def _runner(shipped, ranks: bool, nbest: int, merges: bool, own: bool, schema: str):
    def run(batches):
        seg = _segmenter(shipped.value, ranks, nbest, merges)
        kinds = (pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.string())
        try:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for a, b in byte_slices([range(n) for n in sizes], 1 << 18):  # the search takes some 200 bytes for each byte of new stretches
                    out, texts = [], [t or b"" for t in batch.column(1).slice(a, b - a).to_pylist()]
                    for raw, (ids, score, scores, second, merged, by_merges) in zip(texts, seg.encode_all([t.decode() for t in texts])):
                        ids = merged if own else ids
                        back = seg.raw(ids)
                        out.append((ids, len(ids), score, scores, _digest(second) if len(second) else None, hashlib.sha256(back).hexdigest(), back == raw, *((len(merged), by_merges, _digest(merged)) if merges else ())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], [f.split()[0] for f in schema.split(", ")])
        finally:
            seg.forget()
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, nbest: int = 4, ranks: bool = True, merges: bool = False, own: bool = False) -> DataFrame:
    """One row per row of ``docs``, in the columns of SCHEMA: the best ids, the scores of the N best segmentations,
    a digest of the second best ids (null if there is none), and whether decoding gives the text back. With ``merges``, the
    columns of MERGED follow: number, score and a digest of the ids that merges give. With ``own``, they do too, and ids
    are these instead of the best. ``ranks``: the file's
    scores are ranks; else they are log probabilities. Of segmentations that tie the one whose last piece is longest
    comes first. A U+2581 of the text's own is written as its bytes, so that it comes back; the file's library reads it as
    a blank. Other columns, whatever their names, are not read; an empty table gives an empty table.

    A null text is empty; an empty text has no ids, score 0 and itself as its only segmentation. Null and repeated
    ids pass through; equal texts get equal values. Texts are encoded whole, a text at a time.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())  # half a megabyte, whatever the corpus
    merges, schema = merges or own, f"{SCHEMA}, {MERGED}" if merges or own else SCHEMA
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_runner(shipped, ranks, nbest, merges, own, schema), schema)


def ids_digest(ids: str = "ids"):
    """SHA-256 of the ids in decimal, parted by blanks."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256)
