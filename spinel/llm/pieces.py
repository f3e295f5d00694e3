"""SentencePiece encoding and decoding with the N best segmentations.

The pieces and scores come from a public .model file; text becomes a lattice of pieces after the model's own escape (a space is
written as U+2581, one is put before the text). A character without a piece of its own costs the least score of the vocabulary less
``UNKNOWN_PENALTY`` and is encoded as its UTF-8 bytes. A forward Viterbi pass gives each position the score of the best way to reach
it; a backward A* search from the end then uses exactly that score as its estimate of the rest, so it is exact and yields the
segmentations in order of their scores.

If no piece has U+2581 behind another character and none holds a newline, which is checked when a model is read, the lattice falls
apart at these places and the search runs in each part; otherwise a text is one part. Parts that a worker hasn't met lately go through
the forward pass many at a time, and the same search runs over the few parts whose second choice costs least. This gives exactly the
N best of the whole text (tests compare with all segmentations).

Ties: of the best segmentations of a part with one score, the one whose last piece is shortest, then the one before that, and so on. Of
further segmentations of a text with one score, those that change earlier parts come first. So all depends on the text and the model
alone. Defined cases: null and empty texts have no pieces, one segmentation of score 0, and decode to the empty text; every row is
encoded alone, so repeated rows give repeated results; very long texts are encoded whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE = SPACE.encode()
UNKNOWN_PENALTY = 10.0
#: Parts of text whose result a worker keeps, and those with all N segmentations; this changes no result.
KEEP, KEEP_ALL = 120_000, 20_000
#: Characters of a part beyond which the search runs in its cuts.
LONG = 48
#: Documents and characters whose parts are looked up together, and characters of unseen parts that are.
GROUP, GROUP_CHARS, CELLS = 200, 1_000_000, 60_000
PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def split(text: str | None) -> list[str]:
    """The parts between which no piece reaches."""
    return PART.findall(SPACE + text.replace(" ", SPACE)) if text else []


_P = 0x9E3779B97F4A7C15


def _hash(piece: str) -> int:
    h = 0
    for ch in piece:
        h = (h * _P + ord(ch) + 1) & (2**64 - 1)
    return h


class Known(dict):
    """Numbers of parts; a part not seen before gets the next one and is listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n

    def all(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), dtype=np.int64, count=len(parts))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Lookup:
    """64-bit keys in an open table; the number of each key, or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.deep = np.uint64(64 - bits), np.int64((1 << bits) - 1), 0
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys))
        while len(rest):
            slot = self._slot(keys[rest], self.deep)
            free = self.number[slot] < 0
            slot, own = slot[free], rest[free]
            slot, first = np.unique(slot, return_index=True)
            self.key[slot], self.number[slot] = keys[own[first]], own[first]
            rest = np.setdiff1d(rest, own[first], assume_unique=True)
            self.deep += 1

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return (((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64) + k) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h, 0)
        out = np.where(self.key[slot] == h, self.number[slot], -1)
        rest = np.flatnonzero((out < 0) & (self.number[slot] >= 0))
        for k in range(1, self.deep):
            if not len(rest):
                break
            slot = self._slot(h[rest], k)
            same = (self.key[slot] == h[rest]) & (self.number[slot] >= 0)
            out[rest[same]] = self.number[slot[same]]
            rest = rest[~same & (self.number[slot] >= 0)]
        return out


class Lattice:
    """The pieces of one model, and what a worker knows of parts met so far."""

    def __init__(self, model_file: str = MODEL, nbest: int = 4):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.nbest = nbest
        self.bytes, self.score, raw = {}, {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                raw.append(bytes([int(p[1:-1], 16)]))
                continue
            raw.append(p.encode())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p] = (i, sp.get_score(i))
        self.unk = sp.unk_id()
        self.floor = min((s for _, s in self.score.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.apart = all("\n" not in p and SPACE not in p.lstrip(SPACE) for p in self.score)
        #: Every beginning of a piece; those that are pieces have their id and score.
        self.trie: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.score for k in range(1, len(p) + 1)} | self.score
        #: Neighbours inside some piece; between any others the lattice can be cut.
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.lookup = Lookup(np.array([_hash(p) for p in self.trie], dtype=np.uint64))
        self.key_id = np.array([-1 if x is None else x[0] for x in self.trie.values()], dtype=np.int32)
        self.key_score = np.array([-np.inf if x is None else x[1] for x in self.trie.values()])
        self.deepest = max(map(len, self.trie), default=1)
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self._forget()

    def _forget(self) -> None:
        self.known, self.some = Known(), {}
        #: By part: best score, what the second choice costs, and where its ids lie in ``flat``.
        self.best, self.cost = np.zeros(1024), np.zeros(1024)
        self.at, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def split(self, text: str | None) -> list[str]:
        if self.apart or not text:
            return split(text)
        return [SPACE + text.replace(" ", SPACE)]

    def unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unk,)

    def forward(self, part: str) -> tuple[list[float], list[list[tuple[int, float, int | None]]]]:
        """Viterbi: the best score of reaching each position, and the (start, score, id) of the pieces that end there; id None: unknown."""
        size, trie = len(part), self.trie
        best = [0.0] + [-np.inf] * size
        edges: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            at, j = best[i], i + 1
            got = trie.get(part[i:j])
            if got is None:
                edges[j].append((i, self.floor, None))
                if at + self.floor > best[j]:
                    best[j] = at + self.floor
                if part[i:j] not in trie:
                    continue
            while True:
                if got is not None:
                    s = at + got[1]
                    edges[j].append((i, got[1], got[0]))
                    if s > best[j]:
                        best[j] = s
                j += 1
                if j > size:
                    break
                sub = part[i:j]
                got = trie.get(sub)
                if got is None and sub not in trie:
                    break
        return best, edges

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of one part, best first: backward A* with the forward scores as its estimate of the rest.

        Of equal estimates the newest goes on, and the shortest piece is entered last: so the first result follows the rule for ties.
        """
        best, edges = self.forward(part)
        size, out, order = len(part), [], itertools.count(1)
        heap: list = [(-best[size], 0, size, 0.0, None)]
        while heap:
            _, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                out.append((behind, self._ids(part, path)))
                if len(out) == n:
                    break
                continue
            for i, s, p in edges[at]:
                heapq.heappush(heap, (-(best[i] + behind + s), -next(order), i, behind + s, ((i, p), path)))
        return out

    def _ids(self, part: str, path) -> tuple[int, ...]:
        ids: list[int] = []
        while path is not None:
            (i, p), path = path
            ids.extend(self.unknown(part[i]) if p is None else (p,))
        return tuple(ids)

    def first(self, part: str) -> tuple[float, tuple[int, ...], float]:
        """Best score and ids, and what the second choice costs.

        The best path is the search's first pop. Any other path uses an edge beside it, so the second score is the largest of forward
        score, edge and backward score over those edges.
        """
        best, edges = self.forward(part)
        size = len(part)
        back = [-np.inf] * size + [0.0]
        on, path, at = set(), None, size
        for j in range(size, 0, -1):
            for i, s, _ in edges[j]:
                if back[j] + s > back[i]:
                    back[i] = back[j] + s
        while at:
            e = next(x for x in reversed(edges[at]) if best[x[0]] + x[1] == best[at])
            on.add((at, e))
            at = e[0]
        ids: list[int] = []
        for _, (i, _, p) in sorted(on):
            ids.extend(self.unknown(part[i]) if p is None else (p,))
        second = max((best[i] + s + back[j] for j in range(1, size + 1) for i, s, p in edges[j] if (j, (i, s, p)) not in on), default=-np.inf)
        return best[size], tuple(ids), best[size] - second

    def cuts(self, part: str) -> list[str]:
        """The part, cut wherever no piece has both neighbours."""
        inside, out, at = self.inside, [], 0
        for k in range(1, len(part)):
            if part[k - 1 : k + 1] not in inside:
                out.append(part[at:k])
                at = k
        out.append(part[at:])
        return out

    def learn(self) -> None:
        """The forward pass for all parts that are new, many at once by their length."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        base = len(self.known) - len(new)
        lens = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        long = {int(i): self.cuts(new[i]) for i in np.flatnonzero(lens > LONG)}
        cut = {i: self.known.all(own) for i, own in long.items() if len(own) > 1}
        self.learn()  # what the cuts brought; these can't be cut again
        self._room(len(self.known), 0)
        least = 0
        for size in (4, 8, 12, 16, 24, 32, LONG):
            own = np.flatnonzero((lens > least) & (lens <= size))
            least, step = size, max(1, CELLS // size)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                self._put(base + some, *self._many([new[i] for i in some.tolist()], size))
        for i in long:
            if i in cut:
                n = cut[i]
                ids = self.flat[ragged(self.at[n], self.len[n])]
                got = self.best[n].sum(), ids, self.cost[n].min()
            else:
                got = self.first(new[i])
            self._put(np.array([base + i]), np.array([got[0]]), np.array([got[2]]), np.array(got[1], dtype=np.int32), np.array([len(got[1])]))

    def _room(self, parts: int, ids: int) -> None:
        def grown(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

        self.best, self.cost, self.at, self.len = (grown(x, parts) for x in (self.best, self.cost, self.at, self.len))
        self.flat = grown(self.flat, ids)

    def _put(self, number: np.ndarray, best: np.ndarray, cost: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        self._room(0, self.used + len(ids))
        self.best[number], self.cost[number], self.len[number] = best, cost, length
        self.at[number] = self.used + np.cumsum(length) - length
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _many(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of at most ``size`` characters, position by position over all words: best scores, costs of the second choice, the
        ids of all one after another, and how many each has."""
        n = len(words)
        codes = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
        deep = min(self.deepest, size)
        score = np.full((deep + 1, size, n), -np.inf)
        ids = np.full((deep + 1, size, n), -1, dtype=np.int32)
        row, col = np.nonzero(np.arange(size)[None, :] < lens[:, None])
        h = np.zeros(len(row), dtype=np.uint64)
        used = np.zeros((deep + 1, size), dtype=bool)  # lengths of pieces that begin at a position in some word
        used[1] = True
        for k in range(1, deep + 1):
            h = h * np.uint64(_P) + codes[row, col + k - 1]
            at = self.lookup.find(h)
            found = at >= 0
            row, col, h, at = row[found], col[found], h[found], at[found]
            if not len(row):
                break
            used[k, col] = True
            score[k, col, row], ids[k, col, row] = self.key_score[at], self.key_id[at]
            more = col + k < lens[row]
            row, col, h = row[more], col[more], h[more]
        score[1] = np.where(ids[1] >= 0, score[1], self.floor)
        best, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        best[0], step = 0.0, np.zeros((size + 1, n), dtype=np.int8)
        for j in range(1, size + 1):
            for k in range(1, min(j, deep) + 1):
                if not used[k, j - k]:
                    continue
                s = score[k, j - k]
                a = best[j - k] + s
                np.maximum(second[j], second[j - k] + s, out=second[j])
                np.maximum(second[j], np.minimum(best[j], a), out=second[j])
                better = a > best[j]
                step[j][better] = k
                np.maximum(best[j], a, out=best[j])
        every = np.arange(n)
        at, count = lens.copy(), np.zeros(n, dtype=np.int64)
        out, begin, live = np.zeros((n, size), dtype=np.int32), np.zeros((n, size), dtype=np.int64), every
        while len(live):
            k = step[at[live], live].astype(np.int64)
            at[live] -= k
            count[live] += 1
            out[live, size - count[live]] = ids[k, at[live], live]
            begin[live, size - count[live]] = at[live]
            live = live[at[live] > 0]
        with np.errstate(invalid="ignore"):
            cost = best[lens, every] - second[lens, every]
        own = np.arange(size)[None, :] >= (size - count)[:, None]
        flat = out[own]
        strange = np.flatnonzero(flat < 0)
        if len(strange):  # characters without a piece
            word = np.repeat(every, count)
            own_ids = [self.unknown(words[w][b]) for w, b in zip(word[strange].tolist(), begin[own][strange].tolist(), strict=True)]
            length = np.ones(len(flat), dtype=np.int64)
            length[strange] = [len(x) for x in own_ids]
            to = np.cumsum(length) - length
            wide = np.empty(int(length.sum()), dtype=np.int32)
            wide[to] = flat
            wide[ragged(to[strange], length[strange])] = list(itertools.chain.from_iterable(own_ids))
            flat, count = wide, np.bincount(word, weights=length, minlength=n).astype(np.int64)
        return best[lens, every], cost, flat, count

    def options(self, part: str) -> list[tuple[float, np.ndarray, bool]]:
        """The N best of one part: score, ids, and whether they decode to the part."""
        got = self.some.get(part)
        if got is None:
            some = self.cuts(part) if len(part) > LONG else [part]
            found = self.search(part, self.nbest) if len(some) == 1 else self._chain([self.search(x, self.nbest) for x in some])
            plain = part.encode("utf-8", "surrogatepass")
            got = [(s, np.array(ids, dtype=np.int32), self.pieces_bytes(np.array(ids)) == plain) for s, ids in found]
            if len(self.some) >= KEEP_ALL:
                self.some.clear()
            self.some[part] = got
        return got

    def encode_group(self, texts: list[str | None], variants: bool) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[np.ndarray]], list[bool]]:
        """Ids of the best segmentations one after another, where each text's begin and end, scores of the N best of each text, with
        ``variants`` the ids of the others, and whether all of them decode to the text."""
        if len(self.known) > KEEP:
            self._forget()
        parts = [self.split(t) for t in texts]
        numbers = [self.known.all(p) for p in parts]
        self.learn()
        part_ends = np.cumsum([len(x) for x in numbers])
        number = np.concatenate([np.zeros(0, np.int64), *numbers])
        length, cost, best = self.len[number], self.cost[number], self.best[number]
        ids = self.flat[ragged(self.at[number], length)]
        begin = np.concatenate([[0], np.cumsum(length)])
        bounds = begin[np.concatenate([[0], part_ends])]
        raw = self.pieces_bytes(ids)
        raw_bounds = np.concatenate([[0], np.cumsum(self.raw_len[ids])])[bounds].tolist()
        few = self.nbest - 1
        scores, others, ok = [], [], []
        for d, (text, b) in enumerate(zip(texts, part_ends.tolist(), strict=True)):
            a = b - len(parts[d])
            plain = (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")
            ok.append(raw[raw_bounds[d] : raw_bounds[d + 1]].replace(_SPACE, b" ")[1:] == plain)
            others.append([])
            if a == b or not few:
                scores.append([float(best[a:b].sum())])
                continue
            # a solution among the N best changes only parts that are among the N - 1 cheapest to change
            c = cost[a:b]
            if len(c) > few:
                limit = np.partition(c, few - 1)[few - 1]
                cheap = np.flatnonzero(c < limit)
                cheap = np.sort(np.concatenate([cheap, np.flatnonzero(c == limit)[: few - len(cheap)]]))
            else:
                cheap = np.arange(len(c))
            choices = [(k, self.options(parts[d][k])) for k in cheap.tolist() if c[k] < np.inf]
            chain = self._chain([o for _, o in choices], keep=True)
            total = float(best[a:b].sum())
            scores.append([total - x for x, _ in chain])
            if variants:
                for _, chosen in chain[1:]:
                    joined, at = [], bounds[d]
                    for (k, options), j in zip(choices, chosen, strict=True):
                        if j:
                            joined += [ids[at : begin[a + k]], options[j][1]]
                            at = begin[a + k + 1]
                            ok[-1] = ok[-1] and options[j][2]
                    others[-1].append(np.concatenate([*joined, ids[at : bounds[d + 1]]]))
        return ids, bounds, scores, others, ok

    def encode(self, text: str | None, variants: bool = False) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
        """Ids of the best segmentation, scores of the N best, and with ``variants`` the ids of the others."""
        ids, _, scores, others, _ = self.encode_group([text], variants)
        return ids, scores[0], others[0]

    def _chain(self, lists: list[list[tuple]], keep: bool = False) -> list:
        """The N best of a chain of parts by the same search; the estimate of the rest is the sum of first choices.

        With ``keep`` (what it costs over the best, chosen indexes), else (score, ids).
        """
        out, heap, order = [], [(0.0, 0, ())], itertools.count(1)
        while heap and len(out) < self.nbest:
            cost, _, chosen = heapq.heappop(heap)
            if len(chosen) == len(lists):
                out.append((cost, chosen))
                continue
            options = lists[len(chosen)]
            for j, option in enumerate(options):
                heapq.heappush(heap, (cost + options[0][0] - option[0], next(order), (*chosen, j)))
        if keep:
            return out
        total = sum(o[0][0] for o in lists)
        return [(total - c, tuple(i for o, j in zip(lists, chosen, strict=True) for i in o[j][1])) for c, chosen in out]

    def pieces_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces one after another; byte pieces give their byte."""
        ids = np.asarray(ids, dtype=np.int64)
        return self.raw[ragged(self.raw_at[ids], self.raw_len[ids])].tobytes()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a segmentation's text."""
        return self.pieces_bytes(ids).replace(_SPACE, b" ")[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(model_file: str, nbest: int) -> Lattice:
    """One lattice for each worker process."""
    key = (model_file, nbest)
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(model_file, nbest)
    return _LATTICES[key]


def encode_documents(docs: DataFrame, model_file: str = MODEL, nbest: int = 4, variants: bool = False) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids (best), scores (N best), round_trip (decoding gives the text again).

    ``variants`` adds the ids of the other segmentations, which then have to give the text again too. U+2581 in a text decodes to a
    space, so such a text's round trip is checked against that.
    """
    ship(docs.sparkSession)

    def encoded(lat: Lattice, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds, scores, other, ok = lat.encode_group(batch.column("text").to_pylist(), variants)
        cols = {
            "doc_id": batch.column("doc_id"),
            "n_pieces": pa.array(np.diff(bounds), pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
            "scores": pa.array(scores, pa.list_(pa.float64())),
            "round_trip": pa.array(ok, pa.bool_()),
        }
        if variants:
            each = [x for o in other for x in o]
            inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, each)], dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *each]), pa.int32()))
            cols["variants"] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, other)], dtype=np.int32), inner)
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_file, nbest)
        try:
            yield from encode_batches(lat, batches)
        finally:
            lat._forget()  # idle workers would hold it

    def encode_batches(lat: Lattice, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(np.maximum(pc.fill_null(pc.utf8_length(whole.column("text")), 0).to_numpy(zero_copy_only=False), GROUP_CHARS // GROUP)) // GROUP_CHARS
            cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(whole)]
            for a, b in itertools.pairwise(cut):
                if a < b:
                    yield encoded(lat, whole.slice(a, b - a))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, scores array<double>, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", variants array<array<int>>" if variants else ""))


def decode_documents(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(model_file, 1)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [lat.decode(i) if i is not None else "" for i in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
