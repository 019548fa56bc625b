"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a SentencePiece BPE model file (its path is a parameter; it is read, never trained or copied).
A text gets one leading space, spaces become U+2581, and since no piece goes on from another character to U+2581,
the text falls into chunks - a run of U+2581 and what follows up to the next - that are encoded on their own.

In a chunk, an agenda holds every neighbouring pair of symbols whose join is a piece, ordered by the piece's score,
the leftmost first on a tie. A pair that comes up is skipped if a hash keyed by the seed, the document's id, the chunk,
its place in the document and the pair's place says so (with probability ``dropout``), and is merged otherwise; a merge
puts the pairs it forms on the agenda. So each occurrence of a word is drawn on its own, yet each run gives the same ids
on any number of executors. Occurrences of a chunk that skip the same merges share the work (see ``draw``; a worker also
remembers it, in bounded memory, see ``Known``), the draws are never shared; with ``variants`` above 0 there are only so many draws of a chunk. With dropout 0 the ids are those of the
SentencePiece library.

Characters without a piece, and U+2581 where the text itself has it, become byte pieces, so that decoding gives
back every text exactly. Null and empty texts have no ids. Rows are independent; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import prepare, table, tidy
from .text import column, mix, slices

MODEL = os.environ.get("LUMORA_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
DROPOUT, SEED, VARIANTS = 0.1, 17, 0
SPACE = "▁"
_LONG = 48  # chunks of more symbols go through the agenda one by one, in n log n steps
_SHARED = 3  # skipped merges up to which occurrences share their work; beyond, each is merged by itself
KNOWN, SLICE = 1 << 18, 3 << 17  # agendas that a worker keeps (it starts afresh beyond that), bytes encoded at a time
_U = np.uint64


class Vocabulary:
    """Pieces, their order, and the table of merges, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.bytes = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(pieces[i][1:-1], 16)] = i
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = np.full(n, len(order), dtype=np.int64)
        for i in self.ids.values():
            self.rank[i] = order[sp.get_score(i)]
        self.merge: dict[tuple[int, int], int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = i
        self.by_char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.by_char[ord(p)] = i
        bits = max(4, (4 * max(1, len(self.merge))).bit_length())
        self.shift, size = _U(64 - bits), 1 << bits
        self.keys, self.found = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        for (a, b), i in self.merge.items():  # open addressing; self.probes is the longest run
            key = a << 20 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.found[at] = key, i
        self.probes = 1
        for key in self.keys[self.keys >= 0].tolist():
            at, steps = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift), 1
            while self.keys[at] != key:
                at, steps = (at + 1) % size, steps + 1
            self.probes = max(self.probes, steps)
        texts = [bytes([int(pieces[i][1:-1], 16)]) if sp.is_byte(i) else (pieces[i].replace(SPACE, " ").encode() if plain[i] else b"") for i in range(n)]
        self.texts, self.lengths = np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, or -1."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), -1, dtype=np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        at = ((key[left].astype(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            have = self.keys[at]
            hit = have == key[left]
            out[left[hit]] = self.found[at[hit]]
            go = ~hit & (have >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) % len(self.keys)
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _place(start: np.ndarray | int, mid: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
    return np.asarray(start, dtype=_U) << _U(42) ^ np.asarray(mid, dtype=_U) << _U(21) ^ np.asarray(end, dtype=_U)


def _draw(chunk: np.ndarray | int, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.asarray(chunk, dtype=_U) ^ place * _U(0x9E3779B97F4A7C15))


def _key(chunk: np.ndarray | int, start: np.ndarray | int, mid: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
    """The keyed hash of a pair: chunk is the hash of seed, content, document and place."""
    return _draw(chunk, _place(start, mid, end))


def _limit(dropout: float) -> np.uint64:
    return _U(min((1 << 64) - 1, int(dropout * 2.0**64)))


def agenda(v: Vocabulary, ids: list[int], chunk: int, dropout: float) -> list[int]:
    """The symbols that a chunk ends with, by a heap of candidate merges."""
    n, limit = len(ids), int(_limit(dropout))
    own, nxt, prev, end = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live, heap = [True] * n, []

    def add(i: int, j: int) -> None:
        m = v.merge.get((own[i], own[j]))
        if m is not None:
            heapq.heappush(heap, (int(v.rank[m]), i, j, own[i], own[j], m))

    for i in range(n - 1):
        add(i, i + 1)
    while heap:
        _, i, j, a, b, m = heapq.heappop(heap)
        if not (live[i] and live[j]) or nxt[i] != j or own[i] != a or own[j] != b:
            continue
        if limit and int(_key(chunk, i, j, end[j])) < limit:
            continue
        own[i], live[j], nxt[i], end[i] = m, False, nxt[j], end[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            add(i, nxt[i])
        if prev[i] >= 0:
            add(prev[i], i)
    return [own[i] for i in range(n) if live[i]]


def merge_all(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray, chunks: np.ndarray, dropout: float, barred: np.ndarray | None = None, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What every chunk's agenda ends with: symbols, and bounds by chunk. One merge a chunk in each round, all chunks at once.

    barred: places that each chunk (of _LONG symbols at most) skips, in columns. log gets chunks and places of each round's merges.
    """
    sizes = np.diff(bounds)
    limit = _limit(dropout)
    seg = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)
    done_ids, done_seg, done_at = [], [], []

    def finish(i: np.ndarray, s: np.ndarray, a: np.ndarray) -> None:
        done_ids.append(i), done_seg.append(s), done_at.append(a)

    long = np.flatnonzero(sizes > _LONG)
    for c in long.tolist():
        got = agenda(v, ids[bounds[c] : bounds[c + 1]].tolist(), int(chunks[c]), dropout)
        finish(np.array(got, dtype=np.int32), np.full(len(got), c), np.arange(len(got)))
    keep = sizes[seg] <= _LONG
    ids, seg, start = ids[keep], seg[keep], start[keep]
    end = start + 1
    m = np.full(len(ids), -1, dtype=np.int32)  # what a symbol and the next join to, if that may be merged
    order = np.full(len(ids), 1 << 62, dtype=np.int64)  # when: by the score, then from the left
    fresh = np.arange(len(ids))
    while len(ids):
        look = fresh[fresh < len(ids) - 1]
        look = look[seg[look] == seg[look + 1]]
        m[fresh] = -1
        got = v.pairs(ids[look], ids[look + 1])
        if limit:
            near = np.flatnonzero(got >= 0)
            at = look[near]
            got[near[_key(chunks[seg[at]], start[at], start[at + 1], end[at + 1]) < limit]] = -1
        if barred is not None and barred.shape[1]:
            near = np.flatnonzero(got >= 0)
            at = look[near]
            places = _place(start[at], start[at + 1], end[at + 1])
            for column_ in barred.T:
                got[near[column_[seg[at]] == places]] = -1
        m[look] = got
        first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        order[fresh] = 1 << 62
        on = look[got >= 0]
        order[on] = v.rank[m[on]] << 24 | start[on]
        best = np.minimum.reduceat(order, first)
        open_ = best < 1 << 62
        count = np.diff(np.concatenate((first, [len(ids)])))
        if not open_.all():
            stay = np.repeat(open_, count)
            finish(ids[~stay], seg[~stay], start[~stay])
            ids, seg, start, end, m, order = ids[stay], seg[stay], start[stay], end[stay], m[stay], order[stay]
            best, count = best[open_], count[open_]
        if not len(ids):
            break
        left = np.flatnonzero(order == np.repeat(best, count))  # one a chunk
        if log is not None:
            log.append((seg[left], _place(start[left], start[left + 1], end[left + 1])))
        ids[left], end[left] = m[left], end[left + 1]
        gone = np.zeros(len(ids), dtype=bool)
        gone[left + 1] = True
        ids, seg, start, end, m, order = (x[~gone] for x in (ids, seg, start, end, m, order))
        left = left - np.arange(len(left))
        prior = left - 1
        prior = prior[prior >= 0]
        prior = prior[seg[prior] == seg[prior + 1]]
        near = np.zeros(len(ids), dtype=bool)
        near[left] = near[prior] = True
        fresh = np.flatnonzero(near)
    if not done_ids:
        return np.zeros(0, dtype=np.int32), np.zeros(len(sizes) + 1, dtype=np.int64)
    ids, seg, at = np.concatenate(done_ids), np.concatenate(done_seg), np.concatenate(done_at)
    order = np.lexsort((at, seg))
    return ids[order], np.concatenate(([0], np.cumsum(np.bincount(seg, minlength=len(sizes)))))


class Known:
    """Agendas that a worker has been through: what a chunk ends with if it skips certain merges, and the merges that it makes.

    An agenda is known by a hash of the chunk's content and of the places that it skips; it doesn't depend on who draws it.
    """

    def __init__(self) -> None:
        self.n, self.bits = 0, max(8, (2 * KNOWN - 1).bit_length() + 1)
        self.keys, self.number = np.zeros(1 << self.bits, dtype=_U), np.zeros(1 << self.bits, dtype=np.int32)  # open addressing; 0 is free
        self.symbols, self.places = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=_U)
        self.ends, self.merges = np.zeros((2, 1 << 12), dtype=np.int64), np.zeros((2, 1 << 12), dtype=np.int64)  # where each begins and how many it has

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= a.shape[-1]:
            return a
        out = np.zeros((*a.shape[:-1], max(n, 2 * a.shape[-1])), dtype=a.dtype)
        out[..., : a.shape[-1]] = a
        return out

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each agenda, -1 if it isn't known."""
        out, left, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self._spot(keys)
        while len(left):
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.number[at[hit]]
            go = ~hit & (have != 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def _insert(self, keys: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._spot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            spots, first = np.unique(at[free], return_index=True)
            put = free[first]  # of those that want a spot the first has it
            self.keys[spots], self.number[spots] = keys[left[put]], self.n + left[put]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)
        self.n += len(keys)

    def add(self, keys: np.ndarray, got: np.ndarray, gb: np.ndarray, places: np.ndarray, merges: np.ndarray) -> None:
        n = self.n
        if 2 * (n + len(keys)) > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.number[self.keys != 0]
            self.bits += max(1, (2 * (n + len(keys)) // len(self.keys)).bit_length())
            self.keys, self.number, self.n = np.zeros(1 << self.bits, dtype=_U), np.zeros(1 << self.bits, dtype=np.int32), 0
            self._insert(old[np.argsort(numbers)])
        s0 = int(self.ends[:, n - 1].sum()) if n else 0
        p0 = int(self.merges[:, n - 1].sum()) if n else 0
        to = n + len(keys)
        self.symbols, self.places = self._room(self.symbols, s0 + len(got)), self._room(self.places, p0 + len(places))
        self.ends, self.merges = self._room(self.ends, to), self._room(self.merges, to)
        self.symbols[s0 : s0 + len(got)], self.places[p0 : p0 + len(places)] = got, places
        self.ends[:, n:to] = s0 + gb[:-1], np.diff(gb)
        self.merges[:, n:to] = p0 + np.cumsum(merges) - merges, merges
        self._insert(keys)


@cache
def known(path: str) -> Known:
    return Known()


def _whole(v: Vocabulary, out: np.ndarray, ids: np.ndarray, flat: np.ndarray, got: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the chunks at the places flat, those without a piece as bytes; each of these is still one character, in order."""
    if not (got < 0).any():
        return got, gb
    raw_bytes = [chr(c).encode() for c in out[flat][ids[flat] < 0].tolist()]
    width = np.ones(len(got), dtype=np.int64)
    width[got < 0] = [len(b) for b in raw_bytes]
    seg = np.repeat(np.arange(len(gb) - 1), np.diff(gb))
    wide = np.repeat(got, width)
    wide[wide < 0] = v.bytes[np.frombuffer(b"".join(raw_bytes), dtype=np.uint8)]
    return wide, np.concatenate(([0], np.cumsum(np.bincount(np.repeat(seg, width), minlength=len(gb) - 1))))


def draw(v: Vocabulary, have: Known, out: np.ndarray, ids: np.ndarray, bounds: np.ndarray, h: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the agenda of every chunk ends with: symbols, and for each chunk where its own begin and how many they are.

    out, ids and bounds hold the chunks' characters and symbols, h hashes of their contents, and keys the hashes that
    decide what each skips. Those that skip none of the merges of their content's agenda end as it does; those
    whose first skipped merge is the same go on together from there, up to _SHARED skips; then each goes on alone.
    """

    def places_of(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(bounds)[chunks]
        to = np.concatenate(([0], np.cumsum(n)))
        return np.repeat(bounds[chunks] - to[:-1], n) + np.arange(to[-1]), to

    def look(nodes: np.ndarray, chunks: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """The number of each agenda; those not known yet are gone through."""
        at = have.find(nodes)
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, to = places_of(chunks[new])
            log: list = []
            got, gb = merge_all(v, ids[flat], to, np.zeros(len(new), dtype=_U), 0.0, barred[new], log)
            seg = np.concatenate([x for x, _ in log]) if log else np.zeros(0, dtype=np.int64)
            place = np.concatenate([x for _, x in log]) if log else np.zeros(0, dtype=_U)
            at[new] = have.n + np.arange(len(new))
            have.add(nodes[new], *_whole(v, out, ids, flat, got, gb), place[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(new)))
        return at

    limit = _limit(dropout)
    short = np.diff(bounds) <= _LONG
    number = np.zeros(len(keys), dtype=np.int64)
    alone = np.zeros(len(keys), dtype=bool)
    occ = np.flatnonzero(short)
    nodes, first, node = np.unique(h[occ], return_index=True, return_inverse=True)
    chunks, barred, done = occ[first], np.zeros((len(nodes), 0), dtype=_U), np.zeros(len(nodes), dtype=np.int64)
    for _ in range(_SHARED + 1 if limit else 1):
        if not len(occ):
            break
        at = look(nodes, chunks, barred)
        number[occ] = at[node]
        if not limit:
            occ = occ[:0]
            break
        begin, merges = have.merges[:, at]
        # each occurrence against the merges that it hasn't been held against
        n = (merges - done)[node]
        to = np.cumsum(n) - n
        row = np.repeat(np.arange(len(occ)), n)
        nth = np.arange(len(row)) - np.repeat(to - done[node], n)
        skip = np.flatnonzero(_draw(np.repeat(keys[occ], n), have.places[np.repeat(begin[node], n) + nth]) < limit)
        skip = skip[np.concatenate(([True], row[skip][1:] != row[skip][:-1]))] if len(skip) else skip
        branch, node_ = np.unique(node[row[skip]] * (_LONG + 1) + nth[skip], return_inverse=True)
        occ, parent, done = occ[row[skip]], branch // (_LONG + 1), branch % (_LONG + 1)
        place = have.places[begin[parent] + done]
        barred = np.column_stack((barred[parent], place))
        with np.errstate(over="ignore"):
            nodes = np.maximum(mix(nodes[parent] ^ mix(place + _U(len(barred.T)))), _U(1))
        chunks, node = chunks[parent], node_
    alone[occ] = alone[~short] = True
    start, size = have.ends[:, number]
    flat_ids = have.symbols
    if alone.any():
        own = np.flatnonzero(alone)
        to = own
        if not limit:  # long chunks, once for each content
            _, first, to = np.unique(h[own], return_index=True, return_inverse=True)
            own, twin = own[first], own
        flat, ob = places_of(own)
        got, gb = _whole(v, out, ids, flat, *merge_all(v, ids[flat], ob, keys[own], dropout))
        if limit:
            start[own], size[own] = len(flat_ids) + gb[:-1], np.diff(gb)
        else:
            start[twin], size[twin] = len(flat_ids) + gb[:-1][to], np.diff(gb)[to]
        flat_ids = np.concatenate((flat_ids, got))
    return flat_ids, start, size


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")


def encode_slice(v: Vocabulary, raw: np.ndarray, off: np.ndarray, docs: np.ndarray, dropout: float, seed: int, variants: int, have: Known | None = None) -> list[np.ndarray]:
    """The ids of each row of a slice; docs: a number for each row, that its draws are keyed by; have: agendas known from before."""
    have = Known() if have is None else have
    if have.n > KNOWN:
        have.__init__()
    lead = (raw & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[off]  # rows in code points
    cp = _code_points(raw)
    n = np.diff(at)
    shift = np.cumsum(n > 0)  # each row that isn't empty gets a space in front
    total = len(cp) + int((n > 0).sum())
    out = np.empty(total, dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(cp)) + shift[row]] = cp
    begin = at[:-1] + shift - 1
    begin = begin[n > 0]
    out[begin] = 32
    space = out == 32
    ids = v.by_char[out]
    ids[out == 0x2581] = -1
    ids[space] = v.ids[SPACE]
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[begin] = True
    cuts = np.flatnonzero(first)
    if not len(cuts):
        return [np.zeros(0, dtype=np.int32)] * len(n)
    bounds = np.concatenate((cuts, [total]))
    owner = np.repeat(np.arange(len(n))[n > 0], np.diff(np.searchsorted(cuts, np.concatenate((begin, [total])))))
    # a hash of each chunk's content, then of seed and variant
    with np.errstate(over="ignore"):
        h = mix(out.astype(_U) + _U(1))
        place = np.arange(total) - np.repeat(cuts, np.diff(bounds))
        h = np.maximum(np.add.reduceat(mix(h ^ place.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), cuts), _U(1))
        nth = np.arange(len(cuts)) - np.searchsorted(owner, owner)
        pick = mix(mix(docs.astype(np.int64).view(_U)[owner] ^ _U(seed)) + nth.astype(_U))
        if variants:
            pick %= _U(variants)
        keys = mix(mix(h ^ _U(seed)) + pick)
    flat_ids, start, size = draw(v, have, out, ids, bounds, h, keys, dropout)
    ends = np.cumsum(size)
    flat_ids = flat_ids[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]
    per_row = np.bincount(owner, weights=size, minlength=len(n)).astype(np.int64)
    return np.split(flat_ids, np.cumsum(per_row)[:-1])


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids, without the space that encoding put in front."""
    if not len(ids):
        return b""
    n = v.lengths[ids]
    ends = np.cumsum(n)
    raw = v.texts[np.repeat(v.offsets[ids] - (ends - n), n) + np.arange(int(ends[-1]))]
    return raw[1:].tobytes()


def decode(ids: list[int], model: str = MODEL) -> str:
    return decode_bytes(vocabulary(model), np.asarray(ids, dtype=np.int64)).decode("utf-8")


_OUT = "doc_id long, ids array<int>, n_tokens long, lossless boolean"


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gave the text back (it always should)."""
    prepare(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            ids = column(batch, "doc_id").cast(pa.int64())
            numbers = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi, raw, off in slices(column(batch, "text"), SLICE):
                rows = encode_slice(v, raw, off, numbers[lo:hi], dropout, seed, variants, known(model))
                good = [decode_bytes(v, r) == raw[off[i] : off[i + 1]].tobytes() for i, r in enumerate(rows)]
                n = np.array([len(r) for r in rows], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(rows).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], lists, pa.array(n), pa.array(good)], names=["doc_id", "ids", "n_tokens", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def decode_all(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents; null ids give an empty text."""
    prepare(encoded.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            texts = [decode_bytes(v, np.asarray(x or [], dtype=np.int64)).decode("utf-8") for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, and whether they decode to the text."""
    return encode(table(spark, sf_dir, "documents")).select(F.col("doc_id"), "ids", "n_tokens", "lossless")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE: dict[str, str] = {}
