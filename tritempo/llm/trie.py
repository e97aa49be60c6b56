"""An n-gram trie in Elias-Fano levels: words, monotone pointers and quantised probabilities of three orders.

All parts lie one after the other in one buffer, each at a multiple of 8 bytes, so that a trie is mapped, not read: from a
file with ``numpy.memmap`` or, inside a task, in an anonymous memory map. Words of a level are stored relative to their
context: they are numbered within the level's own vocabulary, and each range of siblings is shifted beyond the one before, so
that a whole level is one ascending sequence. A word is found by a successor search in its context's range.
"""

from __future__ import annotations

import mmap

import numpy as np

from tritempo.llm.common import distinct, ranked

#: decades that quantised log10 probabilities span, in 254 steps; code 0 is "absent"
DECADES = 9.0


def quantised(probability: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.rint((np.log10(probability) + DECADES) / DECADES * 254), 0, 254)).astype(np.uint8)


_DECODED = np.concatenate([[0.0], 10.0 ** (np.arange(255) / 254 * DECADES - DECADES)])


def probability_of(codes: np.ndarray) -> np.ndarray:
    return _DECODED[codes]


_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [bit for bit in range(8) if _byte >> bit & 1]
    _SELECT[_byte, : len(_ones)] = _ones


class Bits:
    """A bit vector of 64-bit words with counts before every word, for finding the n-th one or zero."""

    def __init__(self, words: np.ndarray, before: np.ndarray) -> None:
        self.words, self.before = words, before

    def _select(self, words: np.ndarray, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = np.searchsorted(before, number, "right") - 1
        rest = (number - before[at]).astype(np.int64)
        octets = words[at].view(np.uint8).reshape(-1, 8)
        held = np.cumsum(np.bitwise_count(octets), 1, dtype=np.int64)
        octet = (held <= rest[:, None]).sum(1)
        rows = np.arange(len(at))
        rest -= np.where(octet > 0, held[rows, np.maximum(octet - 1, 0)], 0)
        return at * 64 + octet * 8 + _SELECT[octets[rows, octet], rest]

    def one(self, number: np.ndarray) -> np.ndarray:
        """Place of the n-th one, from 0."""
        return self._select(self.words, self.before[:-1], number)

    def zero(self, number: np.ndarray) -> np.ndarray:
        """Place of the n-th zero, from 0."""
        zeros = np.arange(len(self.words)) * 64 - self.before[:-1]
        return self._select(~self.words, zeros, number)


class EliasFano:
    """An ascending sequence: low bits packed side by side, high bits in unary."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: Bits) -> None:
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """[header, low words, high words, counts] of values that ascend, at least one."""
        values = values.astype(np.uint64)
        count, top = len(values), int(values[-1])
        low_bits = max(0, ((top + 1) // count).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        octets = np.zeros((count * low_bits + 7) // 8 + 16, np.uint8)
        if low_bits:
            packed = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            octets[: len(packed)] = packed
        octets = np.concatenate([octets, np.zeros(-len(octets) % 8, np.uint8)])
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        size = (int(place[-1]) // 64 + 2) * 64
        marks = np.zeros(size, np.uint8)
        marks[place] = 1
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return [np.array([count, low_bits], np.int64), octets.view(np.uint64), words, before]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        word, shift = bit // 64, (bit % 64).astype(np.uint64)
        high = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | high) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self.high.one(at) - at).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(at)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first element that is not below each value, and whether it equals it; ``count`` if there is none."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        zeros = len(self.high.words) * 64 - int(self.high.before[-1])
        beyond = high >= zeros
        high = np.minimum(high, zeros - 1)
        # elements with these high bits lie between the zero before their run and the zero after it
        at = np.where(high > 0, self.high.zero(np.maximum(high - 1, 0)) - high + 1, 0)
        end = self.high.zero(high) - high
        at[beyond], end[beyond] = self.count, self.count
        equal = np.zeros(len(values), bool)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            held = self._low(at[open_])
            equal[open_[held == low[open_]]] = True
            open_ = open_[held < low[open_]]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return at, equal


def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, of_word: dict[int, int], of_pair: dict[tuple[int, int], int], strength: tuple[float, float]) -> np.ndarray:
    """The buffer of a trie of the n-grams u v w (words from 1 on; w 0: none) and their counts; all rows differ.

    p(v|u) = c(uv) / (c(u) + strength[0]) and p(w|uv) = c(uvw) / (c(uv) + strength[1]) are stored; the rest of the
    probability is the shorter context's. Counts of contexts are sums over the rows but for those given, whose n-grams lie in
    more than one trie.
    """
    parts: list[np.ndarray] = []
    first, u_at = ranked(u)
    second, v_at = ranked(v)
    sample, pair_at = distinct(u_at * len(second) + v_at)
    pair_key = (u_at * len(second) + v_at)[sample]
    pair_u, pair_v = pair_key // len(second), pair_key % len(second)
    c_pair = np.bincount(pair_at, count)
    c_word = np.bincount(pair_u, c_pair, len(first))
    for at in np.flatnonzero(np.isin(first, list(of_word))).tolist() if of_word else ():
        c_word[at] = of_word[int(first[at])]
    if of_pair:
        held = np.flatnonzero(np.isin(first[pair_u], [one for one, _ in of_pair]) & np.isin(second[pair_v], [two for _, two in of_pair]))
        for at, pair in zip(held.tolist(), zip(first[pair_u[held]].tolist(), second[pair_v[held]].tolist(), strict=True), strict=True):
            c_pair[at] = of_pair.get(pair, c_pair[at])
    p_pair = c_pair / (c_word[pair_u] + strength[0])
    some = w > 0
    third, w_at = ranked(w[some])
    order = np.argsort(pair_at[some] * max(1, len(third)) + w_at)
    triple_pair, triple_w = pair_at[some][order], w_at[order]
    p_triple = count[some][order] / (c_pair[triple_pair] + strength[1])
    for values in (first, second, _ranges(len(first), pair_u), _shifted(pair_u, pair_v, len(second))):
        parts += EliasFano.encode(values)
    parts.append(np.concatenate([quantised(p_pair), np.zeros(-len(p_pair) % 8, np.uint8)]).view(np.uint64))
    if len(third):
        for values in (third, _ranges(len(pair_key), triple_pair), _shifted(triple_pair, triple_w, len(third))):
            parts += EliasFano.encode(values)
        parts.append(np.concatenate([quantised(p_triple), np.zeros(-len(p_triple) % 8, np.uint8)]).view(np.uint64))
    sizes = np.array([len(part) for part in parts], np.int64)
    return np.concatenate([np.array([len(parts)], np.int64).view(np.uint64), sizes.view(np.uint64), *[part.view(np.uint64) for part in parts]])


def _ranges(parents: int, parent_of: np.ndarray) -> np.ndarray:
    """Where each parent's children begin, and the end: ascending."""
    return np.concatenate([[0], np.cumsum(np.bincount(parent_of, minlength=parents))])


def _shifted(parent_of: np.ndarray, child: np.ndarray, span: int) -> np.ndarray:
    """Children as one ascending sequence: the n-th range of siblings is shifted by n vocabularies."""
    return parent_of * span + child


class Trie:
    """A mapped trie."""

    def __init__(self, buffer: np.ndarray) -> None:
        count = int(buffer[0])
        ends = np.cumsum(buffer[1 : 1 + count].astype(np.int64)) + 1 + count
        parts = [buffer[begin:end] for begin, end in zip([1 + count, *ends[:-1].tolist()], ends.tolist(), strict=True)]

        def sequence(at: int) -> EliasFano:
            header, low, words, before = parts[at : at + 4]
            return EliasFano(int(header[0]), int(header[1]), low, Bits(words, before.view(np.int64)))

        self.first, self.second, self.pairs_of, self.pairs = (sequence(at) for at in (0, 4, 8, 12))
        self.p_pair = parts[16].view(np.uint8)
        self.deep = count > 17
        if self.deep:
            self.third, self.triples_of, self.triples = (sequence(at) for at in (17, 21, 25))
            self.p_triple = parts[29].view(np.uint8)

    @classmethod
    def mapped(cls, buffer: np.ndarray) -> Trie:
        """The trie in an anonymous memory map of its own."""
        raw = buffer.tobytes()
        held = mmap.mmap(-1, len(raw))
        held.write(raw)
        return cls(np.frombuffer(held, np.uint64))

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, np.uint64, "r"))

    @staticmethod
    def _child(children: EliasFano, ranges: EliasFano, span: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a word stands among its context's children, and whether it does."""
        at, equal = children.successor(parent * span + word)
        equal &= at < ranges.get(parent + 1).astype(np.int64)
        return at, equal

    def look(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of p(v|u) and p(w|uv); 0 where the n-gram isn't in the trie. Words and pairs are found once."""
        bigram, trigram = np.zeros(len(u), np.uint8), np.zeros(len(u), np.uint8)
        u_at, known = self._words(self.first, u)
        v_at, also = self._words(self.second, v)
        rows = np.flatnonzero(known & also)
        sample, pair_of = distinct(u_at[rows] * self.second.count + v_at[rows])
        pair, found = self._child(self.pairs, self.pairs_of, self.second.count, u_at[rows[sample]], v_at[rows[sample]])
        rows, pair = rows[found[pair_of]], pair[pair_of][found[pair_of]]
        bigram[rows] = self.p_pair[pair]
        if self.deep and len(rows):
            w_at, known = self._words(self.third, w[rows])
            rows, pair, w_at = rows[known], pair[known], w_at[known]
            triple, found = self._child(self.triples, self.triples_of, self.third.count, pair, w_at)
            trigram[rows[found]] = self.p_triple[triple[found]]
        return bigram, trigram

    @staticmethod
    def _words(level: EliasFano, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, place = ranked(words)
        at, known = level.successor(names)
        return at[place], known[place]
