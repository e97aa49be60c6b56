"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the pattern of the rank file; each match is encoded by itself: a match that is a token as it stands
is that token, any other starts as single bytes and the pair of neighbours with the lowest rank is merged, the leftmost
first, until no neighbouring pair has a rank.

The leaf of a byte position holds ``rank * size + position`` of the pair that begins there, inner nodes the smaller of
their children, so the root is the leftmost pair of lowest rank. A merge changes the leaves of three live neighbours
and the nodes above them: a logarithmic number of point updates. Short matches are encoded many at a time, with
one array row per match; a long match has a tree of its own.

Encoding runs where the rows lie (no shuffle). The matches of the usual pattern are found for many texts at once from
the classes of their characters, and equal matches (by a 64-bit hash of their bytes) are encoded once per slice of
text; the encodings of matches seen lately are kept, at most ``KEPT`` of them. Any other pattern is left to ``regex``.
Letters, numbers and white space are those of ``regex`` but for the characters that the tokenizer libraries don't know yet.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import column_bytes, ragged, range_hashes, slices

#: matches of up to so many bytes are encoded side by side
SHORT = 64
ABREAST = 8_000
#: matches whose encoding a worker remembers
KEPT = 150_000
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 text and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


OTHER, LETTER, NUMBER, WHITE = range(4)
#: Letters and numbers that ``regex`` knows and the libraries' tables (Unicode 16) don't yet; first and last of each run.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, asked of ``regex`` once per worker."""
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        for begin in range(0, len(table), 0x4000):  # all at once would take a hundred megabytes
            part = "".join(chr(point) for point in range(begin, begin + 0x4000) if not 0xD800 <= point < 0xE000)
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
                for found in regex.finditer(pattern, part):
                    table[np.frombuffer(found.group().encode("utf-32-le"), "<u4")] = kind
        for first, last in LATER:
            table[first : last + 1] = OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def matches(joined: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the usual pattern in texts set side by side; ``begins`` are the texts' first characters, and the end.

    Returns the index of each text's first match and the byte at which each match starts, with an end for both.
    A match is a run of one class of characters. A space before a run of another class joins it; other white space keeps
    its last character apart from the rest if a run follows. A lone apostrophe takes the letters of a contraction.
    """
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    count = len(points)
    kinds = classes()[points]
    first = np.zeros(count + 1, bool)
    first[begins] = True
    cut = first.copy()
    cut[1:count] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(cut)
    if not count:
        return np.zeros(len(begins), np.int64), np.zeros(1, np.int64)
    heads, tails = runs[:-1], runs[1:]
    lone = heads[(points[heads] == 0x27) & (tails - heads == 1)]
    ends = tails[(kinds[heads] == WHITE) & ~first[tails]]
    cut[ends - 1] = True
    cut[ends[points[ends - 1] == 0x20]] = False
    lone = lone[cut[lone]]
    after = np.append(points, [0, 0, 0])
    one, two = after[lone + 1], after[lone + 2]
    inside = ~first[lone + 1]
    short = inside & np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), "<u4"))
    wide = inside & ~first[np.minimum(lone + 2, count)]
    wide &= np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    for chosen, size in ((lone[short], 2), (lone[wide], 3)):
        cut[chosen + 1] = False
        cut[chosen + size] = True
    starts = np.flatnonzero(cut)
    width = np.ones(count, np.int8)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    place = np.zeros(count + 1, np.int64)
    np.cumsum(width, out=place[1:])
    return np.searchsorted(starts, begins), place[starts]


class SegmentTree:
    """Leftmost minimum over positions of one match; ``set`` updates one leaf and the nodes above it."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(len(leaves) - 1, 0).bit_length()
        self.nodes = array("q", [NONE]) * (2 * self.size)
        self.nodes[self.size : self.size + len(leaves)] = array("q", leaves)
        for node in range(self.size - 1, 0, -1):
            self.nodes[node] = min(self.nodes[2 * node], self.nodes[2 * node + 1])

    def set(self, place: int, value: int) -> None:
        nodes, node = self.nodes, self.size + place
        nodes[node] = value
        while node > 1:
            node >>= 1
            left, right = nodes[2 * node], nodes[2 * node + 1]
            least = left if left < right else right
            if nodes[node] == least:
                return
            nodes[node] = least


class Encoder:
    """Encodes and decodes with the ranks of one file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        missing = [byte for byte in range(256) if bytes([byte]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks {len(missing)} single bytes")
        self.bytes = np.array([ranks[bytes([byte])] for byte in range(256)], np.int64)
        self.span = max(self.tokens) + 1
        #: every way a token is two tokens side by side: left * span + right, ascending, and the token
        pairs = np.array([
            (ranks[token[:cut]] * self.span + ranks[token[cut:]], rank)
            for token, rank in ranks.items() for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ] or np.zeros((0, 2)), np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.merged = np.append(pairs[:, 0], NONE), np.append(pairs[:, 1], 0)
        self.kept: dict[int, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        joined = "".join(texts)
        if self.pattern.pattern == public_tokenizers.PATTERN:
            raw = joined.encode()
            firsts, starts = matches(joined, np.cumsum([0, *map(len, texts)]))
        else:
            pieces = [[piece.encode() for piece in self.pattern.findall(text)] for text in texts]
            raw = b"".join(piece for each in pieces for piece in each)
            firsts = np.cumsum([0, *map(len, pieces)])
            starts = np.cumsum([0, *(len(piece) for each in pieces for piece in each)])
        hashes = range_hashes(np.frombuffer(raw, np.uint8), starts[:-1], starts[1:])
        keys, samples, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.kept) + len(keys) > KEPT:
            self.kept.clear()
        kept = self.kept
        names = keys.tolist()
        self.learn({key: raw[starts[at] : starts[at + 1]] for key, at in zip(names, samples.tolist(), strict=True) if key not in kept})
        ids = [kept[key] for key in names]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places, ends = ragged((np.cumsum(lengths) - lengths)[inverse], lengths[inverse])
        packed = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[firsts]).tolist()
        return [packed[begin:end] for begin, end in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pieces: dict[int, bytes]) -> None:
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key, raw in pieces.items():
            rank = self.ranks.get(raw)
            if rank is not None:
                self.kept[key] = rank.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.kept[key] = self.long(raw)
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((key, raw))
        for size, group in groups.items():
            for at in range(0, len(group), ABREAST):
                part = group[at : at + ABREAST]
                self.kept.update(zip((key for key, _ in part), self.side_by_side([raw for _, raw in part], size), strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or -1."""
        keys = left * self.span + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.merged[at], -1)

    def side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Merges many matches of at most ``size`` bytes (a power of two) at once, one tree per row.

        Rows have a spare column on the right; ``left`` and ``right`` are the live neighbours of a position, and
        ``size`` stands for none. Rows without a pair left are put aside.
        """
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        places = np.arange(size + 1)
        token = np.full((count, size + 1), -1, np.int64)
        token[:, :size][places[:size] < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        right = np.where(places + 1 < lengths[:, None], places + 1, size)
        left = np.where((places > 0) & (places < lengths[:, None]), places - 1, size)
        nodes = np.full((count, 2 * size), NONE)
        rank = self.rank_of(token[:, :size], np.take_along_axis(token, right[:, :size], 1))
        nodes[:, size:] = np.where((token[:, :size] >= 0) & (right[:, :size] < size) & (rank >= 0), rank * size + places[:size], NONE)
        level = size
        while level > 1:
            nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(nodes[:, 1] != NONE)
        while len(rows):
            root = nodes[rows, 1]
            at, new = root % size, root // size
            gone = right[rows, at]
            after, before = right[rows, gone], left[rows, at]
            token[rows, at], token[rows, gone] = new, -1
            right[rows, at] = after
            left[rows, after] = at
            self.update(nodes, rows, gone, np.full(len(rows), NONE), size)
            follow = self.rank_of(new, token[rows, after])
            self.update(nodes, rows, at, np.where((after < size) & (follow >= 0), follow * size + at, NONE), size)
            some = before < size
            ahead, own, place = rows[some], new[some], before[some]
            lead = self.rank_of(token[ahead, place], own)
            self.update(nodes, ahead, place, np.where(lead >= 0, lead * size + place, NONE), size)
            rows = rows[nodes[rows, 1] != NONE]
        live = token[:, :size] >= 0
        packed, ends = token[:, :size][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [packed[begin:end] for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def update(nodes: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray, size: int) -> None:
        """Sets one leaf in each of the rows and renews the nodes above it."""
        node = places + size
        nodes[rows, node] = values
        while size > 1:
            least = np.minimum(nodes[rows, node], nodes[rows, node ^ 1])
            node = node >> 1
            nodes[rows, node] = least
            size >>= 1

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The pairs for one lookup at a time; made when the first long match comes."""
        return dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))

    def long(self, raw: bytes) -> bytes:
        """Merges one long match."""
        count, span, pairs = len(raw), self.span, self.pairs
        token = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        size = 1 << (count - 1).bit_length()
        right, left = array("q", range(1, count + 1)), array("q", range(-1, count - 1))
        ranks = (pairs.get(one * span + two) for one, two in zip(token, token[1:], strict=False))
        tree = SegmentTree([NONE if rank is None else rank * size + place for place, rank in enumerate(ranks)] + [NONE])
        while tree.nodes[1] != NONE:
            new, at = divmod(tree.nodes[1], size)
            gone = right[at]
            after, before = right[gone], left[at]
            token[at], token[gone], right[at] = new, -1, after
            tree.set(gone, NONE)
            rank = None
            if after < count:
                left[after] = at
                rank = pairs.get(new * span + token[after])
            tree.set(at, NONE if rank is None else rank * size + at)
            if before >= 0:
                rank = pairs.get(token[before] * span + new)
                tree.set(before, NONE if rank is None else rank * size + before)
        return np.array([each for each in token if each >= 0], "<u4").tobytes()

    def decode(self, packed: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, packed.tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder_of(ranks, pattern: str) -> Encoder:
    """The worker's encoder for broadcast ranks; it outlives the task."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value, pattern)
    return _ENCODERS[key]


def _broadcast(df: DataFrame, path: str | None):
    """The rank table: a vocabulary file of fixed size (about a megabyte), read once on the driver."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def bpe_encode(
    docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(key, ids) of every row; ``ids`` is binary, the token ids as little-endian unsigned 32-bit numbers.

    Nulls and empty texts have no ids. Rows with the same key, or a null key, are encoded one by one and kept. Other columns
    of the input are not read.
    """
    ranks = _broadcast(docs, path)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for batch in batches:
            offsets, _ = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                part = batch.slice(start, stop - start)
                ids = encoder.encode([value or "" for value in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])
        encoder.kept.clear()  # the worker may go on with other work

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(encode, f"key {kind}, ids binary").withColumnRenamed("key", key)


def bpe_decode(
    encoded: DataFrame, path: str | None = None, *, key: str = "doc_id", ids: str = "ids", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(key, ids, decoded): the bytes that the ids stand for. Null ids decode to no bytes; unknown ids are an error."""
    ranks = _broadcast(encoded, path)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                part = batch.slice(start, stop - start)
                texts = [encoder.decode(data[offsets[row] : offsets[row + 1]].view("<u4")) for row in range(start, stop)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(decode, f"key {kind}, ids binary, decoded binary").withColumnsRenamed({"key": key, "ids": ids})


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    decoded = bpe_decode(bpe_encode(docs, path), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
