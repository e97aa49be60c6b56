"""Byte-level BPE encoding and decoding by a lexicon of frequent words.

The words (matches of the usual pattern) of all texts are counted. Those that occur often are merged once and compiled, with
their ids as outputs, into a minimal acyclic transducer: a state is what may follow (its final output and its arcs of byte,
output and target), equal states are one, so words share their suffixes as well as their prefixes. Outputs stand as far ahead
as the words of a prefix agree on them, which leaves most suffixes without any and lets them be shared.

The compiled transducer is one file in the shared folder. Spark hands it to every executor (``addFile``), whose workers map it
into memory, so that they share its pages. All words of a slice of text walk through it side by side, a byte a step, and gather
the outputs of their arcs. A word that ends outside the lexicon is unseen and merged exactly: the pair of lowest rank first,
the leftmost of these, until no pair has a rank; many short words at once, a long one with a heap.

Encoding and decoding run where the rows lie. Only the counts of words are shuffled, added up within tasks before.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.llm.bpe import matches
from tritempo.llm.common import Scratch, column_bytes, ragged, slices

#: words in the lexicon at most, how often they occur at least, and their longest; other words are merged
WORDS, OFTEN, LONGEST = 100_000, 2, 64
#: steps of a doubling by which words of about one frequency are taken or left together
STEPS = 8
#: unseen words whose ids a worker remembers, and counts of words that a task gathers before it passes them on
KEPT, GATHERED = 100_000, 300_000
#: ids that are decoded at once
DECODED = 250_000
NONE = np.iinfo(np.int64).max


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary of byte-level BPE: printable ones for themselves, others from 256 on."""
    own = [byte for byte in range(256) if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte]
    other = [byte for byte in range(256) if byte not in set(own)]
    return {chr(byte): byte for byte in own} | {chr(256 + place): byte for place, byte in enumerate(other)}


@dataclass
class Vocabulary:
    """Tokens by id (None for a free id), special tokens by their text, and merges: the pair, ascending, its rank and its token."""

    tokens: list[bytes | None]
    specials: dict[str, int]
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Of a tokenizer file with a byte-level BPE model and no normalizer."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, steps = content["model"], [content["pre_tokenizer"], content["decoder"]]
        plain = all(step and step["type"] == "ByteLevel" for step in steps) and not steps[0]["add_prefix_space"] and steps[0]["use_regex"]
        if model["type"] != "BPE" or content["normalizer"] or not plain or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} holds no plain byte-level BPE")
        letters = byte_of_letter()
        specials = {each["content"]: each["id"] for each in content["added_tokens"]}
        tokens: list[bytes | None] = [None] * (1 + max([*model["vocab"].values(), *specials.values()]))
        for name, number in model["vocab"].items():
            tokens[number] = bytes(map(letters.__getitem__, name))
        for name, number in specials.items():
            tokens[number] = name.encode()
        sides = [each.split(" ") if isinstance(each, str) else each for each in model["merges"]]
        number = model["vocab"]
        pairs = np.array([number[one] * len(tokens) + number[two] for one, two in sides], np.int64)
        merged = np.array([number[one + two] for one, two in sides], np.int64)
        order = np.argsort(pairs)
        return cls(tokens, specials, np.append(pairs[order], NONE), np.append(order, NONE), np.append(merged[order], 0))

    def bytes_as_ids(self) -> np.ndarray:
        names = {token: number for number, token in enumerate(self.tokens) if token is not None and len(token) == 1}
        return np.array([names[bytes([byte])] for byte in range(256)], np.int64)


class Merger:
    """Merges words that no lexicon holds."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.bytes, self.span = vocabulary, vocabulary.bytes_as_ids(), len(vocabulary.tokens)
        self.known: dict[int, tuple[int, int]] = {}

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of pairs; ``NONE`` if they don't merge."""
        v, keys = self.vocabulary, left * self.span + right
        at = np.searchsorted(v.pairs, keys)
        fits = v.pairs[at] == keys
        return np.where(fits, v.ranks[at], NONE), v.merged[at]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of every word."""
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        short = [place for place, word in enumerate(words) if len(word) <= LONGEST]
        for place, each in zip(short, self.abreast([words[place] for place in short]), strict=True):
            ids[place] = each
        for place, word in enumerate(words):
            if len(word) > LONGEST:
                ids[place] = self.long(word)
        return ids

    def abreast(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Rounds in which every word that has a pair to merge merges one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        token = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), lengths)
        live = np.ones(len(token), bool)
        places = np.arange(len(token))
        rank, new = self._all(token, of)
        while len(places):
            starts = np.flatnonzero(np.diff(of[places], prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(places)))
            at = np.flatnonzero((rank == least) & (least != NONE))
            at = at[np.flatnonzero(np.diff(of[places[at]], prepend=-1))]  # the leftmost of each word
            token[places[at]] = new[at]
            live[places[at + 1]] = False
            stay = (least != NONE) & live[places]
            places = places[stay]
            rank, new = self._all(token[places], of[places])
        token, of = token[live], of[live]
        ends = np.searchsorted(of, np.arange(len(words) + 1))
        return (token[begin:end] for begin, end in pairwise(ends.tolist()))

    def _all(self, token: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place, the pair with the next one of its word."""
        rank, new = np.full(len(token), NONE), np.zeros(len(token), np.int64)
        if len(token) > 1:
            rank[:-1], new[:-1] = self.found(token[:-1], token[1:])
            rank[:-1][of[:-1] != of[1:]] = NONE
        return rank, new

    def long(self, word: bytes) -> np.ndarray:
        """One long word: pairs wait in a heap by rank and place; those that have changed meanwhile are passed over."""
        v, span = self.vocabulary, self.span
        if not self.known:
            self.known = {key: (rank, new) for key, rank, new in zip(v.pairs[:-1].tolist(), v.ranks[:-1].tolist(), v.merged[:-1].tolist(), strict=True)}
        known, token = self.known, self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        waiting = [(*known[key], place, key) for place, (one, two) in enumerate(pairwise(token)) if (key := one * span + two) in known]
        heapq.heapify(waiting)
        while waiting:
            _, new, at, key = heapq.heappop(waiting)
            gone = after[at]
            if token[at] < 0 or gone >= len(token) or token[at] * span + token[gone] != key:
                continue
            token[at], token[gone] = new, -1
            after[at] = follow = after[gone]
            if follow < len(token):
                before[follow] = at
                if (pair := new * span + token[follow]) in known:
                    heapq.heappush(waiting, (*known[pair], at, pair))
            lead = before[at]
            if lead >= 0 and (pair := token[lead] * span + new) in known:
                heapq.heappush(waiting, (*known[pair], lead, pair))
        return np.array([each for each in token if each >= 0], np.int64)


def compiled(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal transducer of distinct words and their ids, as the bytes that ``Transducer`` maps.

    Words are taken in order. States open along the word at hand; a state that the next word leaves is complete, and is the
    state of an earlier one with the same final output and the same arcs if there is one.
    """
    states: dict[tuple, int] = {}
    outputs: dict[tuple[int, ...], int] = {(): 0}

    def close(final: tuple[int, ...] | None, arcs: list[tuple[int, int, tuple[int, ...]]]) -> tuple[int, tuple[int, ...]]:
        """The state, and what all words through it put out first: that stands on the arc to it."""
        each = [output for _, _, output in arcs] + ([] if final is None else [final])
        low, high = min(each, default=()), max(each, default=())
        size = next((place for place, (one, two) in enumerate(zip(low, high, strict=False)) if one != two), min(len(low), len(high)))
        number = lambda output: outputs.setdefault(output[size:], len(outputs))
        key = (-1 if final is None else number(final), *((label, target, number(output)) for label, target, output in arcs))
        return states.setdefault(key, len(states)), low[:size]

    path: list[list] = [[None, []]]  # final output and arcs of the open states
    last = b""

    def leave(depth: int) -> None:
        while len(path) > depth + 1:
            state, ahead = close(*path.pop())
            path[-1][1].append((last[len(path) - 1], state, ahead))

    for word, ids in sorted(words):
        shared = next((place for place, (one, two) in enumerate(zip(last, word, strict=False)) if one != two), min(len(last), len(word)))
        leave(shared)
        path.extend([None, []] for _ in range(len(word) - shared))
        path[-1][0], last = tuple(ids), word
    leave(0)
    root, ahead = close(*path.pop())
    first = outputs.setdefault(ahead, len(outputs))
    arcs = np.array([(state << 8 | label, target, output) for key, state in states.items() for label, target, output in key[1:]] or np.zeros((0, 3)), np.int64)
    arcs = arcs[np.argsort(arcs[:, 0])] if len(arcs) else arcs
    final = np.array([key[0] for key in states], np.int32)
    ends = np.cumsum([0, *map(len, outputs)])
    pool = np.array([number for output in outputs for number in output], np.int32)
    head = np.array([root, first, len(arcs), len(states), len(outputs), len(pool)], np.int64)
    parts = [head, arcs[:, 0].astype(np.int64), ends.astype(np.int64), arcs[:, 1].astype(np.int32), arcs[:, 2].astype(np.int32), final, pool]
    return b"".join(part.tobytes() for part in parts)


class Transducer:
    """A compiled transducer over mapped memory."""

    def __init__(self, content) -> None:
        self.root, self.first, arcs, states, outputs, pool = np.frombuffer(content, np.int64, 6).tolist()
        at = 48
        views = []
        for count, kind in ((arcs, np.int64), (outputs + 1, np.int64), (arcs, np.int32), (arcs, np.int32), (states, np.int32), (pool, np.int32)):
            views.append(np.frombuffer(content, kind, count, at) if count else np.zeros(0, kind))
            at += count * np.dtype(kind).itemsize
        self.arcs, self.ends, self.targets, self.outputs, self.final, self.pool = views

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def __len__(self) -> int:
        return len(self.final)

    def walk(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the lexicon holds each word, how many ids it has, and the ids of all those words one after the other."""
        word = np.arange(len(starts))
        state = np.full(len(starts), self.root, np.int64)
        held = np.zeros(len(starts), bool)
        seen = [(word, np.full(len(starts), self.first))] if self.first else []
        step = 0
        while len(word):
            over = starts[word] + step == ends[word]
            if over.any():
                done, last = word[over], self.final[state[over]]
                held[done[last >= 0]] = True
                seen.append((done[last > 0], last[last > 0]))
                word, state = word[~over], state[~over]
            if not len(self.arcs):
                break
            key = state << 8 | raw[starts[word] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[at] == key
            word, at = word[there], at[there]
            state, output = self.targets[at].astype(np.int64), self.outputs[at]
            seen.append((word[output > 0], output[output > 0]))
            step += 1
        of, output = (np.concatenate(each) if each else np.zeros(0, np.int64) for each in (zip(*seen, strict=True) if seen else ((), ())))
        of, output = of[held[of]], output[held[of]]
        order = np.argsort(of, kind="stable")
        of, output = of[order], output[order]
        sizes = self.ends[output + 1] - self.ends[output]
        places, _ = ragged(self.ends[output], sizes)
        return held, np.bincount(of, sizes, len(starts)).astype(np.int64), self.pool[places]


class Coder:
    """Encodes with a transducer and merges, and decodes."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer) -> None:
        self.vocabulary, self.transducer, self.merger = vocabulary, transducer, Merger(vocabulary)
        self.kept: dict[bytes, np.ndarray] = {}
        lengths = [len(token or b"") for token in vocabulary.tokens]
        self.ends = np.cumsum([0, *lengths])
        self.letters = np.frombuffer(b"".join(token or b"" for token in vocabulary.tokens), np.uint8)

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], np.ndarray]:
        """Texts cut at special tokens: the parts, the special token that a part is (or -1), and each text's first part, with the end."""
        specials = self.vocabulary.specials
        if not any(name in text for text in texts for name in specials):
            return texts, [-1] * len(texts), np.arange(len(texts) + 1)
        cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        cut_up = [cut.split(text) for text in texts]  # special tokens have the odd places
        parts = [part for each in cut_up for part in each]
        which = [specials[part] if place % 2 else -1 for each in cut_up for place, part in enumerate(each)]
        return parts, which, np.cumsum([0, *map(len, cut_up)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and where each text's begin, with the end."""
        parts, which, firsts = self.parts(texts)
        joined = "".join(parts)
        first, starts = matches(joined, np.cumsum([0, *map(len, parts)]))
        raw = joined.encode()
        data, ends, starts = np.frombuffer(raw, np.uint8), starts[1:], starts[:-1]
        held, counts, ids = self.transducer.walk(data, starts, ends)
        special = [(first[place], first[place + 1], number) for place, number in enumerate(which) if number >= 0]
        own = np.zeros(len(starts), bool)  # matches within special tokens
        for begin, end, _ in special:
            own[begin:end] = True
        if own.any():
            ids = ids[~np.repeat(own[held], counts[held])]
            counts[own], held[own] = 0, False
        unseen = np.flatnonzero(~held & ~own)
        words = [raw[begin:end] for begin, end in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = list({word for word in words if word not in self.kept})
        self.kept.update(zip(new, self.merger.merge(new), strict=True))
        merged = [self.kept[word] for word in words]
        counts[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
        heads = np.array([begin for begin, _, _ in special], np.int64)
        counts[heads] = 1
        cuts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(cuts[-1], np.int32)
        out[ragged(cuts[:-1][held], counts[held])[0]] = ids
        if merged:
            out[ragged(cuts[unseen], counts[unseen])[0]] = np.concatenate(merged)
        out[cuts[heads]] = [number for _, _, number in special]
        return out, cuts[first][firsts]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of runs of ids; ids without a token are passed over, bytes that are no UTF-8 become the replacement character."""
        known = (ids >= 0) & (ids < len(self.ends) - 1)
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.ends[ids + 1] - self.ends[ids], 0)
        places, ends = ragged(self.ends[ids], sizes)
        raw = self.letters[places].tobytes()
        bounds = np.concatenate([[0], ends])[cuts].tolist()
        return [raw[begin:end].decode("utf-8", "replace") for begin, end in pairwise(bounds)]


@dataclass(frozen=True)
class Lexicon:
    """What tasks need: the broadcast vocabulary (a file of fixed size) and the name of the file that Spark hands out."""

    vocabulary: object
    file: str

    def coder(self) -> Coder:
        """The worker's coder; it outlives the task."""
        if self.file not in _CODERS:
            _CODERS.clear()
            _CODERS[self.file] = Coder(self.vocabulary.value, Transducer.open(SparkFiles.get(self.file)))
        return _CODERS[self.file]


_CODERS: dict[str, Coder] = {}


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    offsets, _ = column_bytes(batch.column(column))
    for start, stop in slices(offsets):
        yield start, stop, [value or "" for value in batch.column(column).slice(start, stop - start).to_pylist()]


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n): how often every match of the pattern occurs in all texts. A null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                joined = "".join(texts)
                _, starts = matches(joined, np.cumsum([0, *map(len, texts)]))
                raw = joined.encode()
                held.update(raw[begin:end] for begin, end in pairwise(starts.tolist()))
                if len(held) > GATHERED:
                    yield passed_on()
        yield passed_on()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, words: int = WORDS, *, text: str = "text") -> list[bytes]:
    """At most so many words (a bound on what the driver holds), the most frequent ones.

    Words of about one frequency are taken or left together, so that what decides is a small table of frequencies.
    """
    scratch = Scratch(docs.sparkSession, "lexicon")
    often = word_counts(docs, text=text).filter((F.col("n") >= OFTEN) & (F.octet_length("word") <= LONGEST))
    often = scratch.put(often.withColumn("level", F.floor(F.log2("n") * STEPS)), "words")
    level = None
    for row in often.groupBy("level").count().orderBy(F.desc("level")).collect():
        words -= row["count"]
        if words < 0:
            break
        level = row["level"]
    return [] if level is None else [bytes(row.word) for row in often.filter(F.col("level") >= level).select("word").collect()]


def shared_file(spark: SparkSession, content: bytes) -> str:
    """Writes a file to the shared folder and has Spark hand it to every executor, those yet to come too; its name."""
    scratch = Scratch(spark, "transducer")
    path = scratch.write(content, "file")
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def lexicon_of(docs: DataFrame, path: str | None = None, *, text: str = "text", words: int = WORDS) -> Lexicon:
    """The lexicon of a corpus. Without frequent words it is empty, and all words are merged."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(path or public_tokenizers.path("byte_bpe_50k.json"))
    frequent = frequent_words(docs, words, text=text)
    ids = Merger(vocabulary).merge(frequent)
    content = compiled((word, tuple(each.tolist())) for word, each in zip(frequent, ids, strict=True))
    return Lexicon(spark.sparkContext.broadcast(vocabulary), shared_file(spark, content))


def lexicon_encode(docs: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row; special tokens in a text are recognised. Nulls and empty texts have no ids.

    Rows with the same key, or a null key, are encoded one by one and kept. Other columns of the input are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lexicon.coder()
        for batch in batches:
            for start, stop, texts in _texts(batch, 1):
                ids, cuts = coder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], ["key", "ids"])
        coder.kept.clear()  # the worker may go on with other work

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def lexicon_decode(encoded: DataFrame, lexicon: Lexicon, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the text that the ids stand for, special tokens included. Null ids decode to the empty text."""
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lexicon.coder()
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
            values = np.asarray(lists.flatten().fill_null(-1))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for start, stop in slices(cuts, DECODED):
                begin = cuts[start]
                texts = coder.decode(values[begin : cuts[stop]], cuts[start : stop + 1] - begin)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(decode, f"key {kind}, ids array<int>, decoded string").withColumnsRenamed({"key": key, "ids": ids})


def lexicon_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    lexicon = lexicon_of(docs, path)
    decoded = lexicon_decode(lexicon_encode(docs, lexicon), lexicon)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
