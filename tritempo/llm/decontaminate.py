"""Benchmark passages in documents, found through a positional inverted index.

The index is cut by documents into shards of about two megabytes of text. A shard is one row: its documents, where their
words begin, its terms (64-bit hashes of the lower-cased words, sorted) and the postings of each term, positions counted
through the shard. It is written to the shared folder, built where the texts lie (no shuffle), and holds every word.

A phrase is looked up in every shard from its rarest term on: the term's positions, less the term's place in the
phrase, are where the phrase may begin; the lists of the other terms, in the order of their frequency in all documents,
are intersected with them. Phrases go to the shards by number in blocks of at most ``BLOCK``, so what is broadcast is bounded; the
items that have a phrase stay where Spark holds them and are joined with the phrases found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import NOT_ALNUM, Scratch, column_bytes, fresh, joined_bytes, lowered, ragged, slices, words

#: phrases that are broadcast at once; 13 words each are about 10 MB
BLOCK = 50_000
#: words of a window
WINDOW = 13


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: (shard, keys, begins, terms, ends, positions).

    ``begins`` has the first word of each document and the end; ``ends`` says where a term's postings end in
    ``positions`` (little-endian 32-bit numbers). Null and empty texts are documents without words.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                joined, begins = joined_bytes(offsets, data, start, stop)
                _, _, hashes, firsts = words(lowered(joined), begins, NOT_ALNUM)
                order = np.argsort(hashes.view(np.int64), kind="stable")
                terms, counts = np.unique(hashes.view(np.int64), return_counts=True)
                keys = batch.column(0).slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([firsts], pa.list_(pa.int64())), pa.array([terms], pa.list_(pa.int64())),
                    pa.array([np.cumsum(counts)], pa.list_(pa.int64())), pa.array([order.astype("<i4").tobytes()], pa.binary()),
                ], ["shard", "keys", "begins", "terms", "ends", "positions"])
                shard += 1

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        shards, f"shard long, keys array<{kind}>, begins array<long>, terms array<long>, ends array<long>, positions binary"
    )


def windows_of(items: DataFrame, *, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(terms, items): the distinct windows of the items' texts and the sorted ids, as text, of the items that have them.

    An item of fewer words than ``size`` is one window; an item without words, text or id has none.
    """
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                joined, begins = joined_bytes(offsets, data, start, stop)
                _, _, hashes, firsts = words(lowered(joined), begins, NOT_ALNUM)
                hashes = hashes.view(np.int64)
                found = [
                    (batch.column(0)[row], hashes[at : min(at + size, last)])
                    for row, first, last in zip(range(start, stop), firsts.tolist(), firsts[1:].tolist(), strict=False) if last > first
                    for at in range(first, max(first, last - size) + 1)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py() for item, _ in found], pa.string()), pa.array([terms for _, terms in found], pa.list_(pa.int64()))],
                        ["item", "terms"],
                    )

    return rows.mapInArrow(cut, "item string, terms array<long>").groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Shard:
    """Postings of one index row."""

    def __init__(self, row: dict) -> None:
        self.begins, self.terms = row["begins"], row["terms"]
        self.ends = row["ends"]
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        self.size = len(self.positions) + 1
        #: term number and position in one ascending number: looks up a position in the list of any term
        self.postings = np.repeat(np.arange(len(self.terms)), self.ends - self.starts) * self.size + self.positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms in this shard, -1 for those it doesn't have."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1

    def phrases(self, terms: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and first positions of all occurrences.

        ``terms`` has a row for each phrase, the rarest term first, and ``places`` their places in the phrase.
        """
        number = self.number(terms[:, 0])
        phrase = np.flatnonzero(number >= 0)
        counts = self.ends[number[phrase]] - self.starts[number[phrase]]
        at, _ = ragged(self.starts[number[phrase]], counts)
        phrase = np.repeat(phrase, counts)
        begin = self.positions[at] - places[phrase, 0]
        document = self.document(np.maximum(begin, 0))
        fits = (begin >= 0) & (begin + lengths[phrase] <= self.begins[np.minimum(document + 1, len(self.begins) - 1)])
        fits &= self.document(self.positions[at]) == document
        phrase, begin = phrase[fits], begin[fits]
        for turn in range(1, terms.shape[1]):
            if not len(phrase):
                break
            own = turn < lengths[phrase]
            number = self.number(terms[phrase, turn])
            wanted = number * self.size + begin + places[phrase, turn]
            found = self.postings[np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)] == wanted
            keep = ~own | ((number >= 0) & found)
            phrase, begin = phrase[keep], begin[keep]
        return phrase, begin

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """First positions of the spans of at most ``width`` words that hold all the terms (rarest first) in any order."""
        number = self.number(terms)
        if not len(terms) or (number < 0).any():
            return np.zeros(0, np.int64)
        begin = np.unique(np.concatenate([self.positions[self.starts[n] : self.ends[n]] for n in number.tolist()]))
        last = np.minimum(begin + width, self.begins[self.document(begin) + 1])
        for n in number.tolist():
            held = self.positions[self.starts[n] : self.ends[n]]
            following = np.searchsorted(held, begin)
            keep = (following < len(held)) & (held[np.minimum(following, len(held) - 1)] < last)
            begin, last = begin[keep], last[keep]
        return begin


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.Array]]:
    """The rows of a batch of the index: arrays by name, and the documents' keys."""
    for row in range(batch.num_rows):
        one = {n: batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("begins", "terms", "ends") if n in batch.schema.names}
        if "positions" in batch.schema.names:
            one["positions"] = batch.column("positions")[row].as_buffer()
        yield one, batch.column("keys")[row].values if "keys" in batch.schema.names else None


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of the (sorted) terms occurs in all documents; at most as many rows as terms reach the driver."""
    asked = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), np.int64)
        for batch in batches:
            for row, _ in _shards(batch):
                if len(row["terms"]):
                    at = np.minimum(np.searchsorted(row["terms"], asked.value), len(row["terms"]) - 1)
                    total += np.where(row["terms"][at] == asked.value, np.diff(row["ends"], prepend=0)[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked.value[some]), pa.array(total[some])], ["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {row.term: row.n for row in counted.collect()}


def _rarest_first(index: DataFrame, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as arrays: terms, the rarest first, their places in the phrase, and lengths."""
    count = frequencies(index, np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.int64))
    lengths = np.array([len(each) for each in phrases], np.int64)
    terms = np.zeros((len(phrases), max(lengths, default=1)), np.int64)
    places = np.zeros_like(terms)
    for row, each in enumerate(phrases):
        order = sorted(range(len(each)), key=lambda place: (count.get(int(each[place]), 0), place))
        terms[row, : len(each)], places[row, : len(each)] = each[order], order
    return terms, places, lengths


def phrase_matches(index: DataFrame, phrases: DataFrame, *, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, n_words, spans, items): a row for every document with the word ranges that any phrase covers, joined where they
    touch or overlap, and the sorted ids of the items whose phrases occur.

    ``phrases`` has (terms, items), see ``windows_of``. They are looked up in blocks that their hash assigns. Lists of items are joined
    by their digest, once for a document that has many phrases of the same items.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "phrases")
    phrases = phrases.withColumn("number", F.monotonically_increasing_id()).withColumn("list", F.sha2(F.to_json("items"), 256))
    phrases = scratch.put(phrases, "numbered")
    count = phrases.count()
    blocks = max(1, -(-count // block))
    parts = None
    for turn in range(blocks):
        own = phrases.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == turn).select("number", "terms").collect()
        terms, places, lengths = _rarest_first(index, [np.array(row.terms, np.int64) for row in own])
        asked = spark.sparkContext.broadcast((terms, places, lengths, np.array([row.number for row in own], np.int64)))

        def look(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            terms, places, lengths, numbers = asked.value
            for batch in batches:
                for at, (row, keys) in enumerate(_shards(batch)):
                    shard, total = Shard(row), len(keys)
                    phrase, begin = shard.phrases(terms, places, lengths)
                    covered = np.zeros(shard.size + 1, np.int64)
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + lengths[phrase], -1)
                    inside = np.cumsum(covered) > 0
                    edge = np.diff(inside.astype(np.int8), prepend=0)
                    # a document's first word begins a range even if the document before ends in one
                    firsts = np.zeros(shard.size + 1, bool)
                    firsts[shard.begins[:-1]] = True
                    heads = np.flatnonzero(inside & ((edge == 1) | firsts[: len(inside)]))
                    after = np.append(inside[1:], False)
                    tails = np.flatnonzero(inside & (~after | np.append(firsts[1:], False))) + 1
                    document = shard.document(heads)
                    spans: list[list[dict]] = [[] for _ in range(total)]
                    for doc, head, tail in zip(document.tolist(), heads.tolist(), tails.tolist(), strict=True):
                        first = int(shard.begins[doc])
                        spans[doc].append({"start": head - first, "end": tail - first})
                    pairs = np.unique(np.stack([shard.document(begin), numbers[phrase]]), axis=1) if len(begin) else np.zeros((2, 0), np.int64)
                    cuts = np.searchsorted(pairs[0], np.arange(total + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{batch.column('shard')[at].as_py()}"] * total, pa.string()), pa.array(range(total), pa.int64()), keys,
                        pa.array(np.diff(shard.begins)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(pairs[1])),
                    ], ["shard", "row", "key", "n_words", "spans", "numbers"])

        kind = index.schema["keys"].dataType.elementType.simpleString()
        found = index.select("shard", "keys", "begins", "terms", "ends", "positions").mapInArrow(
            look, f"shard string, row long, key {kind}, n_words long, spans array<struct<start:long,end:long>>, numbers array<long>"
        )
        parts = found if parts is None else parts.union(found)
    if blocks > 1:
        parts = parts.groupBy("shard", "row", "key", "n_words").agg(
            _merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.flatten(F.collect_list("numbers")).alias("numbers"),
        )
    parts = scratch.put(parts, "found")
    found = parts.select("shard", "row", F.explode("numbers").alias("number")).join(phrases.select("number", "list"), "number")
    lists = phrases.groupBy("list").agg(F.first("items").alias("items"))
    found = found.select("shard", "row", "list").distinct().join(lists, "list").select("shard", "row", F.explode("items").alias("item"))
    found = found.groupBy("shard", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return parts.join(found, ["shard", "row"], "left").select(
        F.col("key").alias(key), "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _merged(spans):
    """Joins sorted ranges that touch or overlap; the ranges of one document from a few blocks."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def proximity_matches(index: DataFrame, queries: dict[str, list[str]], width: int, *, key: str = "doc_id") -> DataFrame:
    """(key, query, starts): documents with spans of at most ``width`` words that hold all words of a query in any order.

    ``queries`` names word lists (a few, given by the caller). ``starts`` are the places of the spans' first words.
    """
    hashed = {}
    for name, wanted in queries.items():
        raw = lowered(np.frombuffer(" ".join(wanted).encode() + b"\n", np.uint8))
        hashed[name] = np.unique(words(raw, np.array([0, len(raw)]), NOT_ALNUM)[2].view(np.int64))
    count = frequencies(index, np.unique(np.concatenate(list(hashed.values()))))
    hashed = {name: np.array(sorted(terms.tolist(), key=lambda term: count.get(term, 0)), np.int64) for name, terms in hashed.items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, keys in _shards(batch):
                shard = Shard(row)
                for name, terms in hashed.items():
                    begin = shard.near(terms, width)
                    document = shard.document(begin)
                    found = np.unique(document)
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(found)), pa.array([name] * len(found), pa.string()),
                        pa.array([begin[document == doc] - shard.begins[doc] for doc in found.tolist()], pa.list_(pa.int64())),
                    ], ["key", "query", "starts"])

    kind = index.schema["keys"].dataType.elementType.simpleString()
    return index.mapInArrow(look, f"key {kind}, query string, starts array<long>").withColumnRenamed("key", key)


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated) of every document; contaminated if a twentieth of its words is hit.

    Null and empty texts have no words and are clean. Rows with one key are judged one by one.
    """
    scratch = Scratch(docs.sparkSession, "index")
    index = scratch.put(build_index(docs, key=key), "shards")
    windows = scratch.put(windows_of(items), "windows")
    matches = phrase_matches(index, windows, key=key, block=block)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    counted = matches.withColumn("n_hit", hit)
    return counted.select(key, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination_digests(docs: DataFrame, items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return contamination(docs, items, block=block).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all columns; rows are told apart by doc_id and text."""
    own = fresh("_row", docs.columns)
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    judged = contamination(docs.select(row.alias("row"), "text"), items, key="row")
    found = Scratch(docs.sparkSession, "contaminated").put(judged.filter("contaminated").select(F.col("row").alias(own)).distinct(), "rows")
    return docs.join(found, row == F.col(own), "left_anti")
