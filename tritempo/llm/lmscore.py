"""Log probabilities of texts by a trigram model in Elias-Fano tries.

p(w|uv) = (c(uvw) + S p(w|v)) / (c(uv) + S), p(w|v) likewise with the unigram probability below it: each order takes from the
shorter context what its own counts leave open. The unigram probability is the base score's.

Nothing of the corpus is held in one place. Documents are packed into batches of a few megabytes, written once and bucketed by
batch, so that later steps find a batch without shuffling it. Three rounds of messages follow, each message a
compressed array for one batch and one bucket:

1. a batch sends its distinct tokens (64-bit hashes) and their training counts to the tokens' buckets, which number the
   tokens and answer with number and total count;
2. a batch sends its distinct trigrams, as numbers, with training counts to the buckets of their first word. A bucket builds a
   trie of the trained ones, looks all of them up and answers with the quantised probabilities of p(v|u) and p(w|uv);
3. a batch sums the log probabilities of its documents.

A word whose trigrams would make a bucket too large is dealt out by its second word, too, and a pair that would by all three words; the
counts of those contexts are gathered beforehand. There are at most ``SPREAD`` such words, and pairs, for each bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import SPACE, Scratch, column_bytes, distinct, joined_bytes, lowered, mixed, partitions, ranked, slices, words
from tritempo.llm.langid import held_out_of
from tritempo.llm.trie import Trie, build, probability_of

#: text bytes of a batch; more of them make fewer and larger messages
BATCH_BYTES = 6_000_000
#: a word or pair is dealt out if it has more than 1 / (SPREAD * buckets) of the training tokens
SPREAD = 4
#: weight of the shorter context, for p(w|v) and p(w|uv), in counts
STRENGTH = (30.0, 2.0)
#: hash that stands for the end of a text; not one of a word but by chance of 2**-64
END = np.uint64(0x5851F42D4C957F2D)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: frequent ones are small, so the upper planes take no room."""
    octets = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(octets.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(octets.reshape(8, -1).T).view("<u8").ravel().astype(np.int64) if len(octets) else np.zeros(0, np.int64)


def _table(schema: pa.Schema, columns: dict[str, list]) -> pa.Table:
    return pa.table({field.name: pa.array(columns[field.name], field.type) for field in schema}, schema)


def _typed(function: Callable, *names: str) -> Callable:
    """Hints from which Spark tells how to call a function."""
    function.__annotations__ = {**{name: pa.Table for name in names}, "return": pa.Table}
    return function


def pack(docs: DataFrame, learn: Column, *, key: str, text: str) -> DataFrame:
    """(batch, keys, learn, firsts, n_learn, hashes, counts, ids): the tokens of a batch of documents.

    ``hashes`` are its distinct tokens, the most frequent first, ``counts`` how often documents to learn from have them, and
    ``ids`` the tokens in order, as places in ``hashes``; ``firsts`` is where each document begins there.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            offsets, data = column_bytes(part.column("text"))
            for start, stop in slices(offsets, BATCH_BYTES):
                joined, begins = joined_bytes(offsets, data, start, stop)
                _, _, hashes, firsts = words(lowered(joined), begins, SPACE)
                counted = np.diff(firsts) + 1
                tokens = np.full(int(counted.sum()), END)
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(counted) - 1] = False
                tokens[inner] = hashes
                learned = part.column("learn").slice(start, stop - start)
                trained = np.repeat(learned.to_numpy(zero_copy_only=False), counted)
                sample, ids = distinct(tokens)
                names = tokens[sample]
                often = np.argsort(-np.bincount(ids), kind="stable")
                place = np.empty_like(often)
                place[often] = np.arange(len(often))
                counts = np.bincount(ids, trained, len(names))[often].astype(np.int64)
                keys = part.column("key").slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), learned),
                    pa.array([np.concatenate([[0], np.cumsum(counted)])], pa.list_(pa.int64())), pa.array([int(trained.sum())]),
                    pa.array([packed(names[often])], pa.binary()), pa.array([packed(counts)], pa.binary()), pa.array([packed(place[ids])], pa.binary()),
                ], ["batch", "keys", "learn", "firsts", "n_learn", "hashes", "counts", "ids"])
                number += 1

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        batches, f"batch long, keys array<{kind}>, learn array<boolean>, firsts array<long>, n_learn long, hashes binary, counts binary, ids binary"
    )


_KNOWN = "batch long, bucket int, numbers binary, totals binary"


def token_numbers(tables: DataFrame, buckets: int, trained: int) -> DataFrame:
    """(batch, bucket, numbers, totals): answers to the batches' tokens, in the order of ``hashes`` within the bucket.

    Numbers count from 1 and are 0 for tokens that no document to learn from has. Rows of batch -1 name, for each bucket, how many
    tokens it has numbered and those of them that are dealt out.
    """

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                hashes, counts = unpacked(part.column("hashes")[row].as_py()).view(np.uint64), unpacked(part.column("counts")[row].as_py())
                found = list(_dealt(hashes % np.uint64(buckets), buckets))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column("batch")[row].as_py()] * len(found), pa.int64()), pa.array([bucket for bucket, _ in found], pa.int32()),
                    pa.array([packed(hashes[at]) for _, at in found], pa.binary()), pa.array([packed(counts[at]) for _, at in found], pa.binary()),
                ], ["batch", "bucket", "hashes", "counts"])

    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("totals", pa.binary())])

    def number(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [unpacked(raw.as_py()).view(np.uint64) for raw in table["hashes"]]
        names = np.concatenate(asked)
        sample, inverse = distinct(names)
        names = names[sample]
        totals = np.bincount(inverse, np.concatenate([unpacked(raw.as_py()) for raw in table["counts"]])).astype(np.int64)
        order = np.argsort(-totals, kind="stable")
        numbers = np.empty(len(names), np.int64)
        numbers[order] = np.arange(len(names)) * buckets + bucket + 1
        numbers[totals == 0] = 0
        hot = np.flatnonzero(totals * (SPREAD * buckets) > trained)
        found = {"batch": table["batch"].to_pylist(), "bucket": [bucket] * len(asked), "numbers": [], "totals": []}
        ends = np.cumsum([len(each) for each in asked]).tolist()
        for begin, end in zip([0, *ends], ends, strict=False):
            found["numbers"].append(packed(numbers[inverse[begin:end]]))
            found["totals"].append(packed(totals[inverse[begin:end]]))
        for name, value in (("batch", -1), ("bucket", bucket), ("numbers", packed(np.append(numbers[hot], (totals > 0).sum()))), ("totals", packed(totals[hot]))):
            found[name].append(value)
        return _table(schema, found)

    asked = tables.select("batch", "hashes", "counts").mapInArrow(ask, "batch long, bucket int, hashes binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(_typed(number, "table"), _KNOWN)


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every bucket that occurs, with its places in order."""
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(counts)
    for each in np.flatnonzero(counts).tolist():
        yield each, order[ends[each] - counts[each] : ends[each]]


class Batch:
    """A packed batch with its tokens' numbers and totals."""

    def __init__(self, row: pa.Table, answers: pa.Table, buckets: int) -> None:
        one = {name: row[name][0] for name in row.column_names}
        hashes = unpacked(one["hashes"].as_py()).view(np.uint64)
        self.keys, self.learn = one["keys"].values, one["learn"].values.to_numpy(zero_copy_only=False)
        self.firsts = one["firsts"].values.to_numpy()
        numbers, totals = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        places = dict(_dealt(hashes % np.uint64(buckets), buckets))
        for bucket, own, sums in zip(answers["bucket"].to_pylist(), answers["numbers"], answers["totals"], strict=True):
            numbers[places[bucket]], totals[places[bucket]] = unpacked(own.as_py()), unpacked(sums.as_py())
        ids = unpacked(one["ids"].as_py())
        self.words, self.totals = numbers[ids], totals[ids]
        self.local = np.where(self.words > 0, ids + 1, 0)  # the same words by small numbers, 0 if not trained
        self.document = np.repeat(np.arange(len(self.keys)), np.diff(self.firsts))

    def trigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigrams (three rows; 0: none), for every token the one that it begins (-1: none known), and training counts."""
        count = len(self.words)
        following = np.zeros((2, count), np.int64)
        for step in (1, 2):
            if count > step:
                same = self.document[:-step] == self.document[step:]
                following[step - 1, : count - step] = np.where(same, self.local[step:], 0)
        starts = np.flatnonzero((self.local > 0) & (following[0] > 0))
        u, v, w = self.local[starts], following[0][starts], following[1][starts]
        bits = int(self.local.max(initial=1)).bit_length()
        if 3 * bits <= 63:
            sample, inverse = distinct(u << 2 * bits | v << bits | w)
        else:
            _, pair = distinct(u << 31 | v)
            sample, inverse = distinct(pair << 31 | w)
        begins = np.full(count, -1)
        begins[starts] = inverse
        trained = np.bincount(inverse, self.learn[self.document[starts]], len(sample)).astype(np.int64)
        at = starts[sample]
        third = np.where(w[sample] > 0, self.words[np.minimum(at + 2, count - 1)], 0)
        return np.stack([self.words[at], self.words[at + 1], third]), begins, trained


def bucket_of(trigrams: np.ndarray, hot: np.ndarray, pairs: dict[tuple[int, int], int], buckets: int) -> np.ndarray:
    """The bucket of each trigram: by its first word, or by two or three words where the first or the first two are dealt out."""
    u, v, w = (mixed(row.astype(np.uint64) + np.uint64(77)) for row in trigrams)
    first = np.isin(trigrams[0], hot)
    name = np.where(first, mixed(u + v * np.uint64(3)), u)
    both = np.flatnonzero(first & np.isin(trigrams[1], [second for _, second in pairs]))
    both = both[[pair in pairs for pair in zip(trigrams[0][both].tolist(), trigrams[1][both].tolist(), strict=True)]] if len(both) else both
    name[both] = mixed(u[both] + v[both] * np.uint64(3) + w[both] * np.uint64(7))
    return name % np.uint64(buckets)


def score_corpus(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row, by a model of the rows that ``learn`` marks.

    Tokens are the words of the lower-cased text and an end, which a null or empty text has, too. Rows with a null or repeated key
    are scored one by one. Without a row to learn from no token is known, scores are those of an empty vocabulary.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    buckets = buckets or 2 * partitions(spark)
    name = f"lm_{uuid.uuid4().hex}"
    batches = pack(docs, learn, key=key, text=text)
    writer = batches.write.option("path", f"{scratch.folder}/batches").option("compression", "uncompressed")
    writer.bucketBy(partitions(spark), "batch").saveAsTable(name)
    batches = spark.table(name)
    trained = batches.agg(F.coalesce(F.sum("n_learn"), F.lit(0))).first()[0]
    known = scratch.put(token_numbers(batches, buckets, trained), "known")
    summary = known.filter("batch = -1").collect()  # a row for each bucket
    vocabulary = sum(int(unpacked(bytes(row.numbers))[-1]) for row in summary)
    of_word = {
        number: total for row in summary
        for number, total in zip(unpacked(bytes(row.numbers))[:-1].tolist(), unpacked(bytes(row.totals)).tolist(), strict=True)
    }
    hot = np.array(sorted(of_word), np.int64)
    answers = known.filter("batch >= 0")

    # pairs that are dealt out; both of their words are
    pair_schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def hot_pairs(row: pa.Table, own: pa.Table) -> pa.Table:
        if not row.num_rows:
            return pair_schema.empty_table()
        batch = Batch(row, own, buckets)
        u, v = batch.words[:-1], batch.words[1:]
        fits = (batch.document[:-1] == batch.document[1:]) & batch.learn[batch.document[:-1]] & np.isin(u, hot) & np.isin(v, hot)
        pairs, counts = np.unique(np.stack([u[fits], v[fits]]), axis=1, return_counts=True)
        return pa.table({"u": pairs[0], "v": pairs[1], "n": counts.astype(np.int64)}, pair_schema)

    counted = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_typed(hot_pairs, "row", "own"), "u long, v long, n long")
    counted = counted.groupBy("u", "v").agg(F.sum("n").alias("n")).filter(F.col("n") * (SPREAD * buckets) > trained)
    of_pair = {(row.u, row.v): row.n for row in counted.collect()} if len(hot) else {}

    gram_schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("u", "v", "w", "n"))])

    def grams(row: pa.Table, own: pa.Table) -> pa.Table:
        if not row.num_rows:
            return gram_schema.empty_table()
        trigrams, _, counts = Batch(row, own, buckets).trigrams()
        found = {field.name: [] for field in gram_schema}
        for bucket, at in _dealt(bucket_of(trigrams, hot, of_pair, buckets), buckets):
            for column, value in zip(found, (row["batch"][0].as_py(), bucket, *(packed(each[at]) for each in (*trigrams, counts))), strict=True):
                found[column].append(value)
        return _table(gram_schema, found)

    sent = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _typed(grams, "row", "own"), "batch long, bucket int, u binary, v binary, w binary, n binary"
    )
    shared = spark.sparkContext.broadcast((of_word, of_pair))  # at most SPREAD * buckets words, and pairs
    code_schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("totals", pa.binary())])

    def look(table: pa.Table) -> pa.Table:
        columns = [[unpacked(raw.as_py()) for raw in table[name]] for name in ("u", "v", "w", "n")]
        lengths = [len(each) for each in columns[0]]
        u, v, w, n = (np.concatenate(each) for each in columns)
        del columns
        (_, u_at), (second, v_at), (third, w_at) = ranked(u), ranked(v), ranked(w)
        _, pair = distinct(u_at * len(second) + v_at)
        del u_at, v_at
        sample, inverse = distinct(pair * len(third) + w_at)
        del pair, w_at, second, third
        u, v, w, n = u[sample], v[sample], w[sample], np.bincount(inverse, n)
        some = n > 0
        two = three = np.zeros(len(u), np.uint8)
        if some.any():
            two, three = Trie.mapped(build(u[some], v[some], w[some], n[some], *shared.value, STRENGTH)).look(u, v, w)
        bucket = table["bucket"][0].as_py()
        found = {"batch": table["batch"].to_pylist(), "bucket": [bucket] * len(lengths), "numbers": [], "totals": []}
        compress = zstandard.ZstdCompressor(level=1).compress
        ends = np.cumsum(lengths).tolist()
        for begin, end in zip([0, *ends], ends, strict=False):
            found["numbers"].append(compress(two[inverse[begin:end]].tobytes()))
            found["totals"].append(compress(three[inverse[begin:end]].tobytes()))
        return _table(code_schema, found)

    codes = sent.groupBy("bucket").applyInArrow(_typed(look, "table"), _KNOWN)
    kind = batches.schema["keys"].dataType.elementType.simpleString()
    out_schema = pa.schema([("key", batches_key_type(batches)), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def total(row: pa.Table, own: pa.Table) -> pa.Table:
        if not row.num_rows:
            return out_schema.empty_table()
        asked = pa.array(own["kind"].to_pylist(), pa.int32()).to_numpy()
        batch = Batch(row, own.filter(pa.array(asked == 0)), buckets)
        trigrams, begins, _ = batch.trigrams()
        two, three = np.zeros(trigrams.shape[1] + 1, np.uint8), np.zeros(trigrams.shape[1] + 1, np.uint8)
        places = dict(_dealt(bucket_of(trigrams, hot, of_pair, buckets), buckets))
        expand = zstandard.ZstdDecompressor().decompress
        replies = own.filter(pa.array(asked == 1))
        for bucket, pairs, triples in zip(replies["bucket"].to_pylist(), replies["numbers"], replies["totals"], strict=True):
            two[places[bucket]], three[places[bucket]] = (np.frombuffer(expand(raw.as_py()), np.uint8) for raw in (pairs, triples))
        two, three = probability_of(two[begins]), probability_of(three[begins])  # by the token that a trigram begins with
        base = (batch.totals + 0.1) / (trained + 0.1 * (vocabulary + 1))
        place = np.arange(len(base)) - batch.firsts[batch.document]
        before = np.where(place > 0, np.arange(len(base)) - 1, 0)
        context = np.where(place > 0, batch.totals[before], 0)
        p = np.where(place > 0, two[before], 0) + STRENGTH[0] / (context + STRENGTH[0]) * base
        ahead = np.where(place > 1, np.arange(len(base)) - 2, 0)
        context = np.where(place > 1, two[ahead] * (batch.totals[ahead] + STRENGTH[0]), 0)
        p = np.where(place > 1, three[ahead], 0) + STRENGTH[1] / (context + STRENGTH[1]) * p
        sums = lambda values: np.bincount(batch.document, values, len(batch.keys))
        return pa.table({
            "key": batch.keys, "n_tokens": np.diff(batch.firsts), "n_known": sums(batch.totals > 0).astype(np.int64),
            "base_score": sums(np.log10(base)), "score": sums(np.log10(np.minimum(p, 1.0))),
        }, out_schema)

    every = answers.withColumn("kind", F.lit(0)).unionByName(codes.withColumn("kind", F.lit(1)))
    scored = batches.groupBy("batch").cogroup(every.groupBy("batch")).applyInArrow(
        _typed(total, "row", "own"), f"key {kind}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")


def batches_key_type(batches: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(batches.schema["keys"].dataType.elementType)


def lm_scores(docs: DataFrame, *, parts: int = 10, part: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that aren't held out, those with a null key too."""
    held_out = held_out_of(F.col(key), parts, part)
    return score_corpus(docs, ~held_out, key=key, text=text).select(
        key, held_out_of(F.col(key), parts, part).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
