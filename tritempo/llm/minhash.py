"""Near-duplicate documents by b-bit MinHash.

A document's set is the distinct shingles of its lower-cased text, of three words by default; links have a similarity of 85 % by
default (``Rule``). Its sketch has ``PERMUTATIONS`` minima: bands of a few whole minima name candidates, and the low ``BITS`` bits of all minima, packed into bit planes, estimate
the similarity of candidates by counting bits, corrected for chance agreement of so few bits. What the estimate doesn't
rule out is confirmed on the full sets.

Documents with equal sets are one class and are compared once. Within a band bucket no list of all pairs is made:

1. every class is compared with the first class of its bucket (as many pairs as members), and the confirmed links are
   grouped into components;
2. buckets that still hold classes of different components, and only those, are compared in tiles of bounded size. Each pair
   belongs to the first band that its classes share. A first pass over the sketches finds which classes of a tile have a
   partner in another component that the estimate allows; only their sets go to the second pass, which confirms pairs
   within the task, best estimates first, and skips those that its links have connected meanwhile.

So no pairs are shuffled but those of the first step and confirmed links, and still no link is skipped: for classes of one
component more links change nothing. Bands follow the threshold, so that they miss a pair at it with a probability of less
than one in a million ((1 - 0.85**5)**25 at 85 %), and so does the estimate, which misses about as much.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import SPACE, Scratch, column_bytes, components, fresh, joined_bytes, lowered, mixed, slices, words

PERMUTATIONS, BITS = 128, 4
#: words of a shingle; links have 100 * intersection >= PERCENT * union
SIZE, PERCENT = 3, 85
#: probability that the bands miss a pair at the threshold, at most
MISSED = 1e-6
#: members of one side of a tile
TILE = 1000

_RANDOM = np.random.default_rng(20)
_FACTORS = (_RANDOM.integers(1, 1 << 32, PERMUTATIONS, np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, np.uint64).astype(np.uint32)
_PLACES = _RANDOM.integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)


class Rule(NamedTuple):
    """What near duplicates are, and what follows for their search."""

    size: int = SIZE
    percent: int = PERCENT

    def checked(self) -> Rule:
        if not 1 <= self.size <= len(_PLACES) or not 11 <= self.percent <= 100:
            raise ValueError("shingles have 1 to 8 words, and the least similarity is 11 to 100 percent")
        return self

    @property
    def rows(self) -> int:
        """Minima of a band: as many as bands that miss hardly a pair at the threshold may have."""
        for rows in range(7, 1, -1):
            if (1 - (self.percent / 100) ** rows) ** (PERMUTATIONS // rows) < MISSED:
                return rows
        return 1

    @property
    def bands(self) -> int:
        return PERMUTATIONS // self.rows

    @property
    def least_estimate(self) -> float:
        """An estimate below this rules a pair out: 4.5 standard deviations below the threshold, rounded down."""
        chance, least = 2.0**-BITS, self.percent / 100
        agree = least + (1 - least) * chance
        return math.floor(100 * (least - 4.5 * math.sqrt(agree * (1 - agree) / PERMUTATIONS) / (1 - chance))) / 100


def shingle_sets(offsets: np.ndarray, data: np.ndarray, start: int, stop: int, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of some rows. Texts of fewer words have their whole sequence as the only one."""
    joined, begins = joined_bytes(offsets, data, start, stop)
    _, _, hashes, firsts = words(lowered(joined), begins, SPACE)
    count = max(len(hashes) - size + 1, 0)
    shingles = np.zeros(count, np.uint64)
    for place in range(size):
        shingles += hashes[place : place + count] * _PLACES[place]
    shingles = mixed(shingles)
    sets = []
    for first, last in zip(firsts.tolist(), firsts[1:].tolist(), strict=False):
        if last - first >= size:
            sets.append(np.unique(shingles[first : last - size + 1]))
        elif last > first:
            whole = (hashes[first:last] * _PLACES[: last - first]).sum(dtype=np.uint64) + np.array([last - first], np.uint64)
            sets.append(mixed(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every permutation over a set."""
    low = shingles.astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1), out=least)
    return least


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest() if len(shingles) else None


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, n_shingles, digest, bands, bits) of every row; no digest and no bands without words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    count, width = rule.bands, rule.rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                sets = shingle_sets(offsets, data, start, stop, rule.size)
                least = np.stack([minima(each) for each in sets])
                bands = mixed(
                    (least[:, : count * width].reshape(-1, count, width).astype(np.uint64) * _PLACES[:width]).sum(2, dtype=np.uint64)
                    + np.arange(count, dtype=np.uint64) * _PLACES[7]
                ).view(np.int64)
                planes = np.stack([(least >> plane) & 1 for plane in range(BITS)], 1).astype(np.uint8)
                bits = np.packbits(planes.reshape(len(sets), -1), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), pa.array([len(each) for each in sets], pa.int64()),
                    pa.array([digest(each) for each in sets], pa.binary()),
                    pa.array([list(row) if len(each) else [] for row, each in zip(bands, sets, strict=True)], pa.list_(pa.int64())),
                    pa.array(list(bits), pa.list_(pa.int64())),
                ], ["key", "n_shingles", "digest", "bands", "bits"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"key {kind}, n_shingles long, digest binary, bands array<long>, bits array<long>")


def estimate(left: str, right: str):
    """Similarity estimated from two columns of packed bits: the share of minima whose low bits agree, less what agrees by chance."""
    words_ = PERMUTATIONS // 64
    differ = F.lit(0)
    for word in range(words_):
        planes = [F.col(left)[plane * words_ + word].bitwiseXOR(F.col(right)[plane * words_ + word]) for plane in range(BITS)]
        any_plane = planes[0]
        for plane in planes[1:]:
            any_plane = any_plane.bitwiseOR(plane)
        differ = differ + F.bit_count(any_plane)
    return _corrected(1 - differ / PERMUTATIONS)


def _corrected(agree):
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


class Tile:
    """Classes of one bucket, or of two parts of a large one, with their sketches."""

    def __init__(self, rows: pa.Table, rule: Rule) -> None:
        self.percent, self.least = rule.percent, rule.least_estimate
        self.band = rows["band"][0].as_py()
        self.node, self.component = rows["node"].to_numpy(), rows["component"].to_numpy()
        self.size, self.side = rows["n_shingles"].to_numpy(), rows["side"].to_numpy()
        self.bits = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(self.node), BITS, -1)
        self.bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(self.node), rule.bands)

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For one place after the other its possible partners in other components, and the estimates."""
        # side 2: both sides of a tile on the diagonal
        two = np.flatnonzero(self.side != 0)
        for at in np.flatnonzero(self.side != 1).tolist():
            others = two[(self.component[two] != self.component[at]) & ((self.node[two] > self.node[at]) | (self.side[at] != 2))]
            fits = 100 * np.minimum(self.size[others], self.size[at]) >= self.percent * np.maximum(self.size[others], self.size[at])
            others = others[fits]
            differ = np.bitwise_count(np.bitwise_or.reduce(self.bits[others] ^ self.bits[at], axis=1)).sum(1)
            score = _corrected(1 - differ / PERMUTATIONS)
            others, score = others[score >= self.least], score[score >= self.least]
            first = (self.bands[others] == self.bands[at]).argmax(1)
            own = self.bands[at][first] == self.band
            if own.any():
                yield at, others[own], score[own]


def _active(rows: pa.Table, rule: Rule) -> pa.Table:
    """Classes of a tile that have a possible partner."""
    tile = Tile(rows, rule)
    active = np.zeros(len(tile.node), bool)
    for at, others, _ in tile.pairs():
        active[at] = True
        active[others] = True
    return rows.select(["band", "i", "j", "side", "node"]).filter(pa.array(active))


def _links(rows: pa.Table, rule: Rule) -> pa.Table:
    """Confirmed links of a tile that connect all components which any of its links connects."""
    tile, members = Tile(rows, rule), [np.frombuffer(value.as_buffer(), np.uint64) for value in rows["members"]]
    found = list(tile.pairs())
    left = np.concatenate([np.zeros(0, np.int64), *[np.full(len(others), at) for at, others, _ in found]])
    right = np.concatenate([np.zeros(0, np.int64), *[others for _, others, _ in found]])
    order = np.argsort(-np.concatenate([np.zeros(0), *[score for _, _, score in found]]), kind="stable")
    _, group = np.unique(tile.component, return_inverse=True)
    parent = list(range(len(group)))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    a, b = [], []
    for one, two in zip(left[order].tolist(), right[order].tolist(), strict=True):
        x, y = root(int(group[one])), root(int(group[two]))
        if x != y and linked(members[one], members[two], rule.percent):
            parent[x] = y
            a.append(int(tile.node[one]))
            b.append(int(tile.node[two]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _by_rule(function: Callable[[pa.Table, Rule], pa.Table], rule: Rule) -> Callable[[pa.Table], pa.Table]:
    def of_tile(rows):
        return function(rows, rule)

    of_tile.__annotations__ = {"rows": pa.Table, "return": pa.Table}  # hints from which Spark tells how to call it
    return of_tile


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def full_sets(docs: DataFrame, classes: DataFrame, ends: DataFrame, *, key: str, text: str, rule: Rule) -> DataFrame:
    """(node, members) of the nodes in ``ends``: their texts are read again."""
    wanted = classes.join(ends.select("node").distinct(), "node", "left_semi").select("node", "key", "digest")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted.select("key").distinct(), "key", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column("text"))
            for start, stop in slices(offsets):
                sets = shingle_sets(offsets, data, start, stop, rule.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(each) for each in sets], pa.binary()), pa.array([each.tobytes() for each in sets], pa.binary())],
                    ["digest", "members"],
                )

    sets = rows.mapInArrow(full, "digest binary, members binary").filter("digest is not null")
    # repeated rows give a set twice
    return sets.join(wanted.select("node", "digest"), "digest").groupBy("node").agg(F.first("members").alias("members"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) that are links by their full sets."""
    met = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "members": "left"}), "a")
    met = met.join(sets.withColumnsRenamed({"node": "b", "members": "right"}), "b").select("a", "b", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(batch.column("left"), batch.column("right"), strict=True)
            links = [linked(np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64), percent) for left, right in values]
            keep = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: component_id is the smallest key that links reach, kept marks it.

    Shingles have ``size`` words, and links ``percent`` percent of their distinct shingles in common.
    Null and empty texts and texts of white space have no shingles and are linked with nothing. Rows that share a key are
    compared by their texts like any others. A row without a key isn't compared: its component is null, it is kept. Other
    columns of the input are not read.
    """
    rule = Rule(size, percent).checked()
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.put(sketches(docs, key=key, text=text, rule=rule), "sketches")
    classes = rows.filter("digest is not null and key is not null").groupBy("digest").agg(
        F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = scratch.put(classes.select("node", F.explode("bands").alias("band")), "bands")
    shape = classes.select("node", "n_shingles", "bits")

    # 1. every class with the first class of its bucket
    centre = member.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    star = member.join(centre, "band").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    star = star.join(shape.toDF("a", "size_a", "bits_a"), "a").join(shape.toDF("b", "size_b", "bits_b"), "b")
    star = star.filter(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)").filter(estimate("bits_a", "bits_b") >= rule.least_estimate)
    star = scratch.put(star.select("a", "b"), "star")
    ends = star.select(F.col("a").alias("node")).union(star.select("b"))
    sets = scratch.put(full_sets(docs, classes, ends, key=key, text=text, rule=rule), "star-sets")
    links = scratch.put(confirmed(star, sets, percent), "star-links")
    grouped = components(scratch, links, "star")
    scratch.drop("star", "star-sets")

    # 2. buckets whose classes are not of one component yet
    own = member.join(grouped, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    open_ = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    open_ = open_.filter("low <> high").select("band", F.ceil(F.col("n") / TILE).cast("int").alias("cuts"))
    placed = own.join(open_, "band").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    placed = scratch.put(placed.join(classes.select("node", "n_shingles", "bits", "bands"), "node"), "open")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    tiles = placed.select("band", "node", "component", "n_shingles", "bits", "bands", "cut", other).select(
        "band", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "node", "component", "n_shingles", "bits", "bands",
        F.when(F.col("cut") == F.col("other"), 2).when(F.col("cut") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    active = tiles.groupBy("band", "i", "j").applyInArrow(_by_rule(_active, rule), "band long, i int, j int, side int, node long")
    active = scratch.put(active, "active")
    sets = scratch.put(full_sets(docs, classes, active, key=key, text=text, rule=rule), "tile-sets")
    sketch = placed.select("band", "node", "component", "n_shingles", "bits", "bands")
    met = active.join(sketch, ["band", "node"]).join(sets, "node")
    more = scratch.put(met.groupBy("band", "i", "j").applyInArrow(_by_rule(_links, rule), "a long, b long"), "tile-links")
    grouped = components(scratch, links.union(more), "all")
    scratch.drop("open", "active", "tile-sets")

    named = classes.select("node", "digest", "key").join(grouped, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = scratch.put(named.join(smallest, "component").select("digest", "component_id"), "named")
    scratch.drop("bands", "classes")
    result = rows.select("key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return result.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept")
    )


def first_of_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that have an earlier near duplicate; all columns stay.

    Rows that share a key go together if any of them has an earlier near duplicate; of rows that share key and text, one stays.
    """
    gone = fresh("_late", docs.columns)
    late = near_duplicates(docs, key=key, text=text, size=size, percent=percent).filter(~F.col("kept")).select(F.col(key).alias(gone)).distinct()
    late = Scratch(docs.sparkSession, "late").put(late, "keys")
    rows = docs.join(late, docs[key] == F.col(gone), "left_anti")
    repeated = docs.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).limit(1).count()
    return rows.dropDuplicates([key, text]) if repeated else rows
