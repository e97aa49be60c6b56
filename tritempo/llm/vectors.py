"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node. The neighbour graph starts from a few tables of random hyperplanes: nodes of a bucket are each other's
first candidates. Then neighbours of neighbours are joined: for every node the neighbours of its neighbours are compared with it, and
the best ``LIST`` found so far stay its neighbours, until hardly a list changes. What the lists hold beyond the threshold are links, and
links make groups.

A node whose list is full of links is saturated. Its list is enlarged to the whole group at once, and not as rows: all vectors of a
group are compared in tiles of bounded size, which hand over a number of links for each node. So a group of n near copies costs
n * n comparisons, which its link counts ask for, but rows only as n; what is kept are nodes, groups and links that span them.

Links between groups are looked for in further tables. Of each two groups that meet in a bucket one link is enough, as they
become one group then; buckets without a second group are passed over, and vectors are only sent for the rest. The tables follow the number
of vectors: in all rounds a pair at the threshold shares a bucket with probability ``MET``. After every round a sample of all nodes is
audited against all vectors: a link counts as found if its ends are in one group. Recall is the mean over nodes, apart for those with few
links and those with many, so that no large group hides lost pairs. Rounds end early only where the sample has shown enough nodes with
few links; if the target is missed after the last, all vectors are compared in blocks.

NN-descent compares vectors rounded to 8 bits. The rounding error bounds how far a cosine may be off; pairs for which that
leaves the threshold in doubt are compared in double precision, as are pairs between groups and the vectors of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tritempo.llm.common import Scratch, components

THRESHOLD = 0.9
#: neighbours in a list
LIST = 8
#: nodes of a bucket compared at once in the first tables and in the further ones, and nodes that share a bucket on average
CHUNK, WIDE, BUCKET = 400, 1000, 16
#: tables that fill the first lists
TABLES = 8
#: probability that a pair at the threshold shares a bucket of some further table, and how often the search is extended by as many again
MET, EXTENSIONS = 0.999, 2
ROUNDS, CHANGED = 6, 0.002
#: audited nodes, the recall they must show, and nodes with few links that must be among them to end early
AUDITED, RECALL, EVIDENCE = 2048, 0.995, 200
#: groups up to this size are compared as one value, larger ones in tiles
SMALL, TILE = 64, 1000
#: nodes that are compared with all others at once, and of these those in one product
BLOCK, PRODUCT = 20_000, 512


def read_vectors(rows: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(key, digest, unit, rounded, error): unit vectors in double precision, and rounded to 8 bits.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, have a null digest.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("usable", F.coalesce(usable & F.exists("vector", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda x: x + F.lit(0.0))))
    digest = F.when(F.col("usable"), F.sha2(F.to_json(F.struct("vector")), 256))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, rounded, errors = [], [], []
            for value in batch.column("vector"):
                if not value.is_valid:
                    unit.append(None), rounded.append(None), errors.append(None)
                    continue
                x = value.values.to_numpy()
                x = x / np.abs(x).max()  # very large and very small numbers have a norm, too
                x = x / math.sqrt(float(x @ x))
                low = np.rint(x * 127).astype(np.int8)
                unit.append(x.tobytes()), rounded.append(low.tobytes()), errors.append(float(np.linalg.norm(x - low / 127)))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("digest"), pa.array(unit, pa.binary()), pa.array(rounded, pa.binary()), pa.array(errors, pa.float64()),
            ], ["key", "digest", "unit", "rounded", "error"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", digest.alias("digest"), "vector").mapInArrow(units, f"key {kind}, digest string, unit binary, rounded binary, error double")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Equally long binary values as rows."""
    return np.frombuffer(b"".join(value.as_buffer() for value in column), kind).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows whose values have the same length."""
    lengths = np.array([value.as_buffer().size for value in column], np.int64)
    for length in np.unique(lengths).tolist():
        yield np.flatnonzero(lengths == length)


def bits_of(count: int) -> int:
    """Hyperplanes of a table: about ``BUCKET`` of so many nodes share a bucket."""
    return max(2, min(30, math.ceil(math.log2(max(1, count) / BUCKET))))


def tables_of(bits: int) -> int:
    """Tables for which a pair at the threshold shares a bucket of one at least with probability ``MET``.

    A hyperplane parts two vectors with a probability of their angle over pi.
    """
    same = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - MET) / math.log(1 - same)))


def bucketed(nodes: DataFrame, vector: str, kind: type, bits: int, tables: int, seed: int) -> DataFrame:
    """``nodes`` with the length of their vectors and the bucket of every table: signs of products with random planes."""
    names = nodes.columns
    at = names.index(vector)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column(at)):
                for begin in range(0, len(rows), 2000):
                    part = batch.take(pa.array(rows[begin : begin + 2000]))
                    x = _matrix(part.column(at), kind).astype(np.float32)
                    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits)).astype(np.float32)
                    signs = (x @ planes > 0).reshape(len(x), tables, bits)
                    bucket = (signs * (1 << np.arange(bits))).sum(2) * tables + np.arange(tables)
                    more = [pa.array([x.shape[1]] * len(x), pa.int64()), pa.array(list(bucket), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, "dim", "buckets"])

    fields = ", ".join(f"{name} {type_}" for name, type_ in nodes.dtypes)
    return nodes.mapInArrow(keys, f"{fields}, dim long, buckets array<long>")


def first_pairs(nodes: DataFrame, count: int, seed: int, tables: int = TABLES) -> DataFrame:
    """(a, b, sim): the best neighbours of every node in its part of its buckets; a bucket of many nodes is dealt out to parts by hash."""
    placed = bucketed(nodes.select("node", "rounded"), "rounded", np.int8, bits_of(count), tables, seed)
    placed = placed.select("node", "dim", "rounded", F.explode("buckets").alias("bucket"))
    cuts = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n")).filter("n > 1").select("dim", "bucket", F.ceil(F.col("n") / CHUNK).alias("cuts"))
    placed = placed.join(cuts, ["dim", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("node", "bucket", F.lit(seed)), F.col("cuts")))

    def best(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        x = _matrix(table["rounded"].combine_chunks(), np.int8).astype(np.float32) / 127
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        keep = min(LIST, len(node) - 1)
        if keep < 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
        near = np.argpartition(-sims, keep - 1, 1)[:, :keep]
        left, right = np.repeat(np.arange(len(node)), keep), near.ravel()
        return pa.table({"a": node[left], "b": node[right], "sim": sims[left, right]})

    best.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return placed.groupBy("dim", "bucket", "chunk").applyInArrow(best, "a long, b long, sim float")


def between_groups(scratch: Scratch, nodes: DataFrame, grouped: DataFrame, count: int, seed: int, tables: int, name: str) -> DataFrame:
    """(a, b): for each two groups that meet in a bucket their best pair there, if it is a link.

    ``grouped`` names the group of the linked nodes; any other is a group by itself.
    """
    own = nodes.select("node", "unit").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.put(bucketed(own, "unit", np.float64, bits_of(count), tables, seed), f"{name}-buckets")
    placed = own.select("node", "component", "dim", F.explode("buckets").alias("bucket"))
    met = placed.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = scratch.put(met.filter("low <> high").select("dim", "bucket", F.ceil(F.col("n") / WIDE).alias("cuts")), f"{name}-met")
    placed = placed.join(met, ["dim", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("cuts")))
    # every chunk meets every other, so that a bucket of any size is compared whole
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    placed = placed.select("dim", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "component", "chunk")
    placed = scratch.put(placed, f"{name}-placed").join(own.select("node", "unit"), "node")

    def links(table: pa.Table) -> pa.Table:
        node, group, chunk = (table[each].to_numpy() for each in ("node", "component", "chunk"))
        unit = _matrix(table["unit"].combine_chunks(), np.float64)
        x = unit.astype(np.float32)
        sims = x @ x.T
        fits = (sims >= THRESHOLD - 1e-4) & (group[:, None] < group)
        if table["i"][0].as_py() != table["j"][0].as_py():
            fits &= chunk[:, None] != chunk
        left, right = np.nonzero(fits)
        exact = np.einsum("ij,ij->i", unit[left], unit[right])
        order = np.lexsort((-exact, group[right], group[left]))
        left, right, exact = left[order], right[order], exact[order]
        first = np.ones(len(left), bool)
        first[1:] = (group[left[1:]] != group[left[:-1]]) | (group[right[1:]] != group[right[:-1]])
        first &= exact >= THRESHOLD
        return pa.table({"a": node[left[first]], "b": node[right[first]]})

    links.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return placed.groupBy("dim", "bucket", "i", "j").applyInArrow(links, "a long, b long").distinct()


def compared(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs by the rounded vectors; only vectors of one length are comparable."""
    vector = nodes.select("node", "rounded")
    met = pairs.select("a", "b").join(vector.withColumnsRenamed({"node": "a", "rounded": "left"}), "a")
    met = met.join(vector.withColumnsRenamed({"node": "b", "rounded": "right"}), "b").filter("length(left) = length(right)").select("a", "b", "left", "right")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.zeros(batch.num_rows, np.float32)
            for rows in _by_length(batch.column("left")):
                part = batch.take(pa.array(rows))
                left, right = (_matrix(part.column(side), np.int8).astype(np.float32) for side in ("left", "right"))
                sims[rows] = np.einsum("ij,ij->i", left, right) / 127**2
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], ["a", "b", "sim"])

    return met.mapInArrow(dots, "a long, b long, sim float")


def merged(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Neighbour lists (node, nbr, sim, fresh) with the pairs found, both ways, cut to LIST."""
    both = found.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "sim").union(found.select("b", "a", "sim"))
    every = lists.select("node", "nbr", "sim", F.lit(0).alias("fresh")).union(both.withColumn("fresh", F.lit(1)))
    every = every.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return every.withColumn("n", place).filter(F.col("n") <= LIST).drop("n")


def descend(scratch: Scratch, nodes: DataFrame, lists: DataFrame, count: int, name: str) -> DataFrame:
    """Rounds of joining neighbours of neighbours."""
    last = None
    for turn in range(ROUNDS):
        looked = lists.select(F.col("node").alias("v"), F.col("nbr").alias("u"), F.col("fresh").alias("new"))
        reached = lists.select(F.col("node").alias("u"), F.col("nbr").alias("w"), "fresh")
        pairs = looked.join(reached, "u").filter("v <> w and (new = 1 or fresh = 1)")
        pairs = pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
        known = lists.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
        found = compared(nodes, pairs.join(known, ["a", "b"], "left_anti"))
        lists = scratch.put(merged(lists, found), f"{name}-lists-{turn}")
        if last is not None:
            scratch.drop(last)
        last = f"{name}-lists-{turn}"
        if lists.filter("fresh = 1").count() <= CHANGED * LIST * count:
            break

    return lists


def exact_edges(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b) with a < b of the pairs in the lists whose cosine reaches the threshold.

    The rounding errors of both vectors bound that of the cosine; pairs in doubt are compared in double precision.
    """
    pairs = lists.filter(F.col("sim") >= THRESHOLD - 0.05).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b"), "sim")
    pairs = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    error = nodes.select("node", "error")
    pairs = pairs.join(error.toDF("a", "error_a"), "a").join(error.toDF("b", "error_b"), "b")
    # |<x, y> - <x', y'>| <= |x - x'| + |y - y'| (1 + |x - x'|), and a little for single precision
    bound = F.col("error_a") + F.col("error_b") + F.col("error_a") * F.col("error_b") + 1e-5
    sure = pairs.filter(F.col("sim") - bound >= THRESHOLD).select("a", "b")
    doubt = pairs.filter((F.col("sim") - bound < THRESHOLD) & (F.col("sim") + bound >= THRESHOLD)).select("a", "b")
    unit = nodes.select("node", "unit")
    met = doubt.join(unit.toDF("a", "left"), "a").join(unit.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                float(np.frombuffer(left.as_buffer()) @ np.frombuffer(right.as_buffer())) >= THRESHOLD
                for left, right in zip(batch.column("left"), batch.column("right"), strict=True)
            ]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return sure.union(met.mapInArrow(dots, "a long, b long"))


def exact_links(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, other) of the links of the nodes in ``asked``, which are few enough to be collected, with those of other components,
    by brute force against all vectors."""
    held = [(row.node, np.frombuffer(row.unit), row.component) for row in asked.select("node", "unit", "component").collect()]
    shared = nodes.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column("unit")):
                for begin in range(0, len(rows), 4096):
                    part = batch.take(pa.array(rows[begin : begin + 4096]))
                    x, node, group = _matrix(part.column("unit"), np.float64), part.column("node").to_numpy(), part.column("component").to_numpy()
                    queries = [each for each in shared.value if len(each[1]) == x.shape[1]]
                    for start in range(0, len(queries), PRODUCT):
                        some = queries[start : start + PRODUCT]
                        names, groups = (np.array([each[place] for each in some]) for place in (0, 2))
                        at, of = np.nonzero((x @ np.stack([each[1] for each in some]).T >= THRESHOLD) & (group[:, None] != groups))
                        yield pa.RecordBatch.from_arrays([pa.array(names[of]), pa.array(node[at])], ["asked", "other"])

    return nodes.select("node", "unit", "component").mapInArrow(scan, "asked long, other long")


def link_shares(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, links, same): by brute force against all vectors, the links of the few nodes in ``asked`` and those within their component.

    Tasks hand over sums for every batch, not links, so a large group makes no more rows than a small one.
    """
    held = [(row.node, np.frombuffer(row.unit), row.component) for row in asked.select("node", "unit", "component").collect()]
    shared = nodes.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = (np.array([each[place] for each in shared.value], np.int64) for place in (0, 2))
        lengths = np.array([len(each[1]) for each in shared.value], np.int64)
        sums = np.zeros((2, len(names)), np.int64)
        for batch in batches:
            for rows in _by_length(batch.column("unit")):
                for begin in range(0, len(rows), 4096):
                    part = batch.take(pa.array(rows[begin : begin + 4096]))
                    x, node, group = _matrix(part.column("unit"), np.float64), part.column("node").to_numpy(), part.column("component").to_numpy()
                    own = np.flatnonzero(lengths == x.shape[1])
                    for start in range(0, len(own), PRODUCT):
                        some = own[start : start + PRODUCT]
                        links = (x @ np.stack([shared.value[each][1] for each in some]).T >= THRESHOLD) & (node[:, None] != names[some])
                        sums[0, some] += links.sum(0)
                        sums[1, some] += (links & (group[:, None] == groups[some])).sum(0)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(sums[0, some]), pa.array(sums[1, some])], ["asked", "links", "same"])

    found = nodes.select("node", "unit", "component").mapInArrow(scan, "asked long, links long, same long")
    return found.groupBy("asked").agg(F.sum("links").alias("links"), F.sum("same").alias("same"))


def audit(nodes: DataFrame, grouped: DataFrame, sample: int = AUDITED) -> tuple[float, float, int]:
    """The mean recall of sampled nodes with few links (up to ``LIST``) and of those with more, and how many of the former there are.

    The sample is taken of all nodes by hash, whatever has been found of them. A link of theirs, by brute force against all vectors,
    is found if both its ends are in one group: links within groups are counted exactly. Recall is 1 where there is no such node.
    """
    own = nodes.select("node", "unit").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    asked = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(sample)
    each = link_shares(own, own.join(asked, "node", "left_semi")).withColumn("recall", F.col("same") / F.col("links"))
    few = F.col("links") <= LIST
    shown = each.agg(F.avg(F.when(few, F.col("recall"))), F.avg(F.when(~few, F.col("recall"))), F.count(F.when(few, 1))).first()
    return (1.0 if shown[0] is None else shown[0], 1.0 if shown[1] is None else shown[1], shown[2])


def all_edges(scratch: Scratch, nodes: DataFrame, grouped: DataFrame, count: int) -> DataFrame:
    """(a, b) with a < b of all links between groups: every vector against every other, ``BLOCK`` vectors at a time."""
    cuts = math.ceil(max(1, count) / BLOCK)
    own = nodes.select("node", "unit").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.put(own.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(cuts))), "blocks")
    found = None
    for block in range(cuts):
        links = exact_links(own, own.filter(F.col("block") == block)).filter("asked < other").toDF("a", "b")
        links = scratch.put(links, f"exact-{block}")
        found = links if found is None else found.union(links)
    return found


def _others(unit: np.ndarray, copies: np.ndarray, left: slice, right: slice) -> np.ndarray:
    """For rows on the left the copies of the linked rows on the right, without a row itself."""
    out = np.zeros(left.stop - left.start, np.int64)
    for begin in range(left.start, left.stop, PRODUCT):
        some = slice(begin, min(begin + PRODUCT, left.stop))
        links = unit[some] @ unit[right].T >= THRESHOLD
        rows = np.arange(some.start, some.stop)
        inside = (rows >= right.start) & (rows < right.stop)
        links[np.flatnonzero(inside), rows[inside] - right.start] = False
        out[some.start - left.start : some.stop - left.start] = links @ copies[right]
    return out


def link_counts(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(node, others): the rows other than its own copies that a node is linked with, by comparing all vectors of its group."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("n"))
    member = nodes.select("node", "copies", "unit").join(grouped, "node").join(sizes, "component")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names = [], []
            for group in batch.column("held"):
                rows = group.values
                unit, copies = _matrix(rows.field("unit"), np.float64), rows.field("copies").to_numpy()
                every = slice(0, len(rows))
                found.append(_others(unit, copies, every, every))
                names.append(rows.field("node").to_numpy())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(found))], ["node", "others"])

    small = member.filter(F.col("n") <= SMALL).groupBy("component").agg(F.collect_list(F.struct("node", "copies", "unit")).alias("held"))
    small = small.select("held").mapInArrow(whole, "node long, others long")

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("cut")
        cut = table["cut"].to_numpy()
        unit, copies = _matrix(table["unit"].combine_chunks(), np.float64), table["copies"].to_numpy()
        split, size = int(np.searchsorted(cut, cut[0], "right")), len(cut)
        if table["i"][0].as_py() == table["j"][0].as_py():
            others = _others(unit, copies, slice(0, size), slice(0, size))
        elif split == size:  # the other part is empty
            others = np.zeros(size, np.int64)
        else:
            others = np.concatenate([_others(unit, copies, slice(0, split), slice(split, size)), _others(unit, copies, slice(split, size), slice(0, split))])
        return pa.table({"node": table["node"], "others": others})

    tile.__annotations__ = {"table": pa.Table, "return": pa.Table}
    cuts = F.ceil(F.col("n") / TILE).cast("int")
    large = member.filter(F.col("n") > SMALL).withColumn("cut", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    large = large.select("component", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut", "node", "copies", "unit")
    large = large.groupBy("component", "i", "j").applyInArrow(tile, "node long, others long")
    return small.union(large).groupBy("node").agg(F.sum("others").alias("others"))


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: the other rows linked directly, and the smallest key that links reach.

    Vectors that are null, empty or zero or hold null or non-finite numbers link with nothing; nor do vectors of different
    lengths. Rows with equal vectors are linked; rows that share a key are told apart. A row with a null key is linked and
    counted; its component is the smallest key of the others, and it is kept if there is none.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    vectors = scratch.put(read_vectors(rows, key=key, vector=vector), "vectors")
    nodes = vectors.filter("digest is not null").groupBy("digest").agg(
        F.min("key").alias("key"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("rounded").alias("rounded"),
        F.first("error").alias("error"),
    )
    nodes = scratch.put(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    found = scratch.put(first_pairs(nodes, count, 11), "first")
    start = found.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "sim", F.lit(1).alias("fresh"))
    start = scratch.put(merged(start, found).withColumn("fresh", F.lit(1)), "start")
    lists = descend(scratch, nodes, start, count, "run")
    edges = scratch.put(exact_edges(nodes, lists), "edges")
    scratch.drop("first", "start")
    grouped = components(scratch, edges, "grouped")
    tables = math.ceil(tables_of(bits_of(count)) / (1 + EXTENSIONS))
    for turn in range(1 + EXTENSIONS):
        more = scratch.put(between_groups(scratch, nodes, grouped, count, 12 + turn, tables, f"turn-{turn}"), f"more-{turn}")
        scratch.drop(f"turn-{turn}-buckets", f"turn-{turn}-met", f"turn-{turn}-placed")
        if more.limit(1).count():
            edges = edges.union(more)
            grouped = components(scratch, edges, f"grouped-{turn}")
        few, many, seen = audit(nodes, grouped)
        if min(few, many) >= RECALL and seen >= EVIDENCE:
            break
    if min(few, many) < RECALL:
        grouped = components(scratch, edges.union(all_edges(scratch, nodes, grouped, count)), "all")
    links = link_counts(nodes, grouped)
    named = nodes.select("node", "digest", "key", "copies").join(links, "node", "left").join(grouped, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    named = scratch.put(named.select("digest", "key", "component", "n_links"), "linked")
    smallest = scratch.put(named.groupBy("component").agg(F.min("key").alias("component_id")), "smallest")
    named = scratch.put(named.join(smallest, "component").select("digest", "n_links", "component_id"), "named")
    result = vectors.select("key", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "key")
    return result.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, component.isNull()).alias("kept"),
    )
