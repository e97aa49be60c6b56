"""Hard negatives by a secondary sort.

Scores of pairs of an anchor and a row are shuffled under one packed key, (anchor, descending score, positive before negative,
id), by ``repartitionAndSortWithinPartitions``: what Spark sorts are the keys, on disk if need be. A partition is read as a stream. The first
rows of the anchor's own label are its positives; each opens a window at its score, and the rows of other labels that follow
enter every open window that is not full and reaches down to their score. Only the open windows of one anchor are held.

Anchors meet all rows, a bounded number of anchors at a time, which are sent to every task. Not every pair is worth shuffling. A
first scan finds the positives: each task keeps the best rows of the anchor's label that it reads. A second scan keeps, for
every window of an anchor, the best rows of other labels at or below the window's score. Whatever the tasks, the rows that a
window takes are among them, and the other pairs can be in no result. A task hands over what it keeps when it ends, so the
rows shuffled grow with the anchors and the number of tasks, which ``tasks_of`` bounds, and not with the pairs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tritempo.llm.common import Scratch, partitions, ragged

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: a window reaches down to this share of its positive's score
PERCENT = 80
#: ids that anchors are multiples of; ids whose multiples get the next label, of so many
ANCHORS, RELABELLED, LABELS = 100, 7, 10
#: anchors of one scan; anchors and rows that a task multiplies at once; rows that are worth a task
ABREAST, LEFT, RIGHT, ROWS = 4096, 512, 2048, 65_536
LARGEST = (1 << 63) - 1
#: anchor's id and node, score from above, 0 for a positive, id and node, as bytes that sort like the numbers
KEY = struct.Struct(">QQQBQQ")
SIGN = 1 << 63


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks of a scan: as many as the cluster runs in two waves, fewer where rows are few."""
    return max(1, min(-(-rows // ROWS), 2 * spark.sparkContext.defaultParallelism))


def rows_taking_part(rows: DataFrame, *, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(node, id, label, cells): rows with an id, a label and a vector of finite components, as floor(scale * component).

    Components are cut to a size at which a hundred times any score fits 64 bits (more than 100,000 for 64 components).
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("bound", F.floor(F.sqrt(F.lit(float(1 << 62) / 100) / F.greatest(F.size("vector"), F.lit(1)))).cast("double"))
    cell = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.col("bound")), -F.col("bound"))).cast("int")
    return rows.select(F.monotonically_increasing_id().alias("node"), "id", "label", F.transform("vector", cell).alias("cells"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exactly: by doubles where these hold them."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    return (left.astype(float) @ right.astype(float).T).astype(np.int64) if most < 1 << 53 else left @ right.T


class Wanted:
    """The best rows of windows: for each, the first ``count`` rows of its anchor from its score downwards; a row per (anchor, row)."""

    def __init__(self, anchors: np.ndarray, scores: np.ndarray, count: int) -> None:
        self.anchors, self.scores, self.count = anchors, scores, count
        #: anchor, score, id, node
        self.rows = np.zeros((0, 4), np.int64)
        self.low = np.full(anchors.max(initial=-1) + 1, -LARGEST)

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        # where each window begins: before the first row of its anchor that has its score or less
        anchor = np.concatenate([self.anchors, rows[:, 0]])
        score = np.concatenate([self.scores, rows[:, 1]])
        row = np.arange(len(anchor)) >= len(self.anchors)
        order = np.lexsort((row, -score, anchor))
        before = np.empty(len(anchor), np.int64)
        before[order] = np.cumsum(row[order])
        begins = before[: len(self.anchors)]
        ends = np.minimum(begins + self.count, np.searchsorted(rows[:, 0], self.anchors, "right"))
        places, _ = ragged(begins, ends - begins)
        needed = np.zeros(len(rows), bool)
        needed[places] = True
        full = ends - begins == self.count
        # where all windows of an anchor are full, what is below their last rows is not wanted any more
        last = np.where(full, rows[np.maximum(ends - 1, 0), 1] if len(rows) else 0, -LARGEST)
        self.low[self.anchors] = LARGEST
        np.minimum.at(self.low, self.anchors, last)
        self.rows = rows[needed]


def scan(rows: DataFrame, anchors: list[tuple[int, int, list[int], list[int] | None]], tasks: int) -> DataFrame:
    """(anchor, score, id, node) of the rows that tasks keep for anchors (node, label, cells, scores of windows).

    With None for the scores the rows of the anchor's own label, but for itself, in a single window; else those of other labels.
    Vectors of different lengths have no score.
    """
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        own = bool(held) and held[0][3] is None
        windows = [(place, score) for place, each in enumerate(held) for score in (each[3] if each[3] is not None else [LARGEST])]
        anchor, score = np.array(windows, np.int64).reshape(-1, 2).T
        wanted = Wanted(anchor, score, POSITIVES if own else NEGATIVES)
        node, label = (np.array([each[place] for each in held], np.int64) for place in (0, 1))
        lengths = np.array([len(each[2]) for each in held], np.int64)
        top, floor = np.full(len(held), -LARGEST), np.full(len(held), -LARGEST if own else LARGEST)
        np.maximum.at(top, anchor, score)
        if not own:
            np.minimum.at(floor, anchor, -(-score * PERCENT // 100))
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("cells")))
            for size in np.unique(sizes).tolist():
                asked, places = np.flatnonzero(lengths == size), np.flatnonzero(sizes == size)
                for begin in range(0, len(places), RIGHT):
                    part = batch.take(pa.array(places[begin : begin + RIGHT]))
                    ids, nodes, labels = (np.asarray(part.column(name)) for name in ("id", "node", "label"))
                    cells = np.asarray(pc.list_flatten(part.column("cells"))).reshape(len(part), size).astype(np.int64)
                    for at in range(0, len(asked), LEFT):
                        some = asked[at : at + LEFT]
                        scores = products(np.array([held[each][2] for each in some], np.int64).reshape(len(some), size), cells)
                        fits = (label[some][:, None] == labels) == own
                        fits &= (scores >= np.maximum(floor, wanted.low)[some][:, None]) & (scores <= top[some][:, None])
                        if own:
                            fits &= node[some][:, None] != nodes
                        of, row = np.nonzero(fits)
                        if len(of):
                            wanted.add(np.stack([some[of], scores[of, row], ids[row], nodes[row]], 1))
        found = wanted.rows
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), *(pa.array(found[:, column]) for column in (1, 2, 3))], ["anchor", "score", "id", "node"])

    return rows.select("id", "node", "label", "cells").coalesce(tasks).mapInArrow(keep, "anchor long, score long, id long, node long")


def packed(anchor_id: int, anchor: int, score: int, negative: int, id: int, node: int) -> bytes:
    """The key of a pair; keys sort by anchor, then from the highest score down, a positive before negatives of its score, then by id."""
    return KEY.pack(anchor_id + SIGN, anchor, LARGEST - score, negative, id + SIGN, node)


def mined(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from the sorted keys of a partition."""
    current, positives, windows = None, 0, []
    for key, _ in keys:
        anchor_id, anchor, inverse, negative, id, _ = KEY.unpack(key)
        score = LARGEST - inverse
        if (anchor_id, anchor) != current:
            current, positives, windows = (anchor_id, anchor), 0, []
        if not negative:
            if positives < POSITIVES:
                windows.append([id - SIGN, score, 0])
            positives += 1
            continue
        windows = [window for window in windows if window[2] < NEGATIVES and 100 * score >= PERCENT * window[1]]
        for window in windows:
            window[2] += 1
            yield anchor_id - SIGN, window[0], window[2], id - SIGN, window[1], score


def hard_negatives(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, anchors: int = ANCHORS,
    relabelled: int | None = RELABELLED, labels: int = LABELS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchors``; where it is divisible by ``relabelled``, the label is first moved on by
    one of ``labels``. Rows with a null id, label or vector, or with a null or non-finite component take no part. Rows that share an id are
    rows of their own, each an anchor if the id is one. Equal scores are ordered by id. Nothing comes of an empty table, an
    anchor without positives, or a positive with a score below zero. Other columns of the input are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = rows_taking_part(rows, key=key, vector=vector, label=label, scale=scale)
    if relabelled:
        rows = rows.withColumn("label", F.when(F.col("id") % relabelled == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    rows = scratch.put(rows, "rows")
    tasks = tasks_of(spark, rows.count())
    chosen = rows.filter(F.col("id") % anchors == 0)
    chunks = -(-chosen.count() // ABREAST)
    chosen = scratch.put(chosen.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(max(chunks, 1)))), "anchors")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "node")
    pairs = []
    for chunk in range(chunks):
        held = chosen.filter(F.col("chunk") == chunk).select("node", "label", "cells").collect()
        near = scan(rows, [(row.node, row.label, row.cells, None) for row in held], tasks)
        near = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= POSITIVES)
        near = scratch.put(near.select("anchor", "score", "id", "node", F.lit(0).alias("negative")), f"positives-{chunk}")
        scores: dict[int, set[int]] = {}
        for row in near.filter("score >= 0").select("anchor", "score").collect():
            scores.setdefault(row.anchor, set()).add(row.score)
        held = [(row.node, row.label, row.cells, sorted(scores[row.node])) for row in held if row.node in scores]
        far = scan(rows, held, tasks).withColumn("negative", F.lit(1))
        pairs += [near, scratch.put(far, f"negatives-{chunk}")]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not pairs:
        return spark.createDataFrame([], schema)
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    every = every.join(chosen.select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    keys = every.select("anchor_id", "anchor", "score", "negative", "id", "node").rdd.map(lambda row: (packed(*row), None))
    keys = keys.repartitionAndSortWithinPartitions(partitions(spark), lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(keys.mapPartitions(mined), schema)
