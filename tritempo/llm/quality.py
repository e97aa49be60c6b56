"""Quality of documents: a Gaussian-kernel ridge classifier on statistics of the text, calibrated.

Each text becomes some thirty numbers: shares of kinds of characters, lengths and repetition of words and lines. Random Fourier
features of the standardized numbers approximate a Gaussian kernel. The normal equations are sums over rows, so every
partition adds up its own and only sums are shuffled: one row for each row of the matrix and partition. The driver
solves a system of ``FEATURES`` + 1 unknowns. Scores are calibrated by isotonic regression on counts by bins of the score.
Texts are read once; what follows works on the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import SPACE, Scratch, column_bytes, joined_bytes, lowered, slices, words
from tritempo.llm.langid import held_out_of

FEATURES, RIDGE, WIDTH = 384, 1e-3, 0.35
#: bins of raw scores between -0.5 and 1.5 for the calibration
BINS = 4000
#: parts in which the sums of tasks are added up first, and decimal digits of a score
PARTS, DIGITS = 64, 12

#: groups of bytes whose shares are statistics
GROUPS = [
    range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), (0x20,), (0x0A,), b".", b",", b"!?", b"|", b"#$%&*", b"\"'`",
    b"()[]{}", b"<>/=\\", b"-_+~^@", b";:", [*range(0x00, 0x09), *range(0x0B, 0x20), 0x7F],
]
_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _number, _group in enumerate(GROUPS):
    _GROUP_OF[list(_group)] = _number


def statistics(offsets: np.ndarray, data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros."""
    joined, begins = joined_bytes(offsets, data, start, stop)
    heads, tails, hashes, firsts = words(lowered(joined), begins, SPACE)
    group = _GROUP_OF[joined]
    rows = []
    for row in range(stop - start):
        at, end = int(begins[row]), int(begins[row + 1]) - 1
        first, last = int(firsts[row]), int(firsts[row + 1])
        count, size = last - first, end - at
        shares = np.bincount(group[at:end], minlength=len(GROUPS) + 1) / max(size, 1)
        if not count:
            rows.append([*shares, np.log1p(size), *[0.0] * 14])
            continue
        own = hashes[first:last]
        lengths = tails[first:last] - heads[first:last]
        _, often = np.unique(own, return_counts=True)
        share = often / count
        initial, final = joined[heads[first:last]], joined[tails[first:last] - 1]
        lines = np.diff(np.flatnonzero(np.concatenate([[True], joined[at:end] == 0x0A, [True]])))
        line_of = np.searchsorted(np.flatnonzero(joined[at:end] == 0x0A) + at, heads[first:last])
        sums = np.bincount(line_of, own.astype(np.float64) / 2**64)
        held = sums[sums > 0]
        rows.append([
            *shares, np.log1p(size), np.log1p(count), lengths.mean(), lengths.std(), len(often) / count, np.log(len(often)) / np.log(count + 1),
            share.max(), np.sort(share)[-5:].sum(), -(share * np.log(share)).sum() / np.log(count + 1), (own[1:] == own[:-1]).mean() if count > 1 else 0.0,
            ((initial >= 0x41) & (initial <= 0x5A)).mean(), (_GROUP_OF[final] == 10).mean(), (_GROUP_OF[initial] >= 4).mean(),
            np.log1p(lines.mean()), 1 - len(np.unique(held)) / max(len(held), 1),
        ])
    return np.nan_to_num(np.array(rows))


def document_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every row's text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            for start, stop in slices(offsets):
                x = statistics(offsets, data, start, stop)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(list(x), pa.list_(pa.float64()))], ["key", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(measure, f"key {kind}, x array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Kernel:
    """Random Fourier features of standardized numbers, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.weights = rng.standard_normal((len(mean), FEATURES)) * WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.cos(scaled @ self.weights + self.phase) * np.sqrt(2 / FEATURES)
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def scores(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The features' products with the weights, added up in one order for every row: equal rows get equal scores in any batch."""
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        turns = np.broadcast_to(self.phase, (len(x), FEATURES)).copy()
        for column, row in zip(scaled.T, self.weights, strict=True):
            turns += column[:, None] * row
        waves = np.ascontiguousarray((np.cos(turns) * np.sqrt(2 / FEATURES)).T)
        total = np.full(len(x), weights[-1])
        for wave, weight in zip(waves, weights, strict=False):
            total += wave * weight
        return total


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over (x, y): each task sends one row per matrix row, and these are added up in two levels.

    Tasks are at most four waves of the cluster, so what is sent doesn't grow with the rows.
    """
    size = FEATURES + 1
    rows = rows.coalesce(max(PARTS, 4 * rows.sparkSession.sparkContext.defaultParallelism))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                features = kernel(_rows(part.column("x")))
                sums[:, :size] += features.T @ features
                sums[:, size] += features.T @ part.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["i", "sums"])

    def total(table: pa.Table) -> pa.Table:
        sums = np.sort(_rows(table["sums"].combine_chunks()), 0).sum(0)
        return pa.table({"i": table["i"][:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

    total.__annotations__ = {"table": pa.Table, "return": pa.Table}
    parts = rows.select("x", "y").mapInArrow(add, "i int, sums array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = parts.groupBy("i", "part").applyInArrow(total, "i int, sums array<double>")
    found = sorted(parts.groupBy("i").applyInArrow(total, "i int, sums array<double>").collect())
    both = np.array([row.sums for row in found]) if found else np.zeros((size, size + 1))
    return both[:, :size], both[:, size]


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points ascending in score: scores and values of the blocks, for interpolation."""
    blocks: list[list[float]] = []
    for at, value, heavy in zip(score.tolist(), mean.tolist(), weight.tolist(), strict=True):
        blocks.append([value, heavy, at * heavy])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, heavy, place = blocks.pop()
            before = blocks[-1]
            blocks[-1] = [(before[0] * before[1] + value * heavy) / (before[1] + heavy), before[1] + heavy, before[2] + place]
    return np.array([place / heavy for _, heavy, place in blocks]), np.array([value for value, _, _ in blocks])


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, parts: int = 5, part: int = 0, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(key, held_out, score, predicted) of every row; the score is the calibrated probability of label 1.

    Learns from labelled rows whose key isn't held out; several labels of a key are averaged, null labels and keys are left out.
    Without such rows every score is 0.5. Null texts count as empty. Equal texts get the same score, wherever they stand; where a labelled key
    has several texts, all of them are learned from.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.put(document_statistics(docs, key=key, text=text), "statistics")
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y"))
    marks = marks.filter(~held_out_of(F.col("key"), parts, part))
    learned = scratch.put(measured.join(marks, "key").select("x", "y"), "learned")
    size = len(statistics(np.array([0, 0]), np.zeros(0, np.uint8), 0, 1)[0])
    spread = [F.stddev_pop(F.col("x")[i]) for i in range(size)]
    moments = measured.agg(*[F.avg(F.col("x")[i]) for i in range(size)], *spread).first()
    numbers = np.array([value or 0.0 for value in moments])
    kernel = Kernel(numbers[:size], numbers[size:])
    matrix, vector = normal_equations(learned, kernel)
    rows = matrix[-1, -1]
    curve = None
    if rows:
        weights = np.linalg.solve(matrix + RIDGE * rows * np.diag([*[1 / FEATURES] * FEATURES, 1e-9]), vector)
        model = docs.sparkSession.sparkContext.broadcast((kernel, weights))

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, linear = model.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4000):
                    piece = batch.slice(at, 4000)
                    yield pa.RecordBatch.from_arrays([piece.column("y"), pa.array(own.scores(_rows(piece.column("x")), linear))], ["y", "raw"])

        binned = learned.mapInArrow(raw, "y double, raw double").groupBy(F.floor((F.col("raw") + 0.5) * (BINS / 2)).alias("bin"))
        points = binned.agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("raw").collect()
        curve = isotonic(*(np.array([row[name] for row in points], np.float64) for name in ("raw", "y", "n")))
    shared = docs.sparkSession.sparkContext.broadcast((kernel, weights, curve) if rows else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                piece = batch.slice(at, 4000)
                values = np.full(piece.num_rows, 0.5)
                if shared.value:
                    own, linear, (places, heights) = shared.value
                    values = np.round(np.clip(np.interp(own.scores(_rows(piece.column("x")), linear), places, heights), 0, 1), DIGITS)
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(values)], ["key", "score"])

    kind = measured.schema["key"].dataType.simpleString()
    scored = measured.mapInArrow(score, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), held_out_of(F.col("key"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
