"""What the operators of this package share: a folder for intermediate tables, text bytes, word hashes, components.

Texts travel to Python as Arrow batches and are handled there as byte arrays, a bounded number of bytes at a time,
so that memory follows ``SLICE_BYTES`` and the longest single text, not the number of rows in a batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: text bytes that a task turns into arrays at once
SLICE_BYTES = 1_000_000
#: bytes up to which the tables of powers stay with the worker
KEPT_BYTES = 8_000_000


class Scratch:
    """Intermediate tables of one run, as Parquet in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session that has none (tests) gets a temporary one.
    A lost executor costs nothing that was written. ``drop`` removes tables that later steps don't read any more; what is
    left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if shared is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(shared)
        self.spark, self.folder = spark, f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        path, system = self._at(self.folder)
        system.mkdirs(path)  # what isn't there yet can't be marked
        system.deleteOnExit(path)

    def _at(self, name: str):
        """Path and file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, content: bytes, name: str) -> str:
        """A file of its own; its path, whose last part no other file has."""
        path, system = self._at(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        file = system.create(path)
        file.write(bytearray(content))
        file.close()
        return path.toString()

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._at(f"{self.folder}/{name}")
            system.delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column in ``taken`` has it."""
    names = {each.lower() for each in taken}
    while name.lower() in names:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column; nulls are empty."""
    flat = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    flat = flat.cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    offsets = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer text is a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def joined_bytes(offsets: np.ndarray, data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of some rows in one array, each followed by a line feed; where each row begins (and the end)."""
    view = memoryview(data)
    parts = [view[offsets[row] : offsets[row + 1]] for row in range(start, stop)]
    begins = np.zeros(stop - start + 1, np.int64)
    np.cumsum(np.diff(offsets[start : stop + 1]) + 1, out=begins[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), begins


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8, copy=False)


#: byte classes of the two kinds of words: what parts words by white space, what parts words of letters and digits
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: odd multiplier of the polynomial hash of words, and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, by doubling."""
    out = np.ones(max(count, 1), np.uint64)
    done, step = 1, base
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


_POWERS: dict[str, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fixed constants of the splitmix64 finalizer)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand.

    Prefix sums of (byte + 1) * BASE**place give the polynomial of every range at once.
    """
    if len(_POWERS.get("up", ())) < len(data) + 1:
        _POWERS["up"] = powers(BASE, max(len(data) + 1, SLICE_BYTES + SLICE_BYTES // 4))
        _POWERS["down"] = powers(INVERSE, len(_POWERS["up"]))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _POWERS["down"][starts])
    if len(data) > KEPT_BYTES:  # one very long text: don't keep its tables for the rest of the task
        _POWERS.clear()
    return hashes


def words(data: np.ndarray, begins: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of the rows in ``data``, and the index of each row's first word (and the end)."""
    inside = ~parting[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, range_hashes(data, starts, ends), np.searchsorted(starts, begins)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of every distinct key, ascending by key, and for each key the number of its distinct one."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    inverse = np.empty(len(held), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers from 0 on, ascending, and each value's place among them; dense numbers need no sort."""
    if not len(values) or values.max() > 4 * len(values) + 50_000_000:
        return np.unique(values, return_inverse=True)
    there = np.zeros(int(values.max()) + 1, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[values].astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of ranges laid one after the other, and where each range ends there."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths), ends


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): component is the smallest node it reaches.

    Minimum labels with pointer jumping; the number of rounds grows with the logarithm of the longest path. Each round
    takes the smallest label among the neighbours (partly aggregated before the shuffle, so a hub is no hot task), lets
    the old label's node follow too, and is written to the shared folder.
    """
    spark = scratch.spark
    pairs = scratch.put(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-pairs")
    labels = scratch.put(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}-0")
    last, turn = f"{name}-0", 0
    while True:
        turn += 1
        old = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = pairs.join(old, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        # a root that has a smaller neighbouring label takes its whole tree along
        follow = step.filter("now < was").groupBy(F.col("was").alias("root")).agg(F.min("now").alias("lead"))
        step = step.join(follow, step.now == follow.root, "left").select("node", "was", F.coalesce("lead", "now").alias("now"))
        # and the label's own label is closer to the smallest
        own = step.select(F.col("node").alias("root"), F.col("now").alias("lead"))
        step = step.join(own, step.now == own.root, "left").select("node", "was", F.least("now", "lead").alias("now"))
        step = scratch.put(step, f"{name}-{turn}")
        changed = step.filter("now <> was").limit(1).count()
        scratch.drop(last)
        last, labels = f"{name}-{turn}", step.select("node", F.col("now").alias("component"))
        if not changed:
            scratch.drop(f"{name}-pairs")
            return labels
