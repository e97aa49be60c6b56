"""Deletes blocks of lines that a document shares with an earlier one, by pairwise alignment.

Documents that overlap are found through the lines they share, told apart by two hashes of the line. A *rare* line, held by at
most ``RARE`` documents, pairs each holder with every earlier one. A line that more documents hold pairs each with
the first holder alone: pairs then grow with the occurrences of the line, not with their square. Only lines of at least
``MIN_WORDS`` words name pairs and, with ``short_lines``, likewise windows of consecutive shorter lines that have so many words
together, from every such line on and up to every such line. Copies of a whole text are one document here, aligned once.

Each pair is aligned with patience diff: common heads and tails, then lines that occur once on either side, in the longest
order that both sides share, and again between these anchors. Aligned lines that follow one another on both sides are a
block; blocks of at least ``MIN_WORDS`` words are deleted from the later document. What alignment leaves, since it repeats or
stands in another order, is looked up by windows of lines: every run of at least ``MIN_WORDS`` words that the earlier document
holds anywhere goes, as often as it occurs. So no line of so many words stays that an earlier document holds. Since the earliest holder of a line has no
earlier partner that holds it, no line is lost from the corpus.

Pairs carry line hashes, not texts. Texts are read twice: to hash the lines and to leave out the deleted ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import BASE, INVERSE, Scratch, fresh, mixed, powers

#: holders up to which a line pairs all of them
RARE = 4
#: words of a line or window of lines that names pairs, and of a block that is deleted
MIN_WORDS = 5


def patience(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Places of aligned equal items, ascending on both sides."""
    aligned: list[tuple[int, int]] = []
    open_ = [(0, len(left), 0, len(right))]
    while open_:
        top, end, first, last = open_.pop()
        while top < end and first < last and left[top] == right[first]:
            aligned.append((top, first))
            top, first = top + 1, first + 1
        while top < end and first < last and left[end - 1] == right[last - 1]:
            end, last = end - 1, last - 1
            aligned.append((end, last))
        if top == end or first == last:
            continue
        here, there = Counter(left[top:end]), Counter(right[first:last])
        place = {item: at for at, item in enumerate(right[first:last], first) if there[item] == 1}
        both = [(at, place[item]) for at, item in enumerate(left[top:end], top) if here[item] == 1 and item in place]
        anchors = _longest_rising(both)
        for (a, b), (c, d) in zip([(top, first), *anchors], [*anchors, (end, last)], strict=True):
            # the part from one anchor up to the next; without anchors nothing more is aligned
            if anchors and a < c and b < d:
                open_.append((a, c, b, d))
    return sorted(aligned)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first place) that rises in the second."""
    ends: list[int] = []
    last_of: list[int] = []
    before: list[int] = []
    for at, (_, value) in enumerate(pairs):
        place = bisect_left(ends, value)
        before.append(last_of[place - 1] if place else -1)
        if place == len(ends):
            ends.append(value)
            last_of.append(at)
        else:
            ends[place], last_of[place] = value, at
    chain, at = [], last_of[-1] if last_of else -1
    while at >= 0:
        chain.append(pairs[at])
        at = before[at]
    return chain[::-1]


def windows(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest windows of at least so many words: one from every line on, one up to every line.

    Together those that lie in a run of so many words cover it, and equal runs have equal windows.
    """
    count = len(hashes)
    total = np.zeros(count + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    from_ = np.arange(count)
    to = np.searchsorted(total, total[:-1] + least, "left")
    up_to = np.arange(1, count + 1)
    since = np.searchsorted(total, total[1:] - least, "right") - 1
    starts = np.concatenate([from_[to <= count], since[since >= 0]])
    ends = np.concatenate([to[to <= count], up_to[since >= 0]])
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(mixed(hashes.view(np.uint64) ^ np.uint64(BASE)) * powers(BASE, count)[:count], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * powers(INVERSE, count)[starts])


def shared_windows(left: list[int], right: list[int], sizes: list[int], least: int) -> np.ndarray:
    """Places of ``right`` in runs of at least so many words that ``left`` holds anywhere."""
    words = dict(zip(right, sizes, strict=True))
    number = {item: at for at, item in enumerate(words)}
    # a line that ``right`` doesn't hold matches in no window
    there = np.array([number.get(item, -1) for item in left], np.int64)
    there = windows(there, np.array([words.get(item, least) for item in left], np.int64), least)[2]
    starts, ends, here = windows(np.array([number[item] for item in right], np.int64), np.array(sizes, np.int64), least)
    both = np.isin(here, there)
    depth = np.zeros(len(right) + 1, np.int64)
    np.add.at(depth, starts[both], 1)
    np.subtract.at(depth, ends[both], 1)
    return np.flatnonzero(np.cumsum(depth[:-1]) > 0)


def shared_blocks(left: list[int], right: list[int], sizes: list[int], least: int) -> list[int]:
    """Places of ``right`` in blocks of at least so many words that ``left`` holds; ``sizes`` are the words of its lines.

    Aligned blocks first; what they leave of ``right`` is looked up by windows.
    """
    found: list[int] = []
    block: list[int] = []
    previous = (-2, -2)
    for pair in [*patience(left, right), (-9, -9)]:
        if pair != (previous[0] + 1, previous[1] + 1):
            if sum(sizes[at] for at in block) >= least:
                found += block
            block = []
        block.append(pair[1])
        previous = pair
    if len(found) < len(right):
        found = sorted({*found, *shared_windows(left, right, sizes, least).tolist()})
    return found


def short_windows(rows: DataFrame, least: int) -> DataFrame:
    """(node, h, g) of the windows of at least so many words in lines that have fewer each."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (h, g, n) in enumerate(zip(*(batch.column(part) for part in ("h", "g", "n")), strict=True)):
                h, g, n = (value.values.to_numpy(zero_copy_only=False).astype(np.int64) for value in (h, g, n))
                starts, ends, one = windows(h, n, least)
                two = windows(g, n, least)[2]
                long = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n >= least, out=long[1:])
                short = long[ends] == long[starts]
                node = pa.array(np.full(int(short.sum()), batch.column("node")[at].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([node, pa.array(one[short].view(np.int64)), pa.array(two[short].view(np.int64))], ["node", "h", "g"])

    some = F.exists("lines", lambda each: (each["n"] > 0) & (each["n"] < least))
    return rows.filter(some).select("node", "lines.h", "lines.g", "lines.n").mapInArrow(name, "node long, h long, g long")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(text: Column) -> Column:
    """(h, g, n) of each line: two hashes and the number of its words."""
    words = lambda line: F.size(F.filter(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " +"), lambda word: word != ""))
    return F.transform(lines_of(text), lambda line: F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"), words(line).alias("n")))


def deletions(scratch: Scratch, rows: DataFrame, *, rare: int = RARE, min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """(node, deleted): for documents that lose lines, whether each line up to the last such goes.

    ``rows`` has (node, lines); nodes are ordered numbers.
    """
    line = rows.select("node", F.explode("lines").alias("line")).filter(F.col("line.n") >= min_words)
    line = line.select("node", "line.h", F.col("line.g").cast("long").alias("g"))
    line = line.union(short_windows(rows, min_words)) if short_lines else line
    line = scratch.put(line.distinct(), "occurrences")
    shared = line.groupBy("h", "g").agg(F.count("*").alias("holders"), F.min("node").alias("first")).filter("holders > 1")
    # written, so that the join's partitions are not those of the sums and a line that very many hold can be split
    shared = scratch.put(shared, "shared")
    held = scratch.put(line.join(shared, ["h", "g"]), "held")
    to_first = held.filter((F.col("holders") > rare) & (F.col("node") > F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    few = held.filter(F.col("holders") <= rare)
    every = few.select("h", "g", F.col("node").alias("a")).join(few.select("h", "g", F.col("node").alias("b")), ["h", "g"]).filter("a < b")
    pairs = to_first.union(every.select("a", "b")).distinct()

    hashed = rows.select("node", F.transform("lines", lambda each: each["h"]).alias("hashes"), F.transform("lines", lambda each: each["n"]).alias("sizes"))
    met = pairs.join(hashed.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    met = met.join(hashed.select(F.col("node").alias("b"), F.col("hashes").alias("right"), "sizes"), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = [], []
            columns = [batch.column(name) for name in ("b", "left", "right", "sizes")]
            for node, left, right, sizes in zip(*columns, strict=True):
                found = shared_blocks(left.as_py(), right.as_py(), sizes.as_py(), min_words)
                if found:
                    nodes.append(node.as_py())
                    places.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["node", "places"])

    blocks = met.select("b", "left", "right", "sizes").mapInArrow(align, "node long, places array<int>")
    places = blocks.select("node", F.explode("places").alias("place")).distinct().groupBy("node").agg(F.collect_list("place").alias("places"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for row in batch.column("places"):
                at = row.values.to_numpy()
                mark = np.zeros(int(at.max()) + 1, bool)
                mark[at] = True
                marks.append(mark)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.list_(pa.bool_()))], ["node", "deleted"])

    return places.mapInArrow(flags, "node long, deleted array<boolean>")


def line_dedup(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", rare: int = RARE, min_words: int = MIN_WORDS, short_lines: bool = False,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with blocks deleted from ``text``, and the columns ``n_lines`` and ``n_removed``, or as ``counts`` names them.

    Documents follow one another by key, those of one key by the digest of their text; a later copy of a whole text loses
    all lines. Rows equal in key and text get the same result. Rows with a null key or text are left as they are and not
    compared; an empty text is one empty line. ``short_lines``: documents that share nothing but passages in lines of fewer than
    ``min_words`` words are compared, too; the query and the pipeline ask for it. Columns of the input named like the two new ones are replaced; others stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(key).alias("key"), F.md5(text).alias("digest"), line_hashes(F.col(text)).alias("lines"))
    rows = scratch.put(rows.filter("key is not null and digest is not null"), "rows")
    classes = rows.groupBy("digest").agg(F.min("key").alias("key"), F.first("lines").alias("lines"))
    classes = scratch.put(classes.orderBy("key", "digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    gone = classes.select("node", "digest", "key").join(deletions(scratch, classes.select("node", "lines"), rare=rare, min_words=min_words, short_lines=short_lines), "node")
    gone = scratch.put(gone.select("digest", F.col("key").alias("first"), "deleted"), "gone")
    # what to do with each key and text: later copies lose all, first holders what was aligned
    # distinct before the join: nothing after it asks for its partitions, so a text with very many copies can be split
    late = rows.select("key", "digest").distinct().join(classes.select("digest", F.col("key").alias("first")), "digest").filter("key > first")
    late = late.select("key", "digest", F.lit(True).alias("copy"), F.lit(None).cast("array<boolean>").alias("deleted"))
    action = gone.select(F.col("first").alias("key"), "digest", F.lit(False).alias("copy"), "deleted").union(late)
    texts = docs.drop(*counts)
    own_key, own_digest, copy, deleted = (fresh(name, texts.columns) for name in ("_key", "_digest", "_copy", "_deleted"))
    action = scratch.put(action.toDF(own_key, own_digest, copy, deleted), "action")
    scratch.drop("occurrences", "shared", "held", "gone", "rows", "classes")

    met = texts.join(action, (texts[key] == F.col(own_key)) & (F.md5(texts[text]) == F.col(own_digest)), "left")
    lines = lines_of(F.col(text))
    left = F.zip_with(lines, deleted, lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line))  # joining skips nulls
    count = F.size(F.filter(deleted, lambda gone: gone))
    removed = F.when(F.col(copy), F.size(lines)).when(F.col(deleted).isNotNull(), count).otherwise(0)
    kept = F.when(F.col(copy), F.lit("")).when(F.col(deleted).isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    return met.select(
        *[kept.alias(text) if name == text else texts[name] for name in texts.columns],
        n_lines.cast("long").alias(counts[0]), removed.cast("long").alias(counts[1]),
    )
