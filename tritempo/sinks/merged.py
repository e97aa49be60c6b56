"""One file of rows in order, written by many tasks.

Rows are sorted over all partitions and every task writes its own part file, without a header. The file system then puts
the parts together in their order behind one header. Where it can concatenate files, as HDFS does, that moves no data and takes
no longer for large parts. Elsewhere the driver's process copies the parts one after the other in blocks of a fixed size; nothing
passes through Python or a task, but the copy takes the time of the bytes, so keep part files there if
what reads them can take several.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

COPIED_AT_ONCE = 4 << 20


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def merge_files(spark: SparkSession, folder: str, target: str, *, header: str | None = None, suffix: str = "") -> int:
    """Puts the part files of a folder, in the order of their names, into one new file; how many there were.

    The target appears under its name when it is whole. The folder is removed.
    """
    where, system = _file_system(spark, folder)
    parts = sorted((each.getPath() for each in system.listStatus(where) if each.getPath().getName().startswith("part-")), key=lambda path: path.getName())
    parts = [part for part in parts if part.getName().endswith(suffix)]
    final, to = _file_system(spark, target)
    if to.exists(final):
        raise FileExistsError(target)
    draft = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}")
    filled = [part for part in parts if system.getFileStatus(part).getLen()]
    try:
        if system.getUri().equals(to.getUri()) and concatenates(to, final):
            _concatenate(spark, to, draft, filled, header)
        else:
            _copy(spark, system, to, draft, filled, header)
        if not to.rename(draft, final):
            raise FileExistsError(target)
    except BaseException:
        to.delete(draft, False)
        raise
    system.delete(where, True)
    return len(parts)


def concatenates(system, path) -> bool:
    """Whether the file system puts files together by itself (a fixed name of Hadoop's)."""
    return system.hasPathCapability(path, "fs.capability.paths.concat")


def _begin(system, draft, header: str | None):
    stream = system.create(draft)
    if header is not None:
        stream.write(bytearray((header + "\n").encode()))
    return stream


def _concatenate(spark: SparkSession, system, draft, parts: list, header: str | None) -> None:
    if header is None and parts:  # a file that others are added to may not be empty
        system.rename(parts[0], draft)
        parts = parts[1:]
    else:
        _begin(system, draft, header).close()
    if parts:
        array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
        for place, part in enumerate(parts):
            array[place] = part
        system.concat(draft, array)


def _copy(spark: SparkSession, system, to, draft, parts: list, header: str | None) -> None:
    stream = _begin(to, draft, header)
    try:
        for part in parts:
            source = system.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, COPIED_AT_ONCE, False)
            finally:
                source.close()
    finally:
        stream.close()


def write_lines_in_order(lines: DataFrame, target: str, order: Sequence[str | Column], *, value: str = "value", header: str | None = None) -> int:
    """Writes the text column of rows, sorted, to one file; how many parts it was put together from."""
    spark = lines.sparkSession
    folder = f"{target.rstrip('/')}.parts-{uuid.uuid4().hex}"
    lines.orderBy(*order).select(value).write.text(folder)
    return merge_files(spark, folder, target, header=header, suffix=".txt")
