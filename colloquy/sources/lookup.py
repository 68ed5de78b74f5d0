"""Reading one row of an archive by its file and line number, without reading the file.

The index holds where every Nth line of a file begins.  A lookup finds the last such line
up to the one that is asked for, and reads from there to its end: at most N lines, however
large the file.  Lines end with a line feed; a carriage return before it is not part of a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.checks import file_path

#: A line whose beginning is kept is followed by EVERY - 1 others; CHUNK bytes are read at once.
EVERY, CHUNK = 256, 1 << 14


class StaleIndex(LookupError):
    """The file is another than the one that was indexed."""


@dataclass(frozen=True)
class Found:
    """A line, and what reading it took."""

    line: str
    offset: int
    bytes_read: int


def line_offsets(spark: SparkSession, paths: list[str] | str, every: int = EVERY) -> DataFrame:
    """(output_path, row_number, byte_offset): where lines 1, 1 + every, ... of each file begin.

    Sizes are summed by split and the splits before, so no task sees more than a split.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("output_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"), (F.octet_length("value") + 1).cast("bigint").alias("_size")
    )
    blocks = lines.groupBy("output_path", "_block").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    before = W.partitionBy("output_path").orderBy("_block")
    starts = blocks.select("output_path", "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_rows"), (F.sum("_bytes").over(before) - F.col("_bytes")).alias("_start"))
    inside = W.partitionBy("output_path", "_block").orderBy("_order")
    placed = lines.withColumns({"_nth": F.row_number().over(inside), "_end": F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))}).join(starts, ["output_path", "_block"])
    found = placed.select("output_path", (F.col("_rows") + F.col("_nth")).cast("bigint").alias("row_number"), (F.col("_start") + F.col("_end") - F.col("_size")).alias("byte_offset"))
    return found.where((F.col("row_number") - 1) % every == 0)


def read_line(spark: SparkSession, path: str, offset: int, skip: int) -> Found:
    """The line that is `skip` lines after the one that begins at the offset; a file that ends before is an error."""
    file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path)) if ":" in path.split("/")[0] else spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    held, read, at = b"", 0, offset
    try:
        stream.seek(offset)
        while True:
            chunk = bytes(stream.readNBytes(CHUNK))
            read += len(chunk)
            held += chunk
            while skip and b"\n" in held:
                gone, _, held = held.partition(b"\n")
                at += len(gone) + 1
                skip -= 1
            if not skip and b"\n" in held:
                return Found(held.partition(b"\n")[0].removesuffix(b"\r").decode(errors="replace"), at, read)
            if not chunk:
                if skip or not held:
                    raise LookupError(f"{path} has no such line")
                return Found(held.removesuffix(b"\r").decode(errors="replace"), at, read)
    finally:
        stream.close()


def lookup(spark: SparkSession, root: str, path: str, row_number: int) -> Found:
    """The line of an indexed file, which is named by its plain path or as in output_path; rows count from 1.

    A file that has changed since it was indexed, or is not indexed, is an error: its offsets mean nothing.
    """
    from .index import read_listing, read_offsets

    if row_number < 1:
        raise LookupError("rows count from 1")
    same = (F.col("output_path") == path) | (file_path(F.col("output_path")) == path)
    known = read_listing(spark, root).where(same).select("output_path", "size_bytes", F.unix_millis("modified").alias("modified")).first()
    if known is None:
        raise LookupError(f"{path} is not indexed")
    path = known.output_path
    file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(file):
        raise StaleIndex(f"{path} is gone")
    status = fs.getFileStatus(file)
    if (status.getLen(), status.getModificationTime()) != (known.size_bytes, known.modified):
        raise StaleIndex(f"{path} has changed since it was indexed")
    near = read_offsets(spark, root).where((F.col("output_path") == path) & (F.col("row_number") <= row_number)).agg(F.max_by(F.struct("row_number", "byte_offset"), "row_number").alias("o")).first().o
    if near is None:
        raise LookupError(f"{path} has no rows")
    return read_line(spark, path, near.byte_offset, row_number - near.row_number)
