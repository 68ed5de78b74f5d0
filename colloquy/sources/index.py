"""An index of an archive in Parquet, kept up to date by file.

Each refresh writes the rows of new and changed files as a generation of its own,
then a listing that names the generation of each file.  Readers take the rows of the
newest finished listing, so a refresh that breaks off changes nothing for them,
and what a file held before simply is not named any more.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .archive import FILES, RESERVED, file_changes, files_of, folder_of, parsed, read_lines
from .lookup import line_offsets

#: Fixed value: the index folder of an archive.
FOLDER = "archive-index"
#: Changed files that one job reads.
PATHS = 10_000
LISTING = "output_path string, size_bytes bigint, modified timestamp, generation bigint"


@dataclass(frozen=True)
class IndexStatus:
    """State (missing, rebuild_required, stale, ready) and counts of files and rows."""

    state: str
    file_count: int
    indexed_file_count: int
    conversation_count: int
    added_file_count: int
    updated_file_count: int
    removed_file_count: int

    @property
    def ready(self) -> bool:
        return self.state == "ready"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _generations(spark: SparkSession, root: str) -> list[int] | None:
    """Numbers of the finished listings; None without an index."""
    path, fs = _path(spark, f"{root}/{FOLDER}")
    if not fs.exists(path):
        return None
    found = fs.globStatus(_path(spark, f"{root}/{FOLDER}/files/generation=*/_SUCCESS")[0]) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def _listing(spark: SparkSession, root: str, generations: list[int] | None) -> DataFrame:
    """(output_path, size_bytes, modified, generation) of the newest finished listing; empty without one."""
    if not generations:
        return spark.createDataFrame([], LISTING)
    return spark.read.schema(LISTING).parquet(f"{root}/{FOLDER}/files/generation={generations[-1]}")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """All indexed rows, superseded ones too, with the line each was read from."""
    generations = _generations(spark, root)
    if not generations:
        raise FileNotFoundError(f"{root} has no finished index")
    named = _listing(spark, root, generations).select("output_path", F.col("generation").alias("written"))
    return spark.read.parquet(f"{root}/{FOLDER}/conversations").join(named, ["output_path", "written"], "left_semi").drop("written", "generation", "batch")


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """(output_path, size_bytes, modified, generation) of the indexed files."""
    generations = _generations(spark, root)
    if not generations:
        raise FileNotFoundError(f"{root} has no finished index")
    return _listing(spark, root, generations)


def read_offsets(spark: SparkSession, root: str) -> DataFrame:
    """(output_path, row_number, byte_offset) of every Nth line of the indexed files (see `lookup`)."""
    named = read_listing(spark, root).select("output_path", F.col("generation").alias("written"))
    return spark.read.parquet(f"{root}/{FOLDER}/offsets").join(named, ["output_path", "written"], "left_semi").select("output_path", "row_number", "byte_offset")


def index_changes(spark: SparkSession, root: str) -> DataFrame:
    """Files added, updated or removed since the index was written."""
    return file_changes(_listing(spark, root, _generations(spark, root)), files_of(spark, root))


def index_status(spark: SparkSession, root: str) -> IndexStatus:
    """The state of the index against the files as they are; an index folder without a finished listing has to be rebuilt."""
    generations = _generations(spark, root)
    n = {r.change: r["count"] for r in index_changes(spark, root).groupBy("change").count().collect()}
    state = "missing" if generations is None else "rebuild_required" if not generations else "stale" if n else "ready"
    known = _listing(spark, root, generations)
    rows = read_index(spark, root).count() if generations else 0
    return IndexStatus(state, files_of(spark, root).count(), known.count(), rows, n.get("added", 0), n.get("updated", 0), n.get("removed", 0))


def _path_batches(changes: DataFrame) -> Iterator[list[str]]:
    """Paths of the files that are new or changed, PATHS at a time; they come to the driver by partition."""
    batch: list[str] = []
    for r in changes.where("change <> 'removed'").select("output_path").toLocalIterator():
        batch.append(r.output_path)
        if len(batch) == PATHS:
            yield batch
            batch = []
    if batch:
        yield batch


def refresh_index(spark: SparkSession, root: str, force: bool = False, strict: bool = True) -> IndexStatus:
    """Index what has changed, or all files with `force`; returns the status before.

    Where all files are read, they are named by their pattern; else changed files are read
    in batches of PATHS, named one by one.  A malformed row is an error in strict mode.
    """
    before = index_status(spark, root)
    generations = _generations(spark, root)
    whole = force or not generations
    if before.ready and not whole:
        return before
    generation = (generations[-1] if generations else 0) + 1
    files = checkpointed(files_of(spark, root))  # one listing for all steps: a file that comes later is new to the next refresh
    old = _listing(spark, root, None if whole else generations)
    changes = checkpointed(file_changes(old, files))
    if not changes.where("change <> 'removed'").isEmpty():
        written = F.lit(generation).cast("bigint")
        for kind in ("conversations", "offsets"):  # what a refresh that broke off has left
            path, fs = _path(spark, f"{root}/{FOLDER}/{kind}/generation={generation}")
            fs.delete(path, True)
        for i, some in enumerate([None] if whole else _path_batches(changes)):
            rows = parsed(read_lines(spark, root, paths=some), strict).withColumn("written", written)
            rows.write.mode("overwrite").parquet(f"{root}/{FOLDER}/conversations/generation={generation}/batch={i}")
            own = [urllib.parse.unquote(p) for p in some] if some else f"{root}/*/{FILES}"
            offsets = line_offsets(spark, own).where(~folder_of(F.col("output_path")).isin(*RESERVED))
            offsets.withColumn("written", written).write.mode("overwrite").parquet(f"{root}/{FOLDER}/offsets/generation={generation}/batch={i}")
    named = files.join(old.join(changes, "output_path", "left_anti").select("output_path", "generation"), "output_path", "left")
    listing = named.select("output_path", F.col("size_bytes").cast("bigint").alias("size_bytes"), "modified", F.coalesce("generation", F.lit(generation)).cast("bigint").alias("generation"))
    listing.write.mode("overwrite").parquet(f"{root}/{FOLDER}/files/generation={generation}")
    return before


def ensure_index(spark: SparkSession, root: str) -> IndexStatus:
    """Bring the index up to date if it is not; returns the status after."""
    status = index_status(spark, root)
    if not status.ready:
        refresh_index(spark, root, force=status.state == "rebuild_required")
        status = index_status(spark, root)
    return status
