"""Replacing files of an archive as one step: a change is prepared aside, committed by one rename, and then carried out.

Before the commit record is in place the archive is as it was; from then on the change
counts, and `recover` carries out what a break has left.  Files go out of the archive before
others come in, so a name may be used again; every step may be repeated.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of changes in an archive begin so; readers of an archive do not look into them.
PREFIX = ".swap-"


class Store:
    """The file system of a folder, as far as a change needs it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.path = spark, root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"cannot move {old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, payload: object) -> None:
        """Write JSON, complete or not at all; a file of the name is replaced."""
        part = f"{name.rpartition('/')[0]}/.part-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part))
        out.write(bytearray((json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
        out.close()
        self.delete(name)
        self.move(part, name)

    def read(self, name: str) -> object:
        """JSON of a small file."""
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()


def numbered_name(name: str, place: int, of: int) -> str:
    """The name of one of several files that stand for one: a number is put before its ending."""
    stem, dot, ending = name.rpartition(".")
    return name if of == 1 else f"{stem}-{place:05d}{dot}{ending}"


def write_parts(spark: SparkSession, rows: DataFrame, order: list, folder: str) -> dict[str, list[str]]:
    """Write rows (source_dir, file, line, ...) in order into folder/source/file; returns the names of each source.

    Rows are ordered by ranges, so a file of any size is written by many tasks; it then is several files, numbered in order.
    """
    store, staging = Store(spark, folder), f"{folder}-parts"
    keys = [F.col("source_dir"), F.col("file"), *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("source_dir", "file", F.col("line").alias("value")).write.partitionBy("source_dir", "file").text(staging)
    written: dict[str, list[str]] = {}
    for source in [n for n in store.names(staging) if n.startswith("source_dir=")]:
        name = urllib.parse.unquote(source.removeprefix("source_dir="))
        for file in [n for n in store.names(f"{staging}/{source}") if n.startswith("file=")]:
            parts = [p for p in store.names(f"{staging}/{source}/{file}") if p.startswith("part-")]  # numbers of parts are those of the ranges
            for i, part in enumerate(parts):
                new = numbered_name(urllib.parse.unquote(file.removeprefix("file=")), i, len(parts))
                store.move(f"{staging}/{source}/{file}/{part}", f"{folder}/{name}/{new}")
                written.setdefault(name, []).append(new)
    store.delete(staging)
    return written


def begin(root: str) -> str:
    """The folder of a new change; what goes in is prepared under its folder `new`."""
    return f"{root.rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"


def commit(spark: SparkSession, change: str, old: Mapping[str, list[str]], new: Mapping[str, list[str]], backup: str | None = None, after: Callable[[str], None] = lambda step: None) -> None:
    """Replace the files `old` of each source by the files `new`, which lie under change/new.

    With `backup`, old files are kept there.  `after` is told of each step that is done; tests break off there.
    """
    store = Store(spark, change)
    store.fs.mkdirs(store.path(change))
    after("prepared")
    store.write(f"{change}/commit.json", {"old": {s: sorted(f) for s, f in old.items()}, "new": {s: sorted(f) for s, f in new.items()}, "backup": backup})
    after("committed")
    _carry_out(store, change, after)


def _carry_out(store: Store, change: str, after: Callable[[str], None]) -> None:
    root, record = change.rpartition("/")[0], store.read(f"{change}/commit.json")
    away = record["backup"] or f"{change}/old"
    for source, names in sorted(record["old"].items()):
        for name in names:
            if not store.exists(f"{away}/{source}/{name}") and store.exists(f"{root}/{source}/{name}"):
                store.move(f"{root}/{source}/{name}", f"{away}/{source}/{name}")
                after(f"out {source}/{name}")
    for source, names in sorted(record["new"].items()):
        for name in names:
            if store.exists(f"{change}/new/{source}/{name}"):
                store.move(f"{change}/new/{source}/{name}", f"{root}/{source}/{name}")
                after(f"in {source}/{name}")
    store.move(f"{change}/commit.json", f"{change}/done.json")
    after("done")
    store.delete(change)


def recover(spark: SparkSession, root: str) -> list[str]:
    """Carry out what was committed and give up what was not; returns the changes that were carried out.

    To be called before a writer's work and by whoever finds an archive after a break; not while a writer is at work.
    """
    store, finished = Store(spark, root), []
    for name in store.names(root):
        if name.startswith(PREFIX):
            change = f"{store.root}/{name}"
            if store.exists(f"{change}/commit.json"):
                _carry_out(store, change, lambda step: None)
                finished.append(name)
            else:
                store.delete(change)
    return finished
