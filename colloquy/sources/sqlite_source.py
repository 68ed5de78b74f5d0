"""Tables of SQLite files as a Spark data source: a partition for each file, and filters on columns go into SQLite's own query.

Rows are read with a cursor and handed on in Arrow batches of bounded size, so neither a file nor a
table is held in memory.  A file that cannot be opened where it is (locked, or in a store that
SQLite cannot reach) is copied, with its write-ahead log, to the task's own temporary folder for the time of the read.  A missing
table or a file that is no database gives no rows, a missing column nulls.
"""

from __future__ import annotations

import json
import shutil
import sqlite3
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import closing, contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import LongType, StructType

#: Rows of a batch, and bytes of texts in it.
ROWS, BYTES = 4096, 4 << 20


def tables(spark: SparkSession, paths: list[str], table: str, columns: str) -> DataFrame:
    """Rows of a table in each of the files; columns, as of a schema, may be string or bigint, and `path` is the file.

    Spark keeps one pushed filter for each load, so rows that are filtered in two ways must come from two calls.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTables)
    return spark.read.format(SqliteTables.name()).schema(f"path string, {columns}").option("paths", json.dumps(paths)).option("table", table).load()


class SqliteTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, json.loads(self.options["paths"]), self.options["table"])


class OneFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], table: str) -> None:
        self.schema, self.paths, self.table, self.conditions = schema, paths, table, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities, lists and beginnings of one text column go into the query; what SQLite compares otherwise stays with Spark."""
        own = {f.name for f in self.schema.fields if f.name != "path"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in own and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.conditions.append((column, "= ?", [f.value]))
            elif column in own and isinstance(f, In) and f.value and all(isinstance(v, str) for v in f.value):
                self.conditions.append((column, f"in ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column in own and isinstance(f, StringStartsWith):
                self.conditions.append((column, "glob ?", ["".join(f"[{c}]" if c in "*?[" else c for c in f.value) + "*"]))
            elif not (column in own and isinstance(f, IsNotNull)):
                yield f
            else:
                self.conditions.append((column, "is not null", []))

    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for p in self.paths]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        whole = {f.name for f in self.schema.fields if isinstance(f.dataType, LongType)}
        held: list[tuple] = []
        size = 0
        for row in self._rows(partition.path, [n for n in names if n != "path"]):
            values = dict(zip([n for n in names if n != "path"], row, strict=True)) | {"path": partition.path}
            held.append(tuple(_whole(values[n]) if n in whole else _text(values[n]) for n in names))
            size += sum(len(v) for v in held[-1] if isinstance(v, str))
            if len(held) == ROWS or size > BYTES:
                yield self._batch(held, names, whole)
                held, size = [], 0
        if held:
            yield self._batch(held, names, whole)

    @staticmethod
    def _batch(rows: list[tuple], names: list[str], whole: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in whole else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    def _rows(self, path: str, columns: list[str]) -> Iterator[tuple]:
        with opened(path) as base:
            if base is None:
                return
            quoted = lambda name: '"' + name.replace('"', '""') + '"'
            there = {r[1] for r in base.execute(f"pragma table_info({quoted(self.table)})")}
            if not there or any(c not in there for c, _, _ in self.conditions):
                return
            wanted = ", ".join(quoted(c) if c in there else "null" for c in columns)
            # Values that are stored as bytes are compared as texts, as Spark would see them.
            told = " and ".join(f"cast({quoted(c)} as text) {how}" if "null" not in how else f"{quoted(c)} {how}" for c, how, _ in self.conditions)
            values = [v for _, _, given in self.conditions for v in given]
            yield from base.execute(f"select {wanted} from {quoted(self.table)}" + (f" where {told}" if told else "") + " order by rowid", values)


def _text(value: object) -> str | None:
    return value.decode(errors="replace") if isinstance(value, bytes) else None if value is None else str(value)


def _whole(value: object) -> int | None:
    try:
        return None if value is None else int(value)
    except (TypeError, ValueError):
        return None


def _connected(path: Path) -> sqlite3.Connection:
    base = sqlite3.connect(f"{path.as_uri()}?mode=ro", uri=True, timeout=1)
    base.text_factory = lambda raw: raw.decode(errors="replace")
    base.execute("select count(*) from sqlite_master").fetchone()
    return base


@contextmanager
def opened(uri: str) -> Iterator[sqlite3.Connection | None]:
    """A connection that reads a file, or None where it is no database."""
    from urllib.parse import unquote, urlparse

    parsed = urlparse(uri)
    local = Path(unquote(parsed.path)) if parsed.scheme in ("", "file") else None
    if local is not None:
        try:
            base = _connected(local)
        except sqlite3.Error:
            pass
        else:
            with closing(base):
                yield base
            return
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder) / "copy.sqlite"
        if local is not None:
            if not local.is_file():
                yield None
                return
            for ending in ("", "-wal"):
                if (own := local.with_name(local.name + ending)).is_file():
                    shutil.copyfile(own, copy.with_name(copy.name + ending))
        else:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(name) as source, copy.open("wb") as target:
                shutil.copyfileobj(source, target, 1 << 20)
        try:
            base = sqlite3.connect(copy)
            base.text_factory = lambda raw: raw.decode(errors="replace")
            base.execute("select count(*) from sqlite_master").fetchone()
        except sqlite3.Error:
            yield None
            return
        with closing(base):
            yield base
