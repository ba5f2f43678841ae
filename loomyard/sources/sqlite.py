"""SQLite databases, plain or as members of ZIP archives, as a Spark data source: one partition per database.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlitelog").schema("token binary, ts long, log string, error string").option("query", "SELECT ...")
         .option("paths", "/data/*.db;/data/*.zip").load()

Columns named `log` and `error` are filled by the reader: the database's name and, for one that can't be read, the error
(its other columns are null), so one broken file doesn't stop the scan; they may be left out of the schema. A database
is read in batches; members are unpacked to a local file, which is removed after the scan. Databases of one name are
read once, from the first path in order.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Database(InputPartition):
    path: str
    member: str | None
    size: int

    def __init__(self, path: str, member: str | None, size: int) -> None:
        self.path, self.member, self.size = path, member, size

    @property
    def name(self) -> str:
        return os.path.splitext(os.path.basename(self.member or self.path))[0]


def list_databases(paths: str, suffix: str = ".db") -> tuple[list[Database], list[str]]:
    """(databases, names found more than once); `paths` are globs separated by semicolons, archives among them."""
    found, repeated, seen = [], [], set()
    for pattern in filter(None, paths.split(";")):
        for path in sorted(glob.glob(pattern)):
            if zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as z:
                    new = [Database(path, i.filename, i.file_size) for i in z.infolist() if i.filename.endswith(suffix)]
            else:
                new = [Database(path, None, os.path.getsize(path))]
            for db in new:
                if db.name in seen:
                    repeated.append(db.name)
                else:
                    seen.add(db.name)
                    found.append(db)
    return found, repeated


def unpack(db: Database, path: str) -> None:
    """A member to a file, its CRC and size checked on the way; the file appears whole or not at all."""
    part = path + ".part"
    with zipfile.ZipFile(db.path) as z, z.open(db.member) as src, open(part, "wb") as out:
        while block := src.read(16 << 20):
            out.write(block)
    if (size := os.path.getsize(part)) != db.size:
        os.remove(part)
        raise OSError(f"{db.member}: {size} bytes instead of {db.size}")
    os.replace(part, path)


def open_database(db: Database, scratch: str) -> sqlite3.Connection:
    """Read-only; a member is unpacked to `scratch`, its CRC and size checked on the way."""
    path = db.path
    if db.member:
        path = os.path.join(scratch, "member.db")
        unpack(db, path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlitelog"

    def schema(self) -> str:
        """Column types of the query's result in the first database, as far as its first row tells."""
        found, _ = list_databases(self.options["paths"])
        if not found:
            raise ValueError("no database found; give a schema")
        with tempfile.TemporaryDirectory() as scratch:
            con = open_database(found[0], scratch)
            cur = con.execute(self.options["query"])
            row, names = cur.fetchone(), [c[0] for c in cur.description]
            con.close()
        kinds = {int: "long", float: "double", bytes: "binary"}
        return ", ".join(f"`{n}` {kinds.get(type(v), 'string')}" for n, v in zip(names, row or [None] * len(names))) + ", log string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(schema, self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names, self.query, self.paths = [f.name for f in schema.fields], options["query"], options["paths"]

    def partitions(self) -> list[InputPartition]:
        return list_databases(self.paths)[0] or [Database("", None, 0)]

    def read(self, db: Database) -> Iterator[tuple]:
        if not db.path:
            return
        own = [n for n in self.names if n not in ("log", "error")]
        row_of = lambda values, error: tuple(db.name if n == "log" else error if n == "error" else values.get(n) for n in self.names)
        with tempfile.TemporaryDirectory() as scratch:
            try:
                con = open_database(db, scratch)
                try:
                    cur = con.execute(self.query)
                    names = [c[0] for c in cur.description]
                    if missing := set(own) - set(names):
                        raise ValueError(f"columns not in the query: {sorted(missing)}")
                    while rows := cur.fetchmany(10_000):
                        for r in rows:
                            yield row_of(dict(zip(names, r)), None)
                finally:
                    con.close()
            except Exception as e:  # noqa: BLE001
                if "error" not in self.names:
                    raise
                yield row_of({}, f"{type(e).__name__}: {e}")
