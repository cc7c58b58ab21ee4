"""Tables of SQLite files, read by ranges of row numbers with columns and conditions pushed into the files.

A folder may hold one file or many, and a file may be large: its rows are planned as ranges, one query of a task each, so a
scan is as parallel as its ranges are many. Files are opened where the tasks run, so the folder is one that all executors
mount. Only what is asked for leaves a file.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark types of SQLite's declared ones; others are texts.
KINDS = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "BLOB": "binary"}
_DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "INTEGER"}
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "in", "is null", "is not null")
Condition = tuple[str, str, object]


def local_path(path: str) -> str:
    """The mounted path of a file: URL; ValueError for other stores, which SQLite cannot open."""
    bare = path[5:] if path.startswith("file:") else path
    if "://" in bare and not bare.startswith("//"):
        raise ValueError(f"not a mounted folder: {path}")
    return "/" + bare.lstrip("/")


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    place = local_path(path)
    return [place] if os.path.isfile(place) else sorted(os.path.join(place, n) for n in os.listdir(place) if n.endswith(".db"))


def table_schema(path: str, table: str) -> list[tuple[str, str]]:
    """(column, Spark type) of a table, as the first file that has it declares it; ValueError if none has it."""
    for file in _files(path):
        with _opened(file) as db:
            found = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
        if found:
            return [(c[1], KINDS.get((c[2] or "TEXT").upper().split("(")[0].strip(), "string")) for c in found]
    raise ValueError(f"no file has a table {table}")


def _where(conditions: list[Condition], known: set[str]) -> tuple[str, list]:
    """SQL with placeholders, and its values; an unknown column or operator is a ValueError."""
    parts, values = [], []
    for column, operator, value in conditions:
        if column not in known or operator not in OPERATORS:
            raise ValueError(f"unknown condition: {column} {operator}")
        if operator == "in":
            listed = list(value)
            parts.append(f"{_name(column)} IN ({', '.join('?' * len(listed))})")
            values.extend(listed)
        elif operator.startswith("is"):
            parts.append(f"{_name(column)} {operator}")
        else:
            parts.append(f"{_name(column)} {operator} ?")
            values.append(value)
    return " AND ".join(["1", *parts]), values


def planned_ranges(spark: SparkSession, path: str, table: str, rows_per_range: int) -> DataFrame:
    """(file, low, high): ranges of row numbers that cover each file's table; files without the table or without rows have none."""
    files = spark.createDataFrame([(f,) for f in _files(path)], "file string")
    each = files.repartition(max(1, min(len(_files(path)), spark.sparkContext.defaultParallelism)), "file")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in batch.column(0).to_pylist():
                with _opened(file) as db:
                    if db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone():
                        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(table)}").fetchone()
                        out.extend([(file, low, high)] if low is not None else [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["file", "low", "high"])

    found = each.mapInArrow(ends, "file string, low bigint, high bigint")
    starts = F.explode(F.sequence("low", "high", F.lit(rows_per_range).cast("bigint")))
    return found.select("file", starts.alias("low"), "high").select("file", "low", F.least(F.col("low") + (rows_per_range - 1), "high").alias("high"))


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: list[Condition] = (), rows_per_range: int = 100_000) -> DataFrame:
    """The rows of a table in the files of a folder (or one file): `columns` of those that meet all conditions (column, operator, value).

    A value that a column's declared type doesn't hold is null, as is a missing column of a file. Repeated rows stay.
    """
    schema = table_schema(path, table)
    kinds = dict(schema)
    wanted = columns or [c for c, _ in schema]
    if missing := [c for c in wanted if c not in kinds]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    condition, values = _where(list(where), set(kinds))
    python = {"bigint": int, "double": (int, float), "string": str, "binary": bytes}
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(file) as db:
                    own = {c[1] for c in db.execute(f"PRAGMA table_info({_name(table)})")}
                    listed = ", ".join(_name(c) if c in own else "NULL" for c in wanted)
                    rows = db.execute(f"SELECT {listed} FROM {_name(table)} WHERE rowid BETWEEN ? AND ? AND {condition}", [low, high, *values])
                    while part := rows.fetchmany(8192):
                        held = [[v if isinstance(v, python[kinds[c]]) else None for v in column] for c, column in zip(wanted, zip(*part))]
                        yield pa.RecordBatch.from_arrays([pa.array(v, arrow[kinds[c]]) for c, v in zip(wanted, held)], wanted)

    ranges = planned_ranges(spark, path, table, rows_per_range)
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism, "file", "low")
    return dealt.mapInArrow(read, ", ".join(f"`{c}` {kinds[c]}" for c in wanted))


def write(df: DataFrame, folder: str, table: str) -> list[str]:
    """Writes df as one SQLite file for each task that has rows, each complete under its name at once; the files' names."""
    place = local_path(folder)
    kinds = dict(df.dtypes)
    if odd := [c for c, t in kinds.items() if t not in _DECLARED]:
        raise ValueError(f"columns of a type that SQLite lacks: {', '.join(odd)}")
    made = f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(c)} {_DECLARED[t]}' for c, t in kinds.items())})"

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(place, exist_ok=True)
        beside, name, rows = os.path.join(place, f".{uuid.uuid4().hex}"), f"{uuid.uuid4().hex}.db", 0
        db = sqlite3.connect(beside)
        db.execute(made)
        for batch in batches:
            rows += batch.num_rows
            db.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns)))
        db.commit()
        db.close()
        if rows:
            os.replace(beside, os.path.join(place, name))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])
        else:
            os.remove(beside)

    return sorted(r["name"] for r in df.mapInArrow(stored, "name string").collect())  # one name for each task
