"""Scans of dumps: history lines, page XML and SQL statements."""

from __future__ import annotations

import functools
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.shared import arrow_path

# The width of a line of the public history dumps, and the places of the fields read here.
WIDTH = 78
PLACE = {"entity": 2, "type": 3, "ts": 4, "user_text": 8, "bot_by": 14, "anonymous": 19, "temporary": 20, "page_id": 28, "page_title": 30, "namespace": 31, "page_created": 37, "revision_id": 60, "parent_id": 61, "byte_size": 65, "sha1": 67, "deleted": 70, "reverted": 72, "revert": 75}


def history_lines(spark: SparkSession, path: str, namespace: str = "0") -> DataFrame:
    """Revisions of a tab-separated history dump, bzip2 or plain (both are split between tasks).

    Kept are creations of revisions in the namespace at the time that weren't deleted with their page. A line of another width
    stops the scan. Empty fields are null.
    """
    parts = F.split(F.col("value"), "\t", -1)
    checked = F.when(F.size(parts) == WIDTH, parts).otherwise(F.raise_error(F.format_string(f"expected {WIDTH} fields, got %d", F.size(parts))).cast("array<string>"))
    rows = spark.read.text(path).select(checked.alias("f"))
    get = lambda name: F.col("f")[PLACE[name]]
    text = lambda name: F.nullif(get(name), F.lit(""))
    when = lambda name: F.to_timestamp_ntz(F.substring(text(name), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    kept = rows.filter((get("entity") == "revision") & (get("type") == "create") & (get("namespace") == namespace) & (get("deleted") != "true"))
    return kept.select(
        get("page_id").cast("bigint").alias("page_id"), text("page_title").alias("page_title"), get("revision_id").cast("bigint").alias("revision_id"), text("parent_id").cast("bigint").alias("parent_id"),
        when("ts").alias("ts"), text("user_text").alias("user_text"), ((get("anonymous") == "true") | (get("temporary") == "true")).alias("is_anon"), (get("bot_by") != "").alias("is_bot"),
        text("byte_size").cast("bigint").alias("byte_size"), text("sha1").alias("sha1"), when("page_created").alias("page_created"), (get("revert") == "true").alias("source_is_revert"), (get("reverted") == "true").alias("source_is_reverted"),
    )


_PAGE = "id bigint, ns int, title string, revision array<struct<id: bigint, parentid: bigint, timestamp: string, contributor: struct<username: string, id: bigint, ip: string>, comment: string, text: struct<_bytes: bigint>, sha1: string>>"


def page_xml(spark: SparkSession, path: str, namespace: int = 0) -> DataFrame:
    """Revisions of a stub dump of pages in XML. A revision whose contributor has no id is anonymous; a hidden one has no user."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path).filter(F.col("ns") == namespace)
    rows = pages.select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), F.explode("revision").alias("r"))
    return rows.select(
        "page_id", "page_title", F.col("r.id").alias("revision_id"), F.col("r.parentid").alias("parent_id"), F.to_timestamp_ntz(F.substring("r.timestamp", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        F.coalesce("r.contributor.username", "r.contributor.ip").alias("user_text"), F.col("r.contributor.id").isNull().alias("is_anon"), F.col("r.text._bytes").alias("byte_size"), F.col("r.sha1").alias("sha1"),
    )


_VALUE = rb"(?:NULL|'(?:[^'\\]|\\.)*+'|[-+0-9.eE]++)"
#: Bytes of an uncompressed dump in one partition; a statement belongs to the partition in which its line begins.
SPLIT = 64 << 20


@functools.lru_cache
def _row(width: int, wanted: tuple[int, ...]) -> re.Pattern:
    """A row of ``width`` values, of which those wanted are groups."""
    return re.compile(rb"\(" + rb",".join(b"(" + _VALUE + b")" if i in wanted else _VALUE for i in range(width)) + rb"\)")


def parse_rows(line: bytes, width: int, wanted: tuple[int, ...] | None = None) -> Iterator[tuple[bytes | None, ...]]:
    """The wanted values, by default all, of the rows of ``(..),(..);``; anything that isn't a row of ``width`` values raises."""
    pattern, at = _row(width, tuple(range(width)) if wanted is None else tuple(sorted(wanted))), 0
    for row in pattern.finditer(line):
        if row.start() != at:
            break
        at = row.end() + 1
        if line[at - 1 : at] not in (b",", b";", b""):
            raise ValueError(f"no separator at byte {at - 1}: {line[at - 1 : at + 59]!r}")
        yield tuple([None if v == b"NULL" else v[1:-1] if v[:1] == b"'" else v for v in row.groups()])
    if at < len(line):
        raise ValueError(f"no row of {width} values at byte {at}: {line[at : at + 60]!r}")


@functools.lru_cache
def _integers(width: int) -> re.Pattern:
    return re.compile(rb"(?:\(-?\d+" + rb",-?\d+" * (width - 1) + rb"\)(?:,(?=\()|;?$))++")


def parse_integers(line: bytes, width: int) -> np.ndarray | None:
    """The rows of a line that holds nothing but integers, read at once; None for any other line."""
    if not _integers(width).fullmatch(line):
        return None
    flat = line.translate(bytes.maketrans(b"();", b"   "))
    return np.fromstring(flat.decode(), np.int64, sep=",").reshape(-1, width) if b"," in flat else np.array([[int(flat)]], np.int64)


def _open(path: str):
    from pyarrow import fs

    path = arrow_path(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The dump files of a path, with their sizes."""
    from pyarrow import fs

    path = arrow_path(path)
    system, name = _open(path)
    info = system.get_file_info(name)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file]
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((head + f.path, f.size) for f in found if not f.base_name.startswith(("_", ".")))


def _columns(path: str) -> list[str]:
    """The columns of the table that a dump creates before its first INSERT."""
    system, name = _open(path)
    columns: list[str] = []
    creating = False
    with system.open_input_stream(name, compression="detect") as raw:
        for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8", "surrogateescape"):
            line = line.strip()
            if line.startswith("INSERT INTO"):
                break
            if line.startswith("CREATE TABLE"):
                columns, creating = [], True
            elif creating:
                if line.startswith("`"):
                    columns.append(line[1:].split("`", 1)[0])
                creating = not line.startswith(")")
    return columns


def _lines(path: str, start: int, end: int | None) -> Iterator[bytes]:
    """The lines of a file that begin from ``start`` on and before ``end``; a line is held at a time."""
    system, name = _open(path)
    if end is None:
        with system.open_input_stream(name, compression="detect") as raw:
            yield from io.BufferedReader(raw, 1 << 20)
        return
    with system.open_input_file(name) as raw:
        raw.seek(max(0, start - 1))
        file = io.BufferedReader(raw, 1 << 20)
        at = start
        if start:
            at += len(file.readline()) - 1  # the line before, of which at least its end lies before start
        for line in file:
            if at >= end:
                return
            at += len(line)
            yield line


def read_statements(path: str, columns: list[str], names: list[str], start: int = 0, end: int | None = None) -> Iterator[np.ndarray | list[tuple]]:
    """The values named of the INSERT statements whose lines begin in a part of a file, line by line: an array of integers, or rows of raw bytes with their escapes.

    Statements may have a row on each line; such lines are told by their bracket.
    """
    places = tuple(columns.index(n) for n in names)
    order = sorted(range(len(places)), key=lambda i: places[i])
    back = [order.index(i) for i in range(len(places))]
    for line in _lines(path, start, end):
        line = line.strip()
        if line.startswith(b"INSERT INTO"):
            line = line.partition(b" VALUES")[2].strip()
        elif not line.startswith(b"("):
            continue
        if not line or line == b";":
            continue
        numbers = parse_integers(line.rstrip(b","), len(columns))
        if numbers is not None:
            yield numbers[:, places]
        else:
            yield [tuple(map(row.__getitem__, back)) for row in parse_rows(line, len(columns), places)]


@dataclass
class DumpPart(InputPartition):
    path: str
    columns: list
    start: int = 0
    end: int | None = None


class SqlDumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, split: int) -> None:
        self.schema, self.path, self.split = schema, path, split

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path, size in _files(self.path):
            columns = _columns(path)
            if not columns and size:
                raise ValueError(f"{path}: no CREATE TABLE before its rows")
            if path.endswith((".gz", ".bz2", ".zst")):
                parts.append(DumpPart(path, columns))
            else:
                parts += [DumpPart(path, columns, i, min(size, i + self.split)) for i in range(0, size, self.split)]
        return parts or [DumpPart("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [f.name for f in self.schema.fields]
        numeric = [isinstance(f.dataType, T.LongType) for f in self.schema.fields]
        fields = pa.schema([(n, pa.int64() if number else pa.binary()) for n, number in zip(names, numeric)])
        for rows in read_statements(partition.path, partition.columns, names, partition.start, partition.end):
            if isinstance(rows, np.ndarray):
                columns = [pa.array(rows[:, i]) if number else pa.array([b"%d" % v for v in rows[:, i].tolist()], pa.binary()) for i, number in enumerate(numeric)]
            else:
                columns = [pa.array([None if v is None else int(v) for v in c], pa.int64()) if number else pa.array(c, pa.binary()) for c, number in zip(zip(*rows), numeric)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, schema=fields)


class SqlDump(DataSource):
    """``spark.read.format("sqldump").schema("id bigint, title binary").load(path)``: named columns only, of files that any Arrow file system reads.

    Columns of the schema are bigint or binary; strings come as raw bytes with their escapes. Uncompressed files are split between
    tasks at lines, about ``split`` bytes each.
    """

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        raise ValueError("give a schema with the columns to read")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqlDumpReader(schema, self.options["path"], int(self.options.get("split", SPLIT)))


def write_lines(lines: DataFrame, path: str, head: list[str], tail: list[str]) -> None:
    """Write the one string column of ``lines`` as text, a file for each partition, each between ``head`` and ``tail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (pa.array(head), *(batch.column(0) for batch in batches), pa.array(tail)):
            yield pa.RecordBatch.from_arrays([part], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)


def write_statements(rows: DataFrame, table: str, columns: dict[str, str], path: str, each: int = 1000) -> None:
    """Write ``rows`` (one string ``row`` of values in brackets) as dump files: one for each partition, with its own CREATE TABLE, ``each`` rows a statement."""
    head = [f"CREATE TABLE `{table}` (", ",\n".join(f"  `{n}` {kind}" for n, kind in columns.items()), ");"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head)], names=["value"])
        for batch in batches:
            own = batch.column(0).to_pylist()
            lines = [f"INSERT INTO `{table}` VALUES {','.join(own[i : i + each])};" for i in range(0, len(own), each)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows.select("row").mapInArrow(run, "value string").write.text(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqlDump)


def live_changes(changes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Records of changes as a recent-changes feed gives them, of edits and new pages in the main space from ``start`` up to ``end``.

    ``changes``: type, ns, title, pageid, revid, old_revid, user, anon, temp, bot, userhidden, newlen, ts, sha1, sha1hidden. Hidden
    users and hashes are null; the end is left out although feeds include it.
    """
    from palimpsest.functions.arrow import sha1_base36

    own = changes.filter((F.col("ns") == 0) & F.col("type").isin("edit", "new") & (F.col("ts") >= start) & (F.col("ts") < end))
    flag = lambda c: F.coalesce(c, F.lit(False))
    shown = F.when(~flag("sha1hidden") & (F.col("sha1") != ""), F.col("sha1"))
    return own.select(
        F.col("pageid").alias("page_id"), F.translate("title", " ", "_").alias("page_title"), F.col("revid").alias("revision_id"), F.col("old_revid").alias("parent_id"), "ts", F.when(~flag("userhidden"), F.col("user")).alias("user_text"),
        (flag("anon") | flag("temp")).alias("is_anon"), flag("bot").alias("is_bot"), F.col("newlen").alias("byte_size"), sha1_base36(shown).alias("sha1"), F.when(F.col("type") == "new", F.col("ts")).alias("page_created"),
    )


def fetch_by_batches(ids: DataFrame, client, size: int = 50) -> DataFrame:
    """(revision_id, text) of ``ids`` (revision_id): ``client`` gets lists of up to ``size`` ids in a task and returns a dict; a missing text is null."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            own = pdf["revision_id"].tolist()
            for i in range(0, len(own), size):
                part = own[i : i + size]
                found = client(part)
                yield pd.DataFrame({"revision_id": part, "text": [found.get(r) for r in part]})

    return ids.select("revision_id").mapInPandas(run, "revision_id bigint, text string")
