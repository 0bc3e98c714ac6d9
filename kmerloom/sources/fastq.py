"""FASTQ files as a Spark data source: four lines a record, split by byte ranges, read where they lie.

    spark.dataSource.register(FastqDataSource)
    spark.read.format("fastq").load(path)                     (byte_offset, header, seq, qual)
    df.select("header", "seq", "qual").write.format("fastq").save(path)

`byte_offset` tells the order of the records of a file. Options: `split` (bytes a task, 64 MB), `mode` (DROPMALFORMED,
the default, or FAILFAST). Only files that each worker can open are read; a folder means all .fastq and .fq files in it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kmerloom.operators.reads import with_running

SCHEMA = "file STRING, byte_offset BIGINT, header STRING, seq STRING, qual STRING"
SPLIT, BATCH = 64 << 20, 5_000
_NAMES = ["file", "byte_offset", "header", "seq", "qual"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".fastq", ".fq")))
    return [path]


def _records(part: Range, strict: bool) -> Iterator[tuple]:
    """The records that start in the range. `@` may also start a quality line, so a start is a line with `@` two before one with `+`."""
    with open(part.path, "rb") as f:
        f.seek(max(part.start - 1, 0))
        if part.start:
            f.readline()
        at = f.tell()
        lines = [f.readline() for _ in range(4)]
        while at < part.end and lines[0]:
            if lines[0].startswith(b"@") and lines[2].startswith(b"+") and not lines[1].startswith(b"@"):
                header, seq, _, qual = (x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines)
                if len(seq) == len(qual):
                    yield part.path, at, header[1:], seq, qual
                elif strict:
                    raise ValueError(f"{part.path}, byte {at}: sequence and quality differ in length")
                at = f.tell()
                lines = [f.readline() for _ in range(4)]
            else:
                if strict and part.start == 0 and lines[0].strip():
                    raise ValueError(f"{part.path}, byte {at}: no record starts here")
                at += len(lines[0])
                lines = [*lines[1:], f.readline()]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = _files(options["path"])
        self.split = int(options.get("split", SPLIT))
        self.strict = options.get("mode", "DROPMALFORMED").upper() == "FAILFAST"

    def partitions(self) -> list[Range]:
        return [Range(p, i, i + self.split) for p in self.paths for i in range(0, max(os.path.getsize(p), 1), self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        records = _records(partition, self.strict)
        while rows := list(islice(records, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


@dataclass
class Part(WriterCommitMessage):
    temporary: str
    records: int


class FastqWriter(DataSourceWriter):
    """One part file a task, moved into place when all are written; null fields are empty ones."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        path, n = os.path.join(self.folder, f"_part-{uuid.uuid4().hex}"), 0
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            for row in iterator:
                header = (row.header or "").replace("\r", " ").replace("\n", " ")
                f.write(f"@{header}\n{row.seq or ''}\n+\n{row.qual or ''}\n")
                n += 1
        return Part(path, n)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in _files(self.folder):
                os.remove(old)
        have = len(_files(self.folder))
        for i, m in enumerate(m for m in messages if m and m.records):
            os.replace(m.temporary, os.path.join(self.folder, f"part-{have + i:05d}.fastq"))
        self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FastqReader:
        return FastqReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> FastqWriter:
        return FastqWriter(self.options, overwrite)


def with_ordinals(records: DataFrame) -> DataFrame:
    """Records with read_id, their 0-based number, found without reading a file in one task. Several files count one after the other, by name."""
    turn = F.row_number().over(Window.orderBy("file")) - 1  # one row a file
    files = records.select("file").distinct().withColumn("_turn", turn.cast("long"))
    placed = records.join(files, "file").withColumn("_at", F.col("_turn") * (1 << 44) + F.col("byte_offset"))
    return with_running(placed, "_at", into="read_id", block=16 << 20).drop("_turn", "_at")


def record_range(records: DataFrame, start: int, count: int) -> DataFrame:
    """`count` records from number `start` on."""
    return with_ordinals(records).where((F.col("read_id") >= start) & (F.col("read_id") < start + count))


def write_fastq(records: DataFrame, path: str, seq: str = "seq", order: str | None = None, mode: str = "append") -> None:
    """Write (header, `seq`, qual) as FASTQ: a part file a task. With `order` the parts, by name, are in that order.

    `mode` append keeps the files that are there, overwrite replaces them.
    """
    if order:
        records = records.orderBy(order)
    records.select("header", F.col(seq).alias("seq"), "qual").write.format("fastq").mode(mode).save(path)
