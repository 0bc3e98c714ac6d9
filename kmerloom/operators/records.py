"""Quality records (header, seq, quality) as comma-separated text: typed rows, and the rows that fail with the reason.

The format is a small grammar, parsed by recursive descent, one method for each rule:

    stream  = record { newline record }          record = field { "," field }
    field   = quoted | bare                      quoted = '"' { any but '"' | '""' } '"'
    bare    = { any but ',' and '"' }

`parse_records` takes one record per row. `parse_streams` takes texts of many records: there a broken quote would
swallow the records behind it, so after a syntax error the parser goes on at the next validated record start: a line
that begins with `@` (bare or quoted) and whose own record parses with three fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER, SEQ, QUALITY = re.compile(r"@[!-~]", re.S), re.compile(r"[ACGTN]+"), re.compile(r"[!-~]+")
ANCHOR = re.compile(r'\n"?@[!-~]')
REASONS = ("quoting", "columns", "header", "seq", "quality", "length")


class SyntaxFault(Exception):
    """A broken quote at offset `at` of the text."""

    def __init__(self, at: int) -> None:
        super().__init__(at)
        self.at = at


class Grammar:
    """Recursive descent over one text. In a stream a line break outside quotes ends a record; else it is a character."""

    def __init__(self, text: str, stream: bool) -> None:
        self.text, self.size = text, len(text)
        self.ends = re.compile(r'[,"\n]' if stream else r'[,"]')

    def record(self, at: int) -> tuple[list[str], int]:
        """The fields of the record at `at` and the offset of its end."""
        fields = []
        while True:
            value, at = self.field(at)
            fields.append(value)
            if at >= self.size or self.text[at] != ",":
                return fields, at
            at += 1

    def field(self, at: int) -> tuple[str, int]:
        return self.quoted(at) if self.text.startswith('"', at) else self.bare(at)

    def bare(self, at: int) -> tuple[str, int]:
        found = self.ends.search(self.text, at)
        end = found.start() if found else self.size
        if found and found.group() == '"':
            raise SyntaxFault(end)
        return self.text[at:end], end

    def quoted(self, at: int) -> tuple[str, int]:
        opened, parts = at, []
        at += 1
        while True:
            end = self.text.find('"', at)
            if end < 0:
                raise SyntaxFault(opened)
            parts.append(self.text[at:end])
            if not self.text.startswith('"', end + 1):
                break
            parts.append('"')
            at = end + 2
        at = end + 1
        if at < self.size and self.ends.match(self.text, at) is None or self.text.startswith('"', at):
            raise SyntaxFault(at)
        return "".join(parts), at

    def anchor(self, at: int) -> int:
        """The next offset behind `at` at which a record starts for certain; the end of the text if there is none."""
        for found in ANCHOR.finditer(self.text, at):
            start = found.start() + 1
            try:
                fields, _ = self.record(start)
            except SyntaxFault:
                continue
            if len(fields) == 3:
                return start
        return self.size


def fault_of(fields: list[str]) -> tuple[str | None, int]:
    """The first reason that a record of these fields can't be loaded, and the index of the field; None if it can."""
    if len(fields) != 3:
        return "columns", min(len(fields), 3)
    for i, (reason, ok) in enumerate((("header", HEADER.match(fields[0])), ("seq", SEQ.fullmatch(fields[1])), ("quality", QUALITY.fullmatch(fields[2])))):
        if not ok:
            return reason, i
    return ("length", 2) if len(fields[1]) != len(fields[2]) else (None, -1)


def _row(fields: list[str] | None, reason: str | None, at: int, column: int) -> tuple:
    return (*(fields if reason is None else (None, None, None)), reason, at, column)


def parse_one(line: str | None) -> tuple:
    """(header, seq, quality, reason, error_at, error_field) of one record; null counts as empty."""
    text = line or ""
    if text.endswith("\r"):
        text = text[:-1]
    try:
        fields, _ = Grammar(text, False).record(0)
    except SyntaxFault as e:
        return _row(None, "quoting", e.at, -1)
    reason, column = fault_of(fields)
    return _row(fields, reason, -1 if reason is None else 0, column)


def parse_many(text: str | None) -> list[tuple]:
    """(start, then as parse_one, resumed_at) of each record of a stream; empty lines between records are no records.

    resumed_at is where reading goes on after a broken quote: all from start to there belongs to that fault; else null.
    """
    text = (text or "").replace("\r\n", "\n")
    grammar, at, out = Grammar(text, True), 0, []
    while at < grammar.size:
        if text[at] == "\n":
            at += 1
            continue
        try:
            fields, end = grammar.record(at)
            reason, column = fault_of(fields)
            out.append((at, *_row(fields, reason, -1 if reason is None else at, column), None))
        except SyntaxFault as e:
            end = grammar.anchor(at)
            out.append((at, *_row(None, "quoting", e.at, -1), end))
        at = end
    return out


PARSED = "header STRING, seq STRING, quality STRING, reason STRING, error_at INT, error_field INT"
_TYPE = pa.struct([("header", pa.string()), ("seq", pa.string()), ("quality", pa.string()), ("reason", pa.string()), ("error_at", pa.int32()), ("error_field", pa.int32())])
_NAMES = [f.name for f in _TYPE]


def _structs(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.StructArray:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


@F.arrow_udf(T.StructType([T.StructField(f.name, T.StringType() if f.type == pa.string() else T.IntegerType()) for f in _TYPE]))
def _parse_records(lines: pa.Array) -> pa.Array:
    return _structs([parse_one(x) for x in lines.to_pylist()], _NAMES, [f.type for f in _TYPE])


def parse_records(df: DataFrame, line: str = "raw_line", into: str = "parsed") -> DataFrame:
    """Add the struct `into` (header, seq, quality, reason, error_at, error_field) of one record per row.

    A row loads if reason is null; else header, seq and quality are null and reason is the first of REASONS that
    applies, error_at the offset of a quoting error and error_field the 0-based field at fault (-1: none). A null line
    is an empty one, which has reason `columns`. Every other column is kept; `into` must not be among them.
    """
    if into in df.columns:
        raise ValueError(f"column {into} exists; name another for `into`")
    return df.withColumn(into, _parse_records(F.col(line)))


def load_records(df: DataFrame, line: str = "raw_line", into: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """The valid rows and the failed ones (as parse_records gives them), apart."""
    parsed = parse_records(df, line, into)
    return parsed.where(F.col(f"{into}.reason").isNull()), parsed.where(F.col(f"{into}.reason").isNotNull())


def as_streams(df: DataFrame, file: str, number: str, tie: str, line: str, lines: int = 64) -> DataFrame:
    """(`file`, block, body): the lines of each file put together again, `lines` line numbers a text, so that no file is one row.

    Lines come in the order of `number`, then `tie`; a null line is an empty one, a null number comes first in a block of its own.
    """
    of_block = F.array_sort(F.collect_list(F.struct(F.col(number).alias("a"), F.col(tie).alias("b"), F.coalesce(F.col(line), F.lit("")).alias("c"))))
    grouped = df.groupBy(file, F.floor(F.col(number) / lines).alias("block")).agg(of_block.alias("held"))
    return grouped.select(file, "block", F.array_join("held.c", "\n").alias("body"))


def parse_streams(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per record of the texts in column `text`, with the columns `keep`, record_start, those of PARSED and resumed_at.

    A syntax error becomes one row with reason `quoting` and its place; reading goes on at the next validated record
    start, resumed_at (null for all other rows). Null and empty texts give no rows.
    """
    named = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "record_start INT", PARSED, "resumed_at INT"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_many(t) for t in b.column(0).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            rows = _structs([r for rows in found for r in rows], ["record_start", *_NAMES, "resumed_at"], [pa.int32(), *(f.type for f in _TYPE), pa.int32()])
            kept = [b.column(i + 1).take(at) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *rows.flatten()], names=[*keep, "record_start", *_NAMES, "resumed_at"])

    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(run, named)
