"""CSV files whose quoted fields hold line breaks, read in byte ranges by many tasks.

A file's lines come from Spark's text source, which splits it anywhere. Whether a range begins inside a quoted field
is the parity of all quotes before it: a first pass counts each range's quotes. In the second, each range joins its
lines to records; what a record leaves unfinished at its range's end meets what the next ranges begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A record's position: its file's number above this many bits, below it the range's first byte and the line in the range.
FILE_BITS = 44

_RECORD = "file string, block long, position long, record string, part string"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("record", pa.string()), ("part", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines without their line feed, in order within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _starts(lines: DataFrame) -> dict[str, tuple[int, frozenset[int]]]:
    """Of each file its number in order of names, and the ranges that begin inside a quoted field: mostly none."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    held = inside.groupBy("file").agg(F.collect_list(F.when(F.col("inside"), F.col("block"))).alias("blocks"))
    found = sorted((r["file"], frozenset(r["blocks"])) for r in held.collect())
    return {file: (i, blocks) for i, (file, blocks) in enumerate(found)}


class _Range:
    """The lines of one range, as records and as parts of records that cross its ends."""

    def __init__(self, file: str, block: int, number: int, inside: bool):
        self.file, self.block, self.at, self.inside = file, block, (number << FILE_BITS) + block, inside
        #: Lines of the record that is not finished, its position, and whether it began before the range.
        self.held, self.begin, self.cut = [], self.at, inside

    def whole(self, values: pa.Array) -> pa.RecordBatch:
        """A batch of lines that are a record each."""
        n = len(values)
        self.at += n
        same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(n, np.int32)))
        return pa.RecordBatch.from_arrays([same(self.file, pa.string()), same(self.block, pa.int64()), pa.array(np.arange(self.at - n, self.at)), values.cast(pa.string()), same(None, pa.string())], schema=_ARROW)

    def row(self, part: str | None) -> tuple:
        out = (self.file, self.block, self.begin, "\n".join(self.held), part)
        self.held, self.cut = [], False
        return out

    def joined(self, values: list[str], odd: list[bool]) -> Iterator[tuple]:
        for value, turns in zip(values, odd, strict=True):
            if not self.held:
                self.begin = self.at
            self.held.append(value)
            self.at += 1
            self.inside ^= turns
            if not self.inside:
                yield self.row("end" if self.cut else None)

    def rest(self) -> Iterator[tuple]:
        if self.held:
            yield self.row("middle" if self.cut else "begin")


def _assembled(lines: DataFrame, starts: dict) -> DataFrame:
    """Records, and parts of records that cross the ends of ranges."""
    shared = lines.sparkSession.sparkContext.broadcast(starts)  # a row a file, and the few ranges that begin inside a field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        for batch in batches:
            blocks = batch.column(2).to_numpy()
            files = batch.column(1).dictionary_encode()
            codes = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                file, block = files.dictionary[int(codes[s])].as_py(), int(blocks[s])
                if now is None or (now.file, now.block) != (file, block):
                    if now and (rows := list(now.rest())):
                        yield as_batch(rows)
                    number, inside = shared.value[file]
                    now = _Range(file, block, number, block in inside)
                values = batch.column(0).slice(s, e - s)
                odd = pc.count_substring(values, '"').to_numpy() % 2 == 1
                if not now.inside and not odd.any():
                    yield now.whole(values)
                elif rows := list(now.joined(values.to_pylist(), odd.tolist())):
                    yield as_batch(rows)
        if now and (rows := list(now.rest())):
            yield as_batch(rows)

    return lines.mapInArrow(run, _RECORD)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(position, record) of every record of the file, or of the files of a folder, headers and empty lines among them.

    Quotes stand only around fields and, doubled, within them. Records end with a line feed; a carriage return before
    one is dropped, also in fields. Positions grow in order of the file, files in order of their names.
    """
    lines = _lines(spark, path)
    made = _assembled(lines, _starts(lines))
    # Parts are two a range at most. A record begins with a part that says so; those after it, up to the next such, go on.
    in_order = Window.partitionBy("file").orderBy("block", "position")
    parts = made.where("part is not null").withColumn("number", F.sum(F.when(F.col("part") == "begin", 1).otherwise(0)).over(in_order))
    held = F.array_sort(F.collect_list(F.struct("block", "position", "record")))
    joined = parts.groupBy("file", "number").agg(F.min("position").alias("position"), F.array_join(F.transform(held, lambda x: x["record"]), "\n").alias("record"))
    out = made.where("part is null").select("position", "record").unionByName(joined.select("position", "record"))
    return out.select("position", F.regexp_replace("record", r"\r(\n|\z)", "$1").alias("record"))


def read(spark: SparkSession, path: str, position: str) -> DataFrame:
    """The rows of CSV files with headers as strings, with their position; a ragged row is an error."""
    options = {"escape": '"', "mode": "FAILFAST"}
    # Reads the first record alone.
    names = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, **options).columns
    if not names:
        return spark.createDataFrame([], f"{position} long").select()
    first = F.col("position").bitwiseAND(F.lit((1 << FILE_BITS) - 1)) == 0
    rows = records(spark, path).where(~first & (F.col("record") != ""))
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    parsed = rows.select("position", F.from_csv("record", schema, {**options, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)], F.col("position").alias(position))
