"""What the corpus operators share: reading tables, the shared folder, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.lineage import cut, fresh, shared_folder

__all__ = ["by_bytes", "cut", "fresh", "remove", "shared_folder", "sliced", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark has to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def by_bytes(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Consecutive lists of texts of about `most` UTF-8 bytes each."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def sliced(batch: pa.RecordBatch, column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of `batch` whose texts or binaries in `column` have about `most` bytes together."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
