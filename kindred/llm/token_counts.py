"""Token counts: lengths only, from Arrow batches, for whole texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import sliced, text_or_empty
from kindred.llm.pieces import encoder

#: Bytes of text handed to the encoder at once.
SLICE_BYTES = 4 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without begin, end or added special tokens.

    vocabulary: a file of the tokenizers library, at the same path on every executor.
    A null text counts as empty (0 bytes, 0 tokens); a null id stays null. Repeated rows are counted
    each. A long text is encoded in parts, cut at safe places; one without such a place, as a whole. Strings of
    special tokens inside a text are handled as the library does by default. Other columns of
    `docs` are left aside, so their names cannot clash. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        e = encoder(vocabulary)
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES):
                texts = part.column(1)
                n_bytes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(e.count(texts.to_pylist()))], schema=schema)

    return own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
