"""Encoding of a corpus: token ids and token counts of each text.

Null and empty texts give an empty list and a count of 0. Every row gives one row, repeated and null ids
too; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.bpe import VOCABULARY, encoded_batches


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids, a list of integers, without special tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, batch, words in encoded_batches(batches, vocabulary, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), e.ids(words)], ["key", "ids"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(encode, "key long, ids array<int>").withColumnRenamed("key", key)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, batch, words in encoded_batches(batches, vocabulary, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e.counts(words), pa.int64())], ["key", "n_tokens"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(count, "key long, n_tokens long").withColumnRenamed("key", key)
