"""Token counts (operator 4) and BPE encoding and decoding (operator 9).

Null texts count as empty. Rows are mapped one by one, without a shuffle: hot sources, repeated rows and
clashing extra columns cannot matter. A vocabulary file is read once on the driver and broadcast (its size is
checked); executors need not have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import per_worker, text_or_empty

#: A vocabulary is broadcast; larger files than this are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def public_path(name: str) -> str:
    """The place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def broadcast_vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        content = file.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary of over {MAX_VOCABULARY_BYTES} bytes is not broadcast")
    return spark.sparkContext.broadcast(content)


def _built(shared, build, name: str):
    return per_worker((name, hash(shared.value)), lambda: build(bpe.Vocabulary(shared.value)))


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """The number of tokens of a text: heap-and-linked-list merging that emits no ids."""
    shared = broadcast_vocabulary(spark, vocabulary)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = _built(shared, bpe.MergeCounter, "count")
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. A null text has 0 of each; ids may be null or repeated."""
    spark = documents.sparkSession
    counted = documents.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), token_count(spark, F.col("text"), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


#: Texts of about so many characters are encoded at a time, so that a batch's ids stay few.
SLICE = 1 << 20


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def decode(spark: SparkSession, ids: Column, vocabulary: str) -> Column:
    """The text that the arc labels of ``ids`` spell, as the library joins them; unknown ids are left out."""
    shared = broadcast_vocabulary(spark, vocabulary)

    @F.pandas_udf("string")
    def decoded(lists: pd.Series) -> pd.Series:
        automaton = _built(shared, bpe.Automaton, "automaton")
        return pd.Series([automaton.decode(x) for x in lists], dtype=object)

    return decoded(F.coalesce(ids, F.array().cast("array<int>")))


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded for every row: the ids of the whole text by the automaton, and what they decode to."""
    shared = broadcast_vocabulary(documents.sparkSession, vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        automaton = _built(shared, bpe.Automaton, "automaton")
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1).to_pylist()):
                both = [automaton.encode_both(t) for t in texts]
                ends = np.cumsum([0] + [len(b[0]) // 4 for b in both]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([b[0] for b in both]), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, pa.array([b[1] for b in both], pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(texts)

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
