"""A corpus pipeline: language, lines, near-duplicates, secrets, packing. Each stage's result is written and read again.

Stages take any table with doc_id and text and keep its other columns, whatever their names. Null, empty and blank
texts have no language and go in the first stage (where a stage is called alone, the others keep them); repeated rows
(same id and text) are one document, of which one row is left after near dedup; ties go to the smaller id, null ids
last; an empty table gives an empty one, and very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmass.llm import langid, lines, packing, secrets, simhash, tokens
from quillmass.llm.common import drop_stored, stored, stored_count, table
from quillmass.llm.queries import BYTE_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a language go. The network learns from the labelled part of documents."""
    net = langid.train(table(spark, sf_dir, "documents").filter(~langid.held_out()))
    return langid.keep_identified(docs, net)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that an earlier line repeats go, and documents of nothing else."""
    return lines.keep_new_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of texts with a similarity of 0.8 or more in 5-word shingles the smallest id stays."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced by a mark; no document goes."""
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of all documents, with their sequence and place in it."""
    return packing.pack_documents(docs, tokens.public_path(BYTE_BPE))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: A trained network and BPE are not to be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages leave. A stage's tables go when the next has been written."""
    docs = table(spark, sf_dir, "documents")
    before = stored_count()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(before, keep=1)
    return docs
