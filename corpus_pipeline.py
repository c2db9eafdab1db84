"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage works on all rows that the one before kept.  All but the last return
the columns of ``documents`` (further columns of the input pass through):

* language_id drops documents for which no language is found: no letter at all,
  or no margin between languages;
* near_duplicates keeps, of each group tied by similarity 0.8 or more, the
  row of least doc_id, and of equal rows one; other rows of a doc_id stay;
* repeated_passages cuts strings of 100 bytes that start earlier in the corpus;
  a code point that loses a byte goes whole; n_chars follows the text;
* decontamination cuts the spans of benchmark windows; n_chars follows the text;
* packing returns pieces with their place in sequences.

Nulls: a null text has no letter, so it goes in the first stage; a null doc_id is
kept wherever its text is.  Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import decontamination, jaccard_join, language_id, packing, suffix_dedup
from blockloom.llm._common import blocks, bounded_batches, fresh_dir, table

#: The least margin between the best language and the next; below it a text has no language.
MIN_MARGIN = 0.005


def _columns(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs from a carried row, with a new text, n_chars following it if there is one."""
    made = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return [made[c] if c in made else F.col("row")[c].alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(language_id.fit(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            if model.value is not None:
                names, scores = model.value.predict(block)
                yield block.batch.filter(pa.array([n != "und" and s >= MIN_MARGIN for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard_join.keep_one(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    left = suffix_dedup.remove_repeats(docs, carry=others)
    return left.select(_columns(docs, F.col("kept_text")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing plan have no SQL form; tests/llm hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
