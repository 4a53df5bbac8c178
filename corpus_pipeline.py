"""A corpus from raw documents to packed sequences: quality, repeated lines, near copies, benchmark passages, packing.

Each stage works on all that the one before it kept, which is written as Parquet to the shared folder and read again, so a lost
executor costs a stage at most. All but the last return the columns of ``documents``, and further columns of any name as they are.

Defined cases, which are those of the stages' modules: a null or blank text has no features, lines, shingles or benchmark words, so it
stays if the classifier's bias keeps it, and is packed as its end id; very long texts are handled whole, in time linear in them; of equal texts the
smallest doc_id stays; rows that repeat a doc_id and its text are one document from the near-copy stage on; a null doc_id takes part in
the quality, benchmark and packing stages only; an empty table gives no rows, and empty labels or benchmark reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import decontaminate, line_dedup, near_dedup, packing, quality
from keelson.llm.common import Scratch, fresh_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; a document of nothing else goes."""
    return line_dedup.dedup(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return near_dedup.dedup(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of any benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("lines", unrepeated_lines), ("near_copies", no_near_copies), ("benchmark", no_benchmark), ("packing", packed)]

#: The classifier is no SQL: tests compare with a run of the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with Scratch() as own:  # the stage's own tables; runs beside this one have theirs
            stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                own.paths.append(before)  # has been read
            own.release(spark)
        docs, before = spark.read.parquet(path), path
    return docs
