"""A corpus pipeline: language, repeated lines, near duplicates, mix of sources, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's rows as Parquet into the shared folder and reads
them again for the next. The last stage's tokenizer has no SQL, so ORACLE_SQL is None; tests compare each stage with
a brute-force version of its own.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables, and columns beyond those of
documents, whatever their names; what it does with them is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.jaccard import jaccard_components
from helixframe.llm.language import Mixture, keep_identified, train
from helixframe.llm.lines import dedup_lines
from helixframe.llm.mixing import mix_sources
from helixframe.llm.packing import pack_documents
from helixframe.llm.storage import documents, materialize


def _own(*names: str) -> tuple[str, ...]:
    """Column names that no input has."""
    return tuple(f"{n}_{uuid.uuid4().hex}" for n in names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from all labelled rows; documents without letters or in which no language holds half of the text go.

    Null and empty texts have no letters. Repeated rows are judged alike. Without any label only documents without letters
    go. An empty table gives an empty one.
    """
    return keep_identified(docs, Mixture.collect(train(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; a document with nothing left goes. n_chars is counted anew where lines went.

    Earlier means a smaller doc_id, and for equal ones a smaller hash of the text; rows equal in both keep the same lines.
    Rows with a null doc_id or text stay as they are.
    """
    lines, deleted = _own("n_lines", "n_deleted")
    kept = dedup_lines(docs, counts=(lines, deleted)).where((F.col(deleted) == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col(deleted) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by links (word 5-grams, Jaccard similarity of 0.8 or more, none lost), the one with the smallest doc_id stays.

    Equal sets link; texts without words, null or empty, link with nothing and stay. Rows with one doc_id stay or go
    together, so repeated rows of the smallest doc_id all stay. Rows with a null doc_id stay.
    """
    found = jaccard_components(docs, words=5, num=80, den=100)
    gone = found.where("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: sources by code point weigh 5, 2, 1, repeating, and share 150 % of all words, up to twice a source's own.

    Null texts have no words; null is a source; rows with one doc_id are taken equally often. A source without words gives nothing.
    """
    added = _own("mix_size", "source_size", "target", "times")
    mixed = mix_sources(docs, added=added).where(F.col(added[3]) > 0)
    return mixed.withColumn(added[3], F.explode(F.array_repeat(F.lit(1), F.col(added[3])))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 2048 tokens. A null or empty text is one token; repeated rows and null ids are documents of their own."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
