"""Corpus pipeline: toxicity, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives no rows; other columns are carried along by all stages but the last.
Null and empty texts score 0, lose no line, are nobody's copy, hold no personal data and are packed as the end id alone,
so they stay to the end. Rows with a null doc_id are never learnt from, lose no line and are nobody's copy. Rows that
repeat a doc_id are scored, masked and packed one by one; a line number goes in all of them if it goes in one; of near
copies the rows with the smallest doc_id stay, another text under the same doc_id is judged on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrid.llm import line_dedup, ngram_jaccard, packing, pii, toxicity
from sitegrid.llm.common import table
from sitegrid.storage import new_folder, released, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from this stage's own documents and the labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line resembles."""
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return ngram_jaccard.first_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence; idle workers hold no chunks, as other stages use them too."""
    return packing.pack(docs, remember=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard", drop_near_duplicates), ("pii", mask_pii), ("packing", pack)]

#: Learnt scores, hashing tokenisers and bin packing can't be said in SQL; each stage is tested against plain Python on its predecessor's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one written to the shared folder and read again."""
    root = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with released(spark):
            out.write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}_{name}")
        if k:
            remove(spark, f"{root}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
