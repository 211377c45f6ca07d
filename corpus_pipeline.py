"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

    quality rules -> line dedup -> near-duplicates -> mixing -> packing

All but the last return the columns of ``documents``. Every stage has its own account of nulls, empty texts and repeated
rows in the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.llm.common import apart, table, written
from moneytrail.llm.line_runs import line_dedup
from moneytrail.llm.mixing import mixture
from moneytrail.llm.near_shingles import one_of_each
from moneytrail.llm.packing import pack
from moneytrail.llm.quality import quality_filter

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the adaptive rules reject."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of repeated runs of lines out of the texts; ``n_chars`` follows. A document whose lines are all
    copies stays with an empty text."""
    cleaned = apart(docs, ["dedup"], line_dedup)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast(docs.schema["n_chars"].dataType)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of every group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture, whose weights flatten the sizes of the sources."""
    return apart(docs, ["mixed"], mixture)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, length, bin, start)``: where every piece of every document stands in sequences of 2048 words,
    which follow one another as the slots of the mixture do."""
    return pack(docs, CAPACITY, mixed=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("mixing", mixed),
          ("packing", packed)]

#: Packing is sequential, so there is no SQL for the rows; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
