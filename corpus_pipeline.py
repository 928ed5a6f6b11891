"""The corpus pipeline: documents in, encoded clean documents out.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), works on all its
predecessor kept and returns a DataFrame, which is written as Parquet and reread as the next
stage's documents; all but the last return the columns of documents.

Rows: see the operators for nulls, ties, repeated rows and empty tables; a stage never fails
for them. The sample tables it reads beside the documents (labels, benchmark) may be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontamination, pii, quality_rules, simhash
from shelfmark.llm.common import Numbered, stored, table, workers_find_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by tags."""
    return pii.redacted_documents(docs, pii.fitted(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of every document, their number, and a digest of the text they decode to."""
    workers_find_package(spark)
    numbered = Numbered(docs)
    made = ("n_tokens", "ids", "decoded_sha256")
    return numbered.back(
        numbered.rows.withColumn("bpe", bpe.encoded(F.col(numbered.name("text")))),
        (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.col("bpe.ids").alias("ids"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
        without=("text", *made),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact),
    ("BPE encoding and decoding", encode),
]

#: The first stage's labelling cannot be said in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what the first ones return is written in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
