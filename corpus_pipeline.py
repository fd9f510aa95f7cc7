"""A training corpus from raw documents: five operators of strandloom.llm, one after another.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage
before kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import lines, minhash, mixing, pieces, quality
from strandloom.operators.components import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no risk-controlled quality rule rejects; null and empty texts pass, rows that are there twice stay twice."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines, n_chars counted anew.

    A document of which nothing is left goes: all its lines stay in documents of smaller ids.
    """
    clean = lines.line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    A document is its id and text, so of two texts under one id only the one goes that
    is a copy; rows that are there twice stay or go together, and rows without an id stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    ids = docs.select(key.alias("key"), F.col("doc_id").alias("id"), "text")
    groups = minhash.near_duplicate_groups(ids, id_col="key").checkpoint()
    members = groups.join(ids.select("key", "id").where("key IS NOT NULL").distinct(), groups["doc_id"] == F.col("key"))
    first = members.groupBy("group_id").agg(F.min(F.struct("id", "key")).alias("first"))
    copies = members.join(first, "group_id").where(F.struct("id", "key") != F.col("first")).select("id", "key")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    return row.join(copies, ["id", "key"], "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each source is used at least once and at most 1.5 times, so that a document may be there twice.

    Rows without a source are a source of their own; null and empty texts cost nothing and go with their block.
    """
    return mixing.mix(docs, as_rows=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row of the mixture, checked by decoding; a null text has null ids, an empty one none."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can express neither the MinHash groups nor the piece ids; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each result is written as Parquet and read again by the next, and goes when that has been written."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jvm = spark.sparkContext._jvm
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
