"""The subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, minhash, mixing, pieces, pii, quality, rlz, sql, suffix, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in repeats of at least 50 words over all documents."""
    return suffix.suffix_array_dedup(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate factors of at least 50 words over all documents."""
    return rlz.substring_dedup(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its class and the number of embeddings at a cosine of at least 0.95."""
    return vectors.near_duplicate_classes(_table(spark, sf_dir, "embeddings"))


def embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 where there is much to find: every embedding, as it is, scaled, and turned by a little."""
    v = F.col("embedding").cast("array<double>")
    turned = F.transform(v, lambda x, i: x + 0.02 * F.get(v, (i + 1) % F.size(v)))
    copies = _table(spark, sf_dir, "embeddings").select(F.explode(F.array(*[F.struct((F.col("vec_id") * 3 + k).alias("vec_id"), e.alias("embedding")) for k, e in enumerate((v, F.transform(v, lambda x: x * 2.5), turned))])).alias("c"))
    return vectors.near_duplicate_pairs(copies.select("c.*"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use of a document in the mixture, sources used between once and 1.5 times."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five sites or more share."""
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, with their scores."""
    return quality.passing(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), with_scores=True)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each page from the rules and its address's class."""
    return urls.url_filter(_table(spark, sf_dir, "pages"))


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 with a table of redirects besides the pages' own links: every fifth page leads to the next one."""
    pages = _table(spark, sf_dir, "pages")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target"))
    redirects = pages.where("page_id % 5 = 0").select("page_id", F.col("url").alias("source")).join(nxt, "page_id").select("source", "target")
    return urls.url_filter(pages, redirects=redirects)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether decoding gives the text again."""
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_pii": op10_pii,
    "embedding_near_copies": embedding_near_copies,
    "url_redirects": url_redirects,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": sql.SUFFIX,
    "op2_substring_dedup": sql.SUBSTRING,
    "op3_embedding_near_dedup": sql.EMBEDDING,
    "embedding_near_copies": sql.NEAR_COPIES,
    "op5_source_mixing": sql.MIXING,
    "op6_line_dedup": sql.LINES,
    "op7_quality_rules": sql.QUALITY,
    "op8_url_filters": sql.url_sql(urls.BLOCK, urls.ALLOW),
    "url_redirects": sql.url_sql(urls.BLOCK, urls.ALLOW, sql.REDIRECTS),
}
