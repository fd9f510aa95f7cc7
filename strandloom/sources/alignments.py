"""Alignment tables: SAM and BLAST tabular (inventory ids A7-A10, E11, F4, F5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_sam(spark: SparkSession, path: str, real_lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """refs (ref, index_len, real_len) and hits, one record a row.

    real_lengths (ref, real_len) overrides header lengths; positions of a padded circular
    reference are brought back by (pos - 1) mod real_len + 1.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("@SQ"))
    refs = head.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("ref"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("index_len"))
    refs = refs.join(real_lengths, "ref", "left").select("ref", "index_len", F.coalesce("real_len", "index_len").alias("real_len")) if real_lengths is not None else refs.withColumn("real_len", F.col("index_len"))
    c = lines.where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    tag = lambda t: F.struct(F.substring_index(t, ":", 1).alias("key"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("value"))
    tags = F.when(F.size("c") > 11, F.map_from_entries(F.transform(F.slice("c", 12, 10_000), tag))).otherwise(F.create_map().cast("map<string,string>"))
    flag = at(1).cast("int")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    hits = c.select(
        at(0).alias("name"), flag.alias("flag"), at(2).alias("ref"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"), at(7).cast("long").alias("pnext"), at(8).cast("long").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), tags.alias("tags"),
        bit(1).alias("is_paired"), (~bit(4)).alias("is_mapped"), (~bit(8)).alias("is_next_mapped"), bit(16).alias("is_reversed"), (~bit(128)).alias("is_first"),
    )
    hits = hits.join(refs.select("ref", "real_len"), "ref", "left").withColumn("pos", F.when(F.col("real_len").isNotNull() & (F.col("pos") > 0), F.pmod(F.col("pos") - 1, F.col("real_len")) + 1).otherwise(F.col("pos"))).drop("real_len")
    return refs, hits


def sam_heads(hits: DataFrame) -> DataFrame:
    """(name, mate), distinct; the mate is told by the mate bits, not the strand."""
    mate = F.when(F.col("flag").bitwiseAND(F.lit(0x80)) != 0, 2).otherwise(1)
    return hits.select("name", mate.alias("mate")).distinct()


def cigar_parts(cigar: Column) -> Column:
    """ARRAY<STRUCT<len, op>> of a CIGAR text."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def md_parts(md: Column) -> Column:
    """Tokens of an MD tag: run lengths, mismatched bases, deletions such as ^AC."""
    return F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))


def aligned_blocks(hits: DataFrame, best: bool = True) -> DataFrame:
    """(ref, op, lo, hi): reference ranges, 1-based and closed, of the operations of mapped records.

    With best, one record of each read: the highest mapping quality, the least place on
    ties. M, =, X, D and N take up reference positions; I and S are put on the site before them.
    """
    rows = hits.where("is_mapped")
    if best:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("name", "is_first").orderBy(F.desc("mapq"), "ref", "pos"))).where("__n = 1")
    begin = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<op:string,lo:bigint,hi:bigint>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        moves = p["op"].isin("M", "=", "X", "D", "N")
        lo = F.when(moves, a["at"]).otherwise(F.greatest(a["at"] - 1, F.lit(1).cast("long")))
        hi = F.when(moves, a["at"] + p["len"] - 1).otherwise(lo)
        block = F.struct(p["op"].alias("op"), lo.alias("lo"), hi.alias("hi"))
        return F.struct((a["at"] + F.when(moves, p["len"]).otherwise(0)).alias("at"), F.array_append(a["out"], block).alias("out"))

    return rows.select("ref", F.explode(F.aggregate(cigar_parts(F.col("cigar")), begin, step)["out"]).alias("b")).select("ref", "b.op", "b.lo", "b.hi")


def covered(blocks: DataFrame) -> DataFrame:
    """The blocks that count as depth: M, = and X."""
    return blocks.where(F.col("op").isin("M", "=", "X")).select("ref", "lo", "hi")


def mismatches(hits: DataFrame) -> DataFrame:
    """(ref, op, lo, hi) with op X for every mismatched base that an MD tag tells.

    The tag is read token by token: a number goes on by so many positions, a deletion by
    its bases, and a letter is one mismatch.
    """
    begin = F.struct(F.col("pos").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        size = F.when(p.rlike("^[0-9]+$"), p.try_cast("long")).when(p.startswith("^"), F.length(p) - 1).otherwise(1)
        return F.struct((a["at"] + size).alias("at"), F.when(p.rlike("^[A-Za-z]$"), F.array_append(a["out"], a["at"])).otherwise(a["out"]).alias("out"))

    rows = hits.where("is_mapped").withColumn("md", F.try_element_at("tags", F.lit("MD"))).where("md IS NOT NULL")
    at = rows.select("ref", F.explode(F.aggregate(md_parts(F.col("md")), begin, step)["out"]).alias("p"))
    return at.select("ref", F.lit("X").alias("op"), F.col("p").alias("lo"), F.col("p").alias("hi"))


def operation_statistics(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, op, mean, std): depth of each operation over a reference's positions, and over all of them where ref is null.

    blocks: (ref, op, lo, hi); refs: (ref, real_len). Positions without the operation count
    as 0; depths come as runs, so sums are over runs and not over positions.
    """
    from ..operators.intervals import depth

    runs = depth(blocks.join(refs.select("ref"), "ref", "left_semi"), ["ref", "op"])
    n = F.col("hi") - F.col("lo") + 1
    by = runs.groupBy("ref", "op").agg(F.sum(F.col("depth") * n).alias("s"), F.sum(F.col("depth") * F.col("depth") * n).alias("q"))
    # an operation that a reference lacks still has its positions
    whole = refs.select("ref", "real_len").join(by.select("op").distinct()).join(by, ["ref", "op"], "left")
    sums = whole.groupingSets([[F.col("ref"), F.col("op")], [F.col("op")]], F.col("ref"), F.col("op")).agg(F.sum(F.coalesce("s", F.lit(0))).alias("s"), F.sum(F.coalesce("q", F.lit(0))).alias("q"), F.sum("real_len").alias("n"))
    mean = F.col("s") / F.col("n")
    return sums.select("ref", "op", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def error_rates(statistics: DataFrame) -> DataFrame:
    """(ref, error): mismatches, insertions and deletions over matches."""
    of = lambda *ops: F.sum(F.when(F.col("op").isin(*ops), F.col("mean")).otherwise(0.0))
    return statistics.groupBy("ref").agg((of("X", "I", "D") / of("M", "=")).alias("error"))


BLAST = "query STRING, subject STRING, pident DOUBLE, length INT, mismatch INT, gapopen INT, qstart LONG, qend LONG, sstart LONG, send LONG, evalue DOUBLE, bitscore DOUBLE"


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits, with qlo and qhi in rising order (A10)."""
    return spark.read.csv(path, sep="\t", schema=BLAST, comment="#").withColumn("qlo", F.least("qstart", "qend")).withColumn("qhi", F.greatest("qstart", "qend"))
