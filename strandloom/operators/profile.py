"""Aggregates that describe a table of rows (inventory ids E1-E19, G7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strings
from .components import ensure_checkpoint_dir
from .sizes import small_side

#: Quality encodings: name, least and greatest character, offset of score 0.
ENCODINGS = (("sanger", 33, 73, 33), ("solexa", 59, 104, 64), ("illumina_1_3", 64, 104, 64), ("illumina_1_5", 67, 105, 64), ("illumina_1_8", 33, 74, 33))


def trimmed_length(s: Column, char: str = "N") -> Column:
    """Length without leading and trailing fill characters."""
    return F.length(F.regexp_replace(s, f"^{char}+|{char}+$", ""))


def length_profile(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """(keys, mean_len, max_len, n)."""
    return rows.groupBy(*keys).agg(F.avg(length).alias("mean_len"), F.max(length).alias("max_len"), F.count("*").alias("n"))


def every_kth(rows: DataFrame, k: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Systematic sample: every k-th row of a key in the given order.

    Without keys the rows are numbered within ranges of the order, so no single task
    holds the table: ranges are counted first and each starts at its offset.
    """
    if keys:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("__n", n).where(F.col("__n") % k == 0).drop("__n")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # written once: ranges are made from a sample, and made again they need not be the same
    ensure_checkpoint_dir(rows.sparkSession)
    part = ranged.withColumn("__part", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND((1 << 33) - 1)).checkpoint()
    sizes = part.groupBy("__part").agg(F.count("*").alias("c")).withColumn("__before", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(sizes, "__part").where((F.col("__before") + F.col("__i") + 1) % k == 0).select(*rows.columns)


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key (B2, I4)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def char_counts(rows: DataFrame, keys: list[str], s: Column) -> DataFrame:
    """(keys, c, n): occurrences of each character; partial aggregates leave alphabets to be shuffled."""
    chars = rows.select(*keys, F.explode(strings.characters(s)).alias("c"))
    return chars.groupBy(*keys, "c").agg(F.count("*").alias("n"))


def char_profile(counts: DataFrame, keys: list[str], low: str) -> DataFrame:
    """(keys, min_ch, max_ch, low_share): range of characters by code, and the share of those below one."""
    code = F.ascii("c")
    return counts.groupBy(*keys).agg(F.min(code).alias("min_ch"), F.max(code).alias("max_ch"), (F.sum(F.when(code < ord(low), F.col("n")).otherwise(0)) / F.sum("n")).alias("low_share"))


def encoding_of(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, encoding, offset): the encoding whose range is nearest, the first on ties."""
    options = F.array(*[F.struct((F.pow(F.col("min_ch") - lo, 2) + F.pow(F.col("max_ch") - hi, 2)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("encoding"), F.lit(off).alias("offset")) for i, (name, lo, hi, off) in enumerate(ENCODINGS)])
    return profile.withColumn("best", F.array_min(options)).select(*keys, "best.encoding", "best.offset")


def error_probability(score: Column, encoding: str = "sanger") -> Column:
    """Chance of an error from a quality score."""
    odds = F.pow(F.lit(10.0), -score / 10)
    return odds / (1 + odds) if encoding == "solexa" else odds


def mean_error(counts: DataFrame, keys: list[str], offset: int = 33, encoding: str = "sanger") -> DataFrame:
    """(keys, error): mean error chance over all characters."""
    return counts.groupBy(*keys).agg((F.sum(error_probability(F.ascii("c") - offset, encoding) * F.col("n")) / F.sum("n")).alias("error"))


def trim_characters(counts: DataFrame, keys: list[str], limit: float, least_score: int = 1, offset: int = 33) -> DataFrame:
    """(keys, c): the lowest quality characters, up to a score, while their share of all keeps to a limit."""
    by = Window.partitionBy(*keys).orderBy(F.ascii("c"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    share = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) / total
    return counts.withColumn("__share", share).where((F.col("__share") <= limit) & (F.ascii("c") - offset <= least_score)).select(*keys, "c")


def quality_parts(s: Column, quality: Column, low: str, least: int) -> Column:
    """Parts of s longer than least between runs of low quality characters, a character class such as '!"#' (B3, M6)."""
    marked = strings.characters(F.regexp_replace(quality, f"[{low}]", "\u0000"))
    keep = F.zip_with(strings.characters(s), marked, lambda c, q: F.when(q == "\u0000", F.lit("\n")).otherwise(c))
    return F.filter(F.split(F.array_join(keep, ""), "\n+"), lambda x: F.length(x) > least)


def dedup_clusters(rows: DataFrame, id_col: str, canonical: Column) -> DataFrame:
    """(rep_id, n_members): rows with equal canonical text, under their least id.

    Grouping is by the text's 128 bits of hash, so that long texts aren't shuffled.
    """
    key = [F.xxhash64(canonical).alias("h1"), F.xxhash64(canonical, F.lit(1)).alias("h2")]
    return rows.select(F.col(id_col).alias("id"), *key).groupBy("h1", "h2").agg(F.min("id").alias("rep_id"), F.count("*").alias("n_members")).select("rep_id", "n_members")


def dedup_members(rows: DataFrame, id_col: str, canonical: Column) -> DataFrame:
    """(id, rep_id) of every row."""
    hashed = rows.select(F.col(id_col), F.xxhash64(canonical).alias("h1"), F.xxhash64(canonical, F.lit(1)).alias("h2"))
    reps = hashed.groupBy("h1", "h2").agg(F.min(id_col).alias("rep_id"))
    return hashed.join(reps, ["h1", "h2"]).select(id_col, "rep_id")


def weighted_mean_std(rows: DataFrame, keys: list[str], x: Column, w: Column) -> DataFrame:
    """(keys, wmean, wstd): population statistics under weights.

    Two aggregates: deviations are from the mean itself, so that nothing cancels out.
    """
    t = rows.select(*keys, x.cast("double").alias("x"), w.cast("double").alias("w"))
    mean = t.groupBy(*keys).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("wmean"))
    # a key's rows stay where they are where the means are few
    joined = t.join(small_side(mean), keys) if keys else t.crossJoin(F.broadcast(mean))  # without keys the mean is one row
    return joined.groupBy(*keys, "wmean").agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("x") - F.col("wmean"), 2)) / F.sum("w")).alias("wstd"))


def band_profile(rows: DataFrame, keys: list[str], x: Column, g: float) -> DataFrame:
    """(keys, low, mean, high): the mean of a band below the top of each key's values, and a deviation down and up from it.

    The band is ranks [floor((1-g-g/2)n), floor((1-g/2)n)), counted from 0 in rising order.
    Deviations are over the band's size and clamped to the band's range, all to 2 places.
    """
    by = Window.partitionBy(*keys).orderBy("__x")
    ranked = rows.select(*keys, x.cast("double").alias("__x")).withColumn("__r", F.row_number().over(by) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    lower, upper = (1 - g) - g / 2, (1 - g) + g / 2
    band = ranked.where((F.col("__r") >= F.floor(F.col("__n") * F.lit(lower))) & (F.col("__r") < F.floor(F.col("__n") * F.lit(upper)))).select(*keys, "__x")
    mean = band.groupBy(*keys).agg(F.avg("__x").alias("__m"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("__k"))
    off = F.pow(F.col("__x") - F.col("__m"), 2)
    below, above = F.col("__x") < F.col("__m"), F.col("__x") > F.col("__m")
    dev = band.join(mean, keys).groupBy(*keys, "__m", "__lo", "__hi", "__k").agg(F.sum(F.when(below, off).otherwise(0.0)).alias("__d"), F.sum(F.when(above, off).otherwise(0.0)).alias("__u"))
    down, up = F.sqrt(F.col("__d") / F.col("__k")), F.sqrt(F.col("__u") / F.col("__k"))
    return dev.select(*keys, F.round(F.greatest(F.col("__m") - down, F.col("__lo")), 2).alias("low"), F.round("__m", 2).alias("mean"), F.round(F.least(F.col("__m") + up, F.col("__hi")), 2).alias("high"))


def weight_trimmed_range(rows: DataFrame, keys: list[str], x: Column, weight: Column, order: list[str], drop_low: float = 0.1, drop_high: float = 0.4) -> DataFrame:
    """(keys, lo, mean, hi) after trimming the lowest and highest shares of x*weight.

    lo and hi are one deviation from the weighted mean, kept in the remaining range of x.
    """
    mass = F.col("x") * F.col("w")
    t = rows.select(*keys, *order, x.cast("double").alias("x"), weight.cast("double").alias("w")).where(mass.isNotNull())
    # rows are ranged by key and order, so that a key is many tasks' work: sums within a task's range first, then of the ranges before it
    ranged = t.repartitionByRange(*keys, "x", *order).sortWithinPartitions(*keys, "x", *order).select(*keys, "x", "w", F.spark_partition_id().alias("__part"), F.xxhash64(*keys).alias("__key"))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, so_far = None, 0.0
        for b in batches:
            k, m = b["__key"].to_numpy(), (b["x"] * b["w"]).to_numpy()
            upto = np.empty(len(m))
            begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
            for lo, hi in zip(begins, [*begins[1:], len(k)], strict=True):
                so_far = so_far if k[lo] == key else 0.0
                upto[lo:hi] = so_far + np.cumsum(m[lo:hi])
                key, so_far = k[lo], upto[hi - 1]
            yield b.assign(__upto=upto)[[*names, "__upto"]]

    ensure_checkpoint_dir(rows.sparkSession)
    names = [c for c in ranged.columns if c != "__key"]
    kinds = ", ".join(f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in names)
    # written once: ranges are made from a sample, and made again they need not be the same
    summed = ranged.mapInPandas(running, f"{kinds}, __upto DOUBLE").checkpoint()
    parts = summed.groupBy(*keys, "__part").agg(F.sum(mass).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = small_side(parts.select(*keys, "__part", before.alias("__before"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("total")))
    upto = F.col("__before") + F.col("__upto")
    kept = summed.join(parts, [*keys, "__part"]).where((upto > F.col("total") * drop_low) & (upto - mass < F.col("total") * (1 - drop_high)))
    stats = weighted_mean_std(kept, keys, F.col("x"), F.col("w"))
    ends = kept.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return stats.join(ends, keys).select(*keys, F.greatest(F.col("a"), F.col("wmean") - F.col("wstd")).alias("lo"), F.col("wmean").alias("mean"), F.least(F.col("b"), F.col("wmean") + F.col("wstd")).alias("hi"))


def grouping_stats(rows: DataFrame, outer: str, inner: str, x: str) -> DataFrame:
    """(outer, inner, mean, std) by both keys and by the inner one alone, where outer is null."""
    return rows.groupingSets([[F.col(outer), F.col(inner)], [F.col(inner)]], F.col(outer), F.col(inner)).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def mapped_counts(hits: DataFrame, name: str = "name", paired: str = "is_paired", mapped: str = "is_mapped") -> DataFrame:
    """One row (paired, single): queries with a mapped record, both mates or one."""
    by = hits.groupBy(name).agg(F.max(F.col(mapped) & F.col(paired)).alias("p"), F.max(F.col(mapped)).alias("m"))
    return by.agg(F.count_if("p").alias("paired"), F.count_if(F.col("m") & ~F.col("p")).alias("single"))


def draft_size(vertices: DataFrame) -> DataFrame:
    """One row (size, single_share) from (len, overlap, copy)."""
    return vertices.agg(F.sum((F.col("len") - F.col("overlap")) * F.col("copy")).alias("size"), (F.sum(F.when(F.col("copy") == 1, F.col("len")).otherwise(0)) / F.sum("len")).alias("single_share"))


def reduce_by_gcd(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """rows with x divided by its key's greatest common divisor."""
    gcd = rows.groupBy(*keys).agg(F.collect_set(x).alias("__xs")).withColumn("__g", strings.gcd_of(F.col("__xs"))).drop("__xs")
    return rows.join(gcd, keys).withColumn(x, (F.col(x) / F.col("__g")).cast("long")).select(*rows.columns)


def with_hash(rows: DataFrame, content: str, registry: DataFrame) -> DataFrame:
    """rows with sha256 and the registry's type and version of that content, null where unknown."""
    return rows.withColumn("sha256", F.sha2(content, 256)).join(registry, "sha256", "left")


def numbered_labels(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """rows with name: the label, with its number where the label is there more than once."""
    w = Window.partitionBy(label)
    return rows.withColumn("name", F.when(F.count("*").over(w) > 1, F.concat_ws("-", label, F.row_number().over(w.orderBy(*order)))).otherwise(F.col(label)))
