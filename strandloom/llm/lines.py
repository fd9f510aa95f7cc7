"""Operator 6: line dedup by the number of distinct sites that show a line.

Each line hash gets a HyperLogLog sketch of its sites, 256 registers that Spark's own
aggregate keeps as packed longs and merges by the greater rank.  A line whose estimate
lies well above or below the threshold is decided by it, and one with fewer occurrences
than sites asked for by that; the others, near the threshold, get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import let
from ..operators.components import ensure_checkpoint_dir
from ..operators.sizes import small_side

#: Distinct sites at which a line is boilerplate; standard errors, and sites at least, that an estimate has to be away from it to decide.
SITES, FAR, LEAST = 5, 4.0, 2
#: The sketch's relative error: 0.07 gives 256 registers, of standard error 0.065.
ERROR = 0.07


def band(sites: int, far: float = FAR) -> tuple[float, float]:
    """Estimates between these, inclusive, are near the threshold.

    A line of ``sites`` sites that only fills registers for an estimate below the band is one
    in a million (5 sites in 2 of 256 registers); one that has an estimate above it
    without having the sites can't be, up to some 20 sites, as each register that isn't
    empty stands for a site.
    """
    away = max(LEAST, far * ERROR * sites)
    return sites - away, sites + away


def line_key(line: Column) -> Column:
    """A line without the spaces around it, as a 64-bit and another 32-bit hash: too many bits for two lines of a corpus to share by chance."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.hash(F.trim(line)).alias("g"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, site, text_key, at, h, g) of all lines that aren't blank, of rows that have an id; at is a line's place in its text."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit(""))).alias("site"), F.xxhash64(text_col).alias("text_key"), F.posexplode(F.split(text_col, "\n")).alias("at", "line")
    )
    return lines.where(F.trim("line") != "").select("id", "site", "text_key", "at", line_key(F.col("line")).alias("key")).select("id", "site", "text_key", "at", "key.h", "key.g")


def _between(parts: Column, gone: Column) -> Column:
    """The elements of parts that aren't at one of the rising places in gone, slice by slice, so that cost is linear."""

    def piece(p: Column, j: Column) -> Column:
        begin = F.when(j == 0, 0).otherwise(F.get(gone, j - 1) + 1)
        end = F.when(j == F.size(gone), F.size(p)).otherwise(F.get(gone, j))
        return F.slice(p, begin + 1, end - begin)

    return let(parts, lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: piece(p, j))))


def judged(lines: DataFrame, sites: int = SITES, far: float = FAR) -> DataFrame:
    """(h, g, first_id, verdict) of the lines that occur often enough: yes or no by the sketch's estimate, near where that can't tell."""
    low, high = band(sites, far)
    guess = F.approx_count_distinct("site", ERROR)
    merged = lines.groupBy("h", "g").agg(guess.alias("guess"), F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= sites)
    return merged.select("h", "g", "first_id", F.when(F.col("guess") < low, "no").when(F.col("guess") > high, "yes").otherwise("near").alias("verdict"))


def boilerplate(docs: DataFrame, sites: int = SITES, far: float = FAR, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h, g, first_id): hashes of the lines seen at that many distinct sites, and the least id that has the line."""
    lines = _lines(docs, id_col, text_col, site_col)
    found = judged(lines, sites, far).where("verdict <> 'no'").checkpoint()
    near = found.where("verdict = 'near'").select("h", "g", "first_id")
    exact = lines.join(small_side(near), ["h", "g"]).groupBy("h", "g", "first_id").agg(F.countDistinct("site").alias("k")).where(F.col("k") >= sites)
    return found.where("verdict = 'yes'").select("h", "g", "first_id").union(exact.select("h", "g", "first_id"))


def line_dedup(docs: DataFrame, sites: int = SITES, far: float = FAR, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The table with boilerplate lines removed from text, and n_removed, the number of lines taken out.

    A line, without the spaces around it, is boilerplate if at least ``sites`` distinct
    sites have it; the document of the least id keeps it, so one copy stays.  Blank lines
    are never removed; the others keep their order and spaces.  A document may end with
    an empty text.  A null text stays null; rows without an id are neither counted nor
    changed; rows without a site count as one site; rows that are there twice stay twice;
    all columns are kept, but for one named n_removed, which is replaced.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bad = boilerplate(docs, sites, far, id_col, text_col, site_col).checkpoint()
    lines = _lines(docs, id_col, text_col, site_col)
    marks = lines.join(small_side(bad), ["h", "g"]).where("id <> first_id").groupBy("id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("__gone")).select(F.col("id").alias("__id"), F.col("text_key").alias("__of"), "__gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__key"), F.xxhash64(F.col(text_col)).alias("__text_key"))
    joined = row.join(marks, (F.col("__key") == F.col("__id")) & (F.col("__text_key") == F.col("__of")), "left")
    kept = _between(F.split(F.col(f"__row.`{text_col}`"), "\n"), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(f"__row.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("int")
    same = [F.col(f"__row.`{c}`").alias(c) if c != text_col else text.alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*same, removed.alias("n_removed"))
