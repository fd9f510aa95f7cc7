"""Pairing, comparison and set reports (inventory ids D6, D8-D10, D13, D14, G6, I1-I12, B6, B15)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import ensure_checkpoint_dir


def pair_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right for each key."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(True)), right.select(key).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def pair_rows(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left and right rows matched one to one: the n-th of a key with the n-th (D6, A27); columns l, r as structs."""
    a = left.select(key, F.struct(*left.columns).alias("l")).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(f"l.{order}")))
    b = right.select(key, F.struct(*right.columns).alias("r")).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(f"r.{order}")))
    return a.join(b, [key, "__n"], "full_outer").select(key, "l", "r")


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    only = lambda x, y, name: x.select(key).distinct().join(y.select(key), key, "left_anti").select(key, F.lit(name).alias("side"))
    return only(a, b, "not in b").union(only(b, a, "not in a"))


def best_of_cross(queries: DataFrame, references: DataFrame, key: str, q: str, r: str, size: str, least: float) -> DataFrame:
    """(q, best_ratio, pass): the best ratio of sizes, lesser over greater, among references of the same key with another id.

    Of positive sizes only the nearest on either side can be best: a key's references are one row
    for each size, in order, and every size knows the nearest of another id below and above.
    A key with a size that isn't positive, where that order says nothing, has all its pairs compared.
    """
    a, b = queries.select(F.col(key).alias("k"), F.col(q).alias("a"), F.col(size).cast("double").alias("x")), references.select(F.col(key).alias("k"), F.col(r).alias("b"), F.col(size).cast("double").alias("y"))
    odd = a.where("NOT coalesce(x > 0, false)").select("k").union(b.where("NOT coalesce(y > 0, false)").select("k")).distinct()
    ratio = F.try_divide(F.least("x", "y"), F.greatest("x", "y"))
    rest = a.join(odd, "k", "left_semi").join(b, "k").where("a <> b").groupBy("a").agg(F.max(ratio).alias("best_ratio"))
    a, b = a.join(odd, "k", "left_anti"), b.join(odd, "k", "left_anti")
    # sizes of references and queries in one order; has: the references' ids, least and greatest
    points = b.groupBy("k", F.col("y").alias("s")).agg(F.struct(F.col("y").alias("s"), F.min("b").alias("lo"), F.max("b").alias("hi")).alias("has")).unionByName(a.select("k", F.col("x").alias("s")).distinct(), allowMissingColumns=True).groupBy("k", "s").agg(F.max("has").alias("has"))
    one = lambda c: F.when(F.col(f"{c}.lo") == F.col(f"{c}.hi"), F.col(f"{c}.lo"))
    near = points
    for side, order in (("below", F.asc("s")), ("above", F.desc("s"))):
        so_far = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        # the nearest, and the nearest before it that isn't of that one id alone
        near = near.withColumn("__p", F.last("has", ignorenulls=True).over(before))
        turn = F.when(F.col("has").isNotNull() & F.col("__p").isNotNull() & ~one("has").eqNullSafe(one("__p")), F.col("__p.s"))
        near = near.withColumn(side, F.last("has", ignorenulls=True).over(so_far)).withColumn(f"{side}2", F.last(turn, ignorenulls=True).over(so_far)).drop("__p")
    fit = lambda side: F.when(F.coalesce(one(side) == F.col("a"), F.lit(False)), F.col(f"{side}2")).otherwise(F.col(f"{side}.s"))
    low, high = fit("below"), fit("above")
    best = F.greatest(low / F.col("x"), F.col("x") / high)
    found = a.join(near.withColumnRenamed("s", "x"), ["k", "x"]).select("a", best.alias("best_ratio")).where("best_ratio IS NOT NULL")
    return found.union(rest).groupBy("a").agg(F.max("best_ratio").alias("best_ratio")).withColumn("pass", F.col("best_ratio") >= least)


def theta_pairs(rows: DataFrame, key: str, id_col: str, value: str, most: float, places: int | None = None) -> DataFrame:
    """(a, b, ratio): pairs of a key with value_a / value_b below a limit, a <> b, rounded if places are given.

    Values of a key are compared once, whatever the number of rows that have them; the pairs
    of ids are made as they are given out.
    """
    by = rows.groupBy(F.col(key).alias("k"), F.col(value).alias("x")).agg(F.collect_list(id_col).alias("as"))
    ensure_checkpoint_dir(rows.sparkSession)
    by = by.checkpoint()
    ratio = F.col("x") / F.col("y")
    far = by.join(by.withColumnsRenamed({"x": "y", "as": "bs"}), "k").where(ratio < most)
    told = far.select("as", "bs", (ratio if places is None else F.round(ratio, places)).alias("ratio"))
    return told.select(F.explode("as").alias("a"), "bs", "ratio").select("a", F.explode("bs").alias("b"), "ratio").where("a <> b")


def combinations(lists: list[DataFrame]) -> DataFrame:
    """Every combination of one row of each table."""
    out = lists[0]
    for x in lists[1:]:
        out = out.crossJoin(x)
    return out


def far_apart(rows: DataFrame, id_col: str, value: str, fold: float = 10.0) -> DataFrame:
    """(a, b): pairs a < b whose positive values differ by more than a factor.

    Logarithms are the C library's, one for each row, as a database has them: Java's are
    other in the last bit, which decides where values are apart by just the factor.
    """
    def ln(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from (x.map(math.log) for x in batches)

    t = rows.where(F.col(value) > 0).select(F.col(id_col).alias("i"), F.pandas_udf(ln, "double")(F.col(value).cast("double")).alias("v"))
    ensure_checkpoint_dir(rows.sparkSession)
    t = t.checkpoint()
    a, b = t.select(F.col("i").alias("a"), F.col("v").alias("x")), t.select(F.col("i").alias("b"), F.col("v").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).where(F.abs(F.col("x") - F.col("y")) > F.lit(math.log(fold))).select("a", "b")


def arbitrate(scores: DataFrame, id_col: str, include: str, exclude: str, significant: float = 3.0) -> DataFrame:
    """(id, decision): include, exclude or ambiguous, by the ratio of two scores."""
    a, b = F.coalesce(F.col(include).cast("double"), F.lit(0.0)), F.coalesce(F.col(exclude).cast("double"), F.lit(0.0))
    decision = F.when((a == 0) & (b == 0), "none").when(a >= significant * b, "include").when(b >= significant * a, "exclude").otherwise("ambiguous")
    return scores.select(id_col, decision.alias("decision"))


def rescored(score: Column, coverage: Column, mean: Column) -> Column:
    """A score damped by how far the coverage is from the mean, for what is ambiguous."""
    return score / (1 + F.abs(F.log(coverage / mean)))


def labels_kept(tags: DataFrame, factor: float = 3.0) -> DataFrame:
    """(v, db, weight, kept): a vertex keeps its heaviest label and those within a factor of it; none if all weights are <= 0."""
    by = tags.groupBy("v", "db").agg(F.sum("weight").alias("weight"))
    best = F.max("weight").over(Window.partitionBy("v"))
    return by.withColumn("__b", best).select("v", "db", "weight", ((F.col("__b") > 0) & (F.col("weight") * factor >= F.col("__b"))).alias("kept"))


def choose(rows: DataFrame, id_col: str, include: DataFrame | None, exclude: DataFrame | None, include_first: bool, neighbours: DataFrame | None = None) -> DataFrame:
    """Rows by include and exclude lists (column id_col) under a precedence.

    With neighbours (a, b), excluded rows that touch an included one stay.
    """
    out = rows
    if include is not None and exclude is not None:
        exclude = exclude.join(include, id_col, "left_anti") if include_first else exclude
    if neighbours is not None and include is not None and exclude is not None:
        near = neighbours.join(include.select(F.col(id_col).alias("a")), "a", "left_semi").select(F.col("b").alias(id_col)).distinct()
        exclude = exclude.join(near, id_col, "left_anti")
    if exclude is not None:
        out = out.join(exclude.select(id_col), id_col, "left_anti")
    if include is not None:
        keep = include.select(id_col)
        if neighbours is not None:
            keep = keep.union(neighbours.join(keep.select(F.col(id_col).alias("a")), "a", "left_semi").select(F.col("b").alias(id_col))).distinct()
        out = out.join(keep, id_col, "left_semi")
    return out


def top_per_key(rows: DataFrame, keys: list[str], best: list[Column], k: int = 1) -> DataFrame:
    """The k best rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("__n") <= k).drop("__n")


#: Orders for choosing among copies of a region: by mode, of columns len, n_missing and nth.
COPY_ORDER = {
    "first": lambda: [F.asc("nth")], "longest": lambda: [F.desc("len"), F.asc("nth")], "leastN": lambda: [F.asc("n_missing"), F.asc("nth")],
    "leastN_longest": lambda: [F.asc("n_missing"), F.desc("len"), F.asc("nth")],
}


def choose_copy(rows: DataFrame, keys: list[str], mode: str = "leastN_longest") -> DataFrame:
    """One copy of each key; mode "all" keeps every copy."""
    return rows if mode == "all" else top_per_key(rows, keys, COPY_ORDER[mode]())


def joined_parts(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, text): parts in order as one text."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "").alias(text))


def pivot_sum(rows: DataFrame, key: str, column: str, values: list[str], value: str) -> DataFrame:
    """key by column values, given so that no job finds them, with sums; null where there is none."""
    return rows.groupBy(key).pivot(column, values).agg(F.sum(value))
