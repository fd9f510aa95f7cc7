"""Operator 7: quality rules with risk-controlled thresholds.

A rule rejects a document whose score reaches its cutoff.  For each stratum (a
language) and rule, a cutoff from a fixed grid is used only if labelled holdout
documents prove it: the exact binomial chance of seeing so few good documents
rejected, were the true rate above the limit, must be at most delta over the number
of all tests (Bonferroni).  Of the proven cutoffs the one that rejects most labelled
bad documents is taken, and among equals the most lenient.  The limit of a stratum is
shared out to its rules, so with confidence 1 - delta no stratum loses more than
alpha of its good documents.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import flat, repeats

#: Greatest share of good documents of a stratum that may be rejected, and the chance that any stratum breaks it.
ALPHA, DELTA = 0.1, 0.1
#: The cutoffs that are tested, by rule.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (0.03, 0.04, 0.06, 0.08, 0.12),
    "capitals": (0.3, 0.4, 0.5, 0.6, 0.7),
    "stutter": (0.1, 0.2, 0.3, 0.4, 0.5),
}
#: Characters that the rule symbols counts.
SYMBOLS = "*$#%&|!~^=<>{}[]_@+"


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _UPPER, _ALPHA = _table(SYMBOLS), _table(string.ascii_uppercase), _table(string.ascii_letters)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Score of each rule for each text, 0 for null and empty ones.

    symbols: share of characters that are SYMBOLS; capitals: share of capitals among
    letters (A-Z, Latin-1); stutter: share of words, as split at single spaces, that
    equal the one before.
    """
    out = {rule: np.zeros(len(texts)) for rule in GRID}
    for chunk in flat.chunks(texts):
        data, bound, rows = chunk.data, chunk.row_start, chunk.rows
        after = data[1:][data[:-1] == 0xC3]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        alpha, upper = _ALPHA[data], _UPPER[data]
        alpha[latin] = (after != 0x97) & (after != 0xB7)
        upper[latin] = (after <= 0x9E) & (after != 0x97)
        count = lambda mask: np.diff(np.append(0, np.cumsum(mask))[bound])
        share = lambda a, b: a / np.maximum(b, 1)
        out["symbols"][rows] = share(count(_SYMBOL[data]), count((data & 0xC0) != 0x80))
        out["capitals"][rows] = share(count(upper), count(alpha))
        # words: between single spaces and the rows' bounds
        space = np.flatnonzero(data == 32)
        row = np.searchsorted(bound, space, side="right") - 1
        order = np.argsort(np.concatenate([np.arange(len(rows)), row]), kind="stable")
        owner = np.concatenate([np.arange(len(rows)), row])[order]
        start = np.concatenate([bound[:-1], space + 1])[order]
        last = np.append(owner[1:] != owner[:-1], True)
        end = np.where(last, bound[owner + 1], np.append(start[1:] - 1, 0))
        word = flat.ranges_hash(data.astype(np.uint64) + np.uint64(1), start, end)
        twice = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
        out["stutter"][rows] = share(np.bincount(owner[twice], minlength=len(rows)), np.bincount(owner, minlength=len(rows)))
    return out


def scores(text: Column) -> Column:
    """The scores of a text column as a struct, one field for each rule; other columns stay in the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        flat.release()
        return pa.StructArray.from_arrays([pa.array(found[rule]) for rule in GRID], names=list(GRID))

    # said to be non-deterministic, so that the planner doesn't evaluate it again in a filter
    return F.arrow_udf(run, StructType([StructField(rule, DoubleType()) for rule in GRID])).asNondeterministic()(text)


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X of n draws with chance p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def _scored(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(row, id, stratum, one column for each rule)."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        scores(F.col(text_col).cast("string")).alias("score"),
    ).select("row", "id", "stratum", "score.*")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(stratum, quality, one column for each rule) of the labelled documents; only those are scored."""
    told = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)").distinct()
    some = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    # scored where they are, so that no text is shuffled, and by the worker that picks them; rows that the bitmap lets through by chance go in the join
    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[rule]) for rule in GRID)], names=["id", "stratum", *GRID])

    scored = repeats.only_named(some, ["id"], told, ["id"], score, ", ".join(["id LONG", "stratum STRING", *(f"{rule} DOUBLE" for rule in GRID)]))
    return scored.join(told, "id").select("stratum", "quality", *GRID)


def cutoffs(scored: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """The chosen cutoff by (stratum, rule) from labelled(); none where nothing is proven.

    What comes to the driver are counts by stratum, rule and cutoff.
    """
    tests = [(rule, cut) for rule, grid in GRID.items() for cut in grid]
    hit = [F.sum(F.when(F.col(rule) >= cut, 1).otherwise(0)).alias(f"t{j}") for j, (rule, cut) in enumerate(tests)]
    rows = scored.groupBy("stratum", "quality").agg(F.count("*").alias("n"), *hit).collect()
    good = {r["stratum"]: r for r in rows if r["quality"] == 1}
    bad = {r["stratum"]: r for r in rows if r["quality"] == 0}
    level, limit = delta / max(1, len(good) * len(tests)), alpha / len(GRID)
    chosen: dict[tuple[str, str], tuple] = {}
    for stratum, r in good.items():
        for j, (rule, cut) in enumerate(tests):
            k, n = r[f"t{j}"], r["n"]
            caught = bad[stratum][f"t{j}"] if stratum in bad else 0
            if k < n * limit and caught and tail(k, n, limit) <= level:
                chosen[stratum, rule] = max(chosen.get((stratum, rule), (-1, 0.0)), (caught, cut))
    return {key: cut for key, (_, cut) in chosen.items()}


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", with_scores: bool = False) -> DataFrame:
    """The documents that no rule rejects; all columns as they are, with_scores the rules' scores beside the id alone.

    Documents without a stratum form the stratum of the empty name; a stratum without
    enough labels rejects nothing.  Null and empty texts pass.  Labels without an id or
    with a quality other than 0 and 1 are ignored, repeated ones count once, and a
    document labelled both ways counts on both sides.  Rows that are there twice stay twice, texts of any length are scored whole,
    and other columns, whatever their names, are carried along.
    """
    scored = _scored(docs, id_col, text_col, stratum_col)
    chosen = cutoffs(labelled(docs, labels, id_col, text_col, stratum_col), alpha, delta)
    reject = F.lit(False)
    for (stratum, rule), cut in sorted(chosen.items()):
        reject = reject | ((F.col("stratum") == stratum) & (F.col(rule) >= cut))
    kept = scored.where(~reject) if chosen else scored
    if with_scores:
        return kept.select(F.col("id").alias("doc_id"), F.col("stratum").alias("lang"), *[F.round(rule, 6).alias(rule) for rule in GRID])
    return kept.select("row.*")
