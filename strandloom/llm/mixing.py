"""Operator 5: mixing sources to target weights by temperature.

A source of token share p gets the weight p**a / sum(p**a).  The exponent a between
0 (all alike) and 1 (as they are) is found by bisection, for a target entropy or for
a limit on repetition.  The weights are realised as token budgets: so many whole
epochs of a source and a part of one more, which is cut from a permutation of the
source's blocks (by hash of the document), whole blocks first and single documents
of the one block that the budget's end falls into.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import ensure_checkpoint_dir
from ..operators.sizes import small_side

#: Most epochs of any source when the least used is used once; seed of the permutations.
MAX_EPOCHS, SEED = 1.5, "mix-1"
#: Tokens that a block holds at most, on average; hexadecimal digits of a block's name at least, and of the names that are counted first.
BLOCK_TOKENS, LEAST_DIGITS, FINE_DIGITS = 1 << 24, 2, 6

WORD = r"[^ \t\n\x0B\f\r]+"


def _shares(sizes: dict[int, int], exponent: float) -> tuple[dict[int, float], float]:
    """p**exponent of a source of each size (tokens: number of such sources), and their sum over all sources."""
    total = sum(t * n for t, n in sizes.items())
    raw = {t: (t / total) ** exponent for t in sizes}
    return raw, math.fsum(raw[t] * n for t, n in sizes.items())


def bisect(sizes: dict[int, int], max_epochs: float | None, entropy: float | None) -> float:
    """The least exponent in [0, 1] that keeps to the repetition limit, or the one whose weights have the entropy (nats).

    sizes: the number of sources by their tokens.  Rounded up to 6 places, so that the limit holds.
    """

    def fits(a: float) -> bool:
        raw, scale = _shares(sizes, a)
        w = {t: x / scale for t, x in raw.items()}
        if entropy is not None:
            return -math.fsum(n * w[t] * math.log(w[t]) for t, n in sizes.items()) <= entropy
        use = [w[t] / t for t in sizes]
        return max(use) / min(use) <= max_epochs

    lo, hi = 0.0, 1.0
    if fits(lo):
        return 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return min(1.0, math.ceil(round(hi * 1e6, 3)) / 1e6)


def budget_of(sizes: dict[int, int], max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, total: int | None = None) -> dict[int, int]:
    """Tokens to take from a source of each size; by default as many in all as make the least used source whole."""
    sizes = {t: n for t, n in sizes.items() if t > 0}
    if not sizes:
        return {}
    raw, scale = _shares(sizes, bisect(sizes, max_epochs, entropy))
    w = {t: x / scale for t, x in raw.items()}
    total = max(t / w[t] for t in sizes) if total is None else total
    return {t: int(math.floor(w[t] * total + 0.5)) for t in sizes}


def budgets(tokens: dict[str, int], max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, total: int | None = None) -> dict[str, int]:
    """budget_of by source."""
    by_size = budget_of(Counter(tokens.values()), max_epochs, entropy, total)
    return {s: by_size[t] for s, t in tokens.items() if t > 0}


def _block_key(source: Column, epoch: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), source, epoch.cast("string"), block))


def _digits(tokens: Column) -> Column:
    """Hexadecimal digits of a source's block names: enough for blocks of BLOCK_TOKENS."""
    need = F.ceil(F.round(F.log(16.0, F.greatest(tokens, F.lit(1)) / BLOCK_TOKENS), 9))
    return F.least(F.greatest(need, F.lit(LEAST_DIGITS)), F.lit(FINE_DIGITS)).cast("int")


def mix(
    docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, total: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", as_rows: bool = False,
) -> DataFrame:
    """(doc_id, source, epoch, block_rank) for each use of a document; as_rows: the rows themselves, once for each use.

    epoch counts from 0; block_rank is the document's block's place, from 1, in that
    epoch's permutation of its source.  A source's uses never exceed its budget by a
    token.  Tokens are runs without white space, of texts of any length.  Rows without a source form the source
    of the empty name.  Documents without tokens (null and blank texts) cost nothing: they go with their block,
    and a source that has no tokens at all is used once.  Rows without an id are ordered
    by their text; rows that are there twice are two documents; columns of any type and name are carried along.

    What the driver gets is the number of sources by their token count, from which it
    finds the exponent; weights are realised in the cluster.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if as_rows else F.struct(F.col(id_col).cast("long").alias("doc_id"))
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))))
    # among rows of one key; maps and variants have no hash
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not re.search(r"\b(map|variant)\b", kind)])
    base = docs.select(
        row.alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"), key.alias("key"), tie.alias("tie")
    )
    fine = base.groupBy("source", F.substring("key", 1, FINE_DIGITS).alias("fine")).agg(F.sum("tokens").alias("t")).checkpoint()
    sources = fine.groupBy("source").agg(F.sum("t").alias("t")).checkpoint()
    sizes = {r["t"]: r["n"] for r in sources.groupBy("t").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(t, b // t, b % t) for t, b in budget_of(sizes, max_epochs, entropy, total).items()], "t LONG, whole LONG, part LONG")
    table = small_side(sources.join(plan, "t", "left").select("source", _digits(F.col("t")).alias("digits"), F.coalesce("whole", F.lit(1)).alias("whole"), F.coalesce("part", F.lit(0)).alias("part")))
    # every epoch's permutation of blocks, with the tokens before each block
    order = Window.partitionBy("source", "epoch").orderBy("block_key", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = fine.join(table, "source").groupBy("source", "whole", "part", "digits", F.expr("substring(fine, 1, digits)").alias("block")).agg(F.sum("t").alias("block_tokens"))
    uses = (
        blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        .withColumn("block_key", _block_key(F.col("source"), F.col("epoch"), F.col("block")))
        .withColumn("block_rank", F.row_number().over(order))
        .withColumn("ahead", F.coalesce(F.sum("block_tokens").over(before), F.lit(0).cast("long")))
        .withColumn("room", F.when(F.col("epoch") < F.col("whole"), F.col("block_tokens")).otherwise(F.col("part") - F.col("ahead")))
        .where((F.col("epoch") < F.col("whole")) | ((F.col("part") > 0) & (F.col("room") > 0)))
        .select("source", "block", "epoch", "block_rank", "room", (F.col("room") >= F.col("block_tokens")).alias("full"))
    )
    # one join; the window needs no further exchange, as its keys begin with the join's
    inside = Window.partitionBy("source", "block", "epoch").orderBy("key", "tie")
    named = base.join(table.select("source", "digits"), "source").withColumn("block", F.expr("substring(key, 1, digits)")).drop("digits")
    used = named.join(uses, ["source", "block"]).withColumn("so_far", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = used.where(F.col("full") | (F.col("so_far") <= F.col("room"))).select("row", "source", "epoch", "block_rank")
    if as_rows:
        return out.select("row.*")
    return out.select("row.doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block_rank")
