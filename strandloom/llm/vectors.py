"""Operator 3: near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c).  A hash is
the floor of a Gaussian projection, shifted and divided by the bucket width; K of
them make a table's key, and L tables are used.  Candidates of all tables are
checked by the exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, ensure_checkpoint_dir
from . import blocks, flat

#: Least cosine of a pair; width of a projection's buckets; share of the pairs at the threshold that the tables are planned to find.
THRESHOLD, WIDTH, RECALL, SEED = 0.95, 2.0, 0.99, 20240101


def collision(distance: float, width: float) -> float:
    """Chance that two points so far apart share one projection's bucket."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """(K, L): about one unrelated (orthogonal) neighbour in a bucket, and the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the vectors that aren't null, their values as one array, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    taken = column.take(pa.array(rows))
    values = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = taken.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, values, size


def normalised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (float64) of the vectors of length dim that are finite and not zero."""
    rows, values, size = _values(column)
    begin = np.cumsum(size) - size
    fit = size == dim
    rows = rows[fit]
    v = values[(begin[fit][:, None] + np.arange(dim)).ravel()].reshape(-1, dim) if len(rows) else np.zeros((0, dim))
    norm = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], v[good] / norm[good, None]


def _rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL")


#: Vectors that hold something and no null.
_FIT = "v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)"


def _compared(table: DataFrame, threshold: float, width: float, recall: float, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Vectors by name, (x, y), with their rows: members (x, y, id); pairs of unlike vectors found near, (a, ya, b, yb, cosine), each once; those that several rows have, paired with themselves."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    n = blocks.partitions(spark)
    rows = _rows(table, id_col, vector_col).where(_FIT)
    # a vector's name: two hashes of its values
    named = rows.select("id", "v", F.xxhash64("v").alias("x"), F.hash("v").alias("y"))
    members = named.select("x", "y", "id").distinct().checkpoint()
    one = named.dropDuplicates(["x", "y"]).select("x", "y", "v")
    plans = {r["d"]: plan(r["n"], threshold, width, recall) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not plans:
        return None

    def hashed(batches):
        made = {}
        box = blocks.Outbox(n)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(_values(batch.column(2))[2]).tolist():
                k, tables = plans[dim]
                if dim not in made:
                    rng = np.random.default_rng((SEED, dim))
                    made[dim] = rng.standard_normal((dim, k * tables)), rng.random(k * tables) * width
                direction, shift = made[dim]
                row, v = normalised(batch.column(2), dim)
                cell = np.floor((v @ direction + shift) / width).astype(np.int64).view(np.uint64).reshape(len(row), tables, k)
                key = np.broadcast_to(flat.mix(np.arange(1, tables + 1, dtype=np.uint64) * flat.BASE + np.uint64(dim)), (len(row), tables)).copy()
                for j in range(k):
                    key = flat.mix(key ^ cell[:, :, j]) * flat.BASE
                key = flat.mix(key).ravel()
                yield from box.add(blocks.by_hash(key, n), key, np.repeat(ids[row], tables))
        yield from box.flush()

    def paired(batches):
        box = blocks.Outbox(n)
        key, ids = blocks.gather(batches, ["<u8", "<i8"])
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        # the i-th of a bucket with each later one, a stretch of rows at a time
        last = np.searchsorted(key, key, side="right")
        more = last - np.arange(len(key)) - 1
        done = np.append(0, np.cumsum(more))
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + 1_000_000, side="right")) - 1)
            a = np.repeat(ids[lo:hi], more[lo:hi])
            b = ids[flat.spans(np.arange(lo, hi) + 1, more[lo:hi])]
            apart = a != b
            pairs = np.unique(np.stack([a[apart], b[apart]]), axis=1)
            yield from box.add(blocks.by_id(pairs[0], n), pairs[0], pairs[1])
            lo = hi
        yield from box.flush()

    def distinct(batches):
        a, b = blocks.gather(batches, ["<i8", "<i8"])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        for lo in range(0, len(a), 50_000):
            yield pa.record_batch([pa.array(a[lo : lo + 50_000]), pa.array(b[lo : lo + 50_000])], names=["a", "b"])

    def exact(batches):
        for batch in batches:
            size = _values(batch.column(4))[2]
            alike = size == _values(batch.column(5))[2]
            for dim in np.unique(size[alike]).tolist():
                part = batch.filter(pa.array(alike & (size == dim)))
                (i, u), (j, v) = normalised(part.column(4), dim), normalised(part.column(5), dim)
                both = np.intersect1d(i, j)
                u, v = u[np.isin(i, both)], v[np.isin(j, both)]
                cosine = (u * v).sum(axis=1)
                near = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(both)).filter(near) for c in range(4)), pa.array(np.round(cosine, 6)).filter(near)], names=["a", "ya", "b", "yb", "cosine"])

    compared = "a LONG, ya INT, b LONG, yb INT, cosine DOUBLE"
    pairs = blocks.send(blocks.send(one, hashed, n), paired, n).mapInArrow(distinct, "a LONG, b LONG")
    found = pairs.join(one.withColumnsRenamed({"x": "a", "y": "ya", "v": "u"}), "a").join(one.withColumnsRenamed({"x": "b", "y": "yb", "v": "w"}), "b").select("a", "ya", "b", "yb", "u", "w").mapInArrow(exact, compared)
    # a vector that several rows have is near itself, if it can be compared at all
    several = members.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    itself = one.join(several, ["x", "y"]).select(F.col("x").alias("a"), F.col("y").alias("ya"), F.col("x").alias("b"), F.col("y").alias("yb"), F.col("v").alias("u"), F.col("v").alias("w")).mapInArrow(exact, compared)
    return members, found, itself


def near_duplicate_pairs(
    table: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine) of the pairs a < b whose cosine is at least threshold, rounded to 6 places.

    Each row is compared with all others of its length; a pair exactly at the threshold is found
    with the planned recall and closer ones with more.  Vectors that are null, hold a
    null, NaN or infinity, are zero or of no length have no pairs, and neither have two of unlike
    lengths; K and L are planned for each length.  Rows without an id are left out; a row that is there twice counts
    once; other columns are ignored.

    Equal vectors, whatever their number, are hashed once: pairs are looked for between
    distinct vectors and then named for all that have them.
    """
    compared = _compared(table, threshold, width, recall, id_col, vector_col)
    if compared is None:
        return table.sparkSession.createDataFrame([], "vec_id_a LONG, vec_id_b LONG, cosine DOUBLE")
    members, found, itself = compared
    names = lambda x, y, i: members.withColumnsRenamed({"x": x, "y": y, "id": i})
    told = lambda df, which: df.join(names("a", "ya", "i"), ["a", "ya"]).join(names("b", "yb", "j"), ["b", "yb"]).where(which).select(F.least("i", "j").alias("vec_id_a"), F.greatest("i", "j").alias("vec_id_b"), "cosine")
    return told(found, "i <> j").union(told(itself, "i < j"))


def near_duplicate_classes(
    table: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, class_id, n_links) of every row that has an id: as many rows as there are, however many pairs.

    n_links counts the other rows whose cosine with this one is at least threshold, found as
    near_duplicate_pairs finds them, all copies of a vector included; class_id is the least vec_id of the rows that such links connect.
    A row that is there twice counts once; two vectors under one id are two
    rows, of one class.  Vectors that can't be compared have no links.

    Links are counted between distinct vectors, each weighted by its rows, so copies are
    never expanded into pairs.
    """
    every = _rows(table, id_col, vector_col)
    alone = every.where(f"NOT ({_FIT})").distinct().select("id", F.lit(0).cast("long").alias("n_links"))
    compared = _compared(table, threshold, width, recall, id_col, vector_col)
    if compared is None:
        return alone.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), "n_links")
    members, found, itself = compared
    found = found.select("a", "ya", "b", "yb").checkpoint()
    itself = itself.select(F.col("a").alias("x"), F.col("ya").alias("y"), F.lit(True).alias("itself"))
    per = members.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first")).checkpoint()
    side = lambda x, y, *more: per.select(F.col("x").alias(x), F.col("y").alias(y), *more)
    both = found.union(found.select("b", "yb", "a", "ya"))
    near = both.join(side("b", "yb", "n"), ["b", "yb"]).groupBy(F.col("a").alias("x"), F.col("ya").alias("y")).agg(F.sum("n").alias("near"))
    links = F.coalesce("near", F.lit(0)) + F.when(F.col("itself"), F.col("n") - 1).otherwise(0)
    counted = per.join(near, ["x", "y"], "left").join(itself, ["x", "y"], "left").select("x", "y", "first", "itself", links.alias("n_links")).checkpoint()
    # a vector is known by the least id that has it; the other rows of a comparable one are tied to that
    named = found.join(side("a", "ya", F.col("first").alias("u")), ["a", "ya"]).join(side("b", "yb", F.col("first").alias("v")), ["b", "yb"]).select("u", "v")
    tied = members.join(counted.where("itself"), ["x", "y"]).select(F.col("id").alias("u"), F.col("first").alias("v"))
    classes = connected_components(named.union(tied)).withColumnRenamed("node", "id")
    rows = members.join(counted, ["x", "y"]).select("id", "n_links").union(alone)
    return rows.join(classes, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("component", "id").alias("class_id"), "n_links")
