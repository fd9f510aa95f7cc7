"""Recruit: the recursive semi-join (inventory ids D1-D4), evaluated semi-naively.

A row is accepted if one of its probed words is accepted; its words are then accepted
too.  A superstep joins only the words that are new since the last one, so its cost
follows what is found.  State is checkpointed to the shared folder each superstep.
At the fixpoint the accepted rows are those of any other order of evaluation; with
max_supersteps they are a subset of what an in-place scan accepts in as many rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strings
from .components import ensure_checkpoint_dir, shared_folder


def recruit(probes: DataFrame, words: DataFrame, seeds: DataFrame, exclude: DataFrame | None = None, groups: DataFrame | None = None, max_supersteps: int | None = None, max_words: int | None = None) -> DataFrame:
    """(id, superstep) of the accepted rows.

    probes: (id, word) that rows are tested by; words: (id, word) that an accepted row
    adds; seeds: (word).  exclude: (id) never accepted.  groups: (id, group_id), of which
    one accepted member brings in the others in the same superstep (D4).  It stops when
    nothing is new, after max_supersteps, or once more than max_words words are known.
    """
    spark = probes.sparkSession
    ensure_checkpoint_dir(spark)
    delta = seeds.select("word").distinct().checkpoint()
    same = words is probes
    if exclude is not None:
        gone = exclude.select("id")
        probes = probes.join(gone, "id", "left_anti")
        words = probes if same else words.join(gone, "id", "left_anti")
    if max_words is None and same:
        probes, delta = _classes(probes, delta)
        words = probes
    elif max_words is None:
        # a word of one row alone, and of no seed, leads nowhere: most words are such
        all_of = probes.select("id", "word").union(words.select("id", "word"))
        shared = all_of.groupBy("word").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("word").union(delta).distinct()
        probes, words = probes.join(shared, "word", "left_semi"), words.join(shared, "word", "left_semi")
    probes = probes.select("id", "word").checkpoint()
    words = probes if same else words.select("id", "word").checkpoint()
    accepted = _Parts(spark.createDataFrame([], probes.select("id", F.lit(0).alias("superstep")).schema))
    known = _Parts(delta)
    step = 0
    while max_supersteps is None or step < max_supersteps:
        step += 1
        hit = probes.join(delta, "word", "left_semi").select("id").distinct()
        if groups is not None:
            members = groups.join(groups.join(hit, "id", "left_semi").select("group_id").distinct(), "group_id", "left_semi").select("id")
            hit = hit.union(members if exclude is None else members.join(exclude.select("id"), "id", "left_anti")).distinct()
        new = hit.join(accepted.all(), "id", "left_anti").select("id", F.lit(step).alias("superstep")).checkpoint()
        if new.isEmpty():
            break
        accepted.add(new)
        delta = words.join(new, "id", "left_semi").select("word").distinct().join(known.all(), "word", "left_anti").checkpoint()
        known.add(delta)
        if max_words is not None and known.all().count() > max_words:
            break
    return accepted.all()


def _by_word(rows: DataFrame) -> DataFrame:
    """(id, word), all of a word in one place; what is made of it twice is shuffled once."""
    # without nulls from the beginning: a filter that only one use has would make it two shuffles
    return rows.select("id", "word").where("word IS NOT NULL AND id IS NOT NULL").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def _classes(rows: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word) and seeds (word) with one word for all that the same rows have, and without those of one row alone that no seed has.

    Such words are accepted together, so rows are accepted in the same supersteps; a
    passage that rows share leaves one word instead of one for each of its places. Sets of rows are told apart by
    their size, their least and greatest id and sums of 36 and 28 bits of the ids' hashes.
    """
    at = _by_word(rows)
    h = F.xxhash64("id")
    sets = at.groupBy("word").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit((1 << 36) - 1))).alias("x"), F.sum(F.shiftrightunsigned(h, 36)).alias("y"))
    told = sets.join(seeds.select("word", F.lit(1).alias("seed")), "word", "left").where("a <> b OR seed = 1")
    classes = told.groupBy("a", "b", "n", "x", "y").agg(F.min("word").alias("word"), F.max("seed").alias("seed")).select("word", "seed")
    # one job, so that the words are shuffled once
    kept = at.join(classes.hint("shuffle_hash"), "word").select("id", "word", "seed").checkpoint()
    return kept.select("id", "word"), kept.where("seed = 1").select("word").distinct().checkpoint()


def recruit_rows(
    rows: DataFrame, seeds: DataFrame, word: int, probe_step: int = 3, build_step: int = 2, involution: str = "identity", exclude: DataFrame | None = None,
    groups: DataFrame | None = None, max_supersteps: int | None = None, max_words: int | None = None,
) -> DataFrame:
    """(row_id, superstep) of rows (row_id, s) recruited by substrings of a width from seeds (s).

    Rows are probed every probe_step places from both ends and add words every build_step;
    seeds are cut at every place. Words closed under an involution are kept as the lesser of
    both. With build_step above 1 the fixpoint depends on it.
    """
    each = lambda words: F.array_distinct(F.transform(words, lambda w: strings.canonical(w, involution)))
    s = F.col("s")
    at_probes = F.transform(strings.probe_positions(F.length(s), word, probe_step), lambda i: F.substring(s, i + 1, F.lit(word)))
    cut = lambda t, words: t.select(F.col("row_id").alias("id"), F.explode(each(words)).alias("word"))
    seed_words = seeds.select(F.explode(each(strings.substrings(s, word))).alias("word"))
    found = recruit(cut(rows, at_probes), cut(rows, strings.substrings(s, word, build_step)), seed_words, exclude, groups, max_supersteps, max_words)
    return found.withColumnRenamed("id", "row_id")


class _Parts:
    """A table that grows by written parts; they are written as one from time to time, so that plans stay small."""

    def __init__(self, first: DataFrame, most: int = 12):
        self.parts, self.most = [first], most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [self.all().checkpoint()]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.union(part)
        return out


def superstep_counts(accepted: DataFrame) -> DataFrame:
    """(superstep, n_new, n_total), from the accepted rows."""
    by = accepted.groupBy("superstep").agg(F.count("*").alias("n_new"))
    # one row for each superstep: the window holds a handful of rows
    return by.withColumn("n_total", F.sum("n_new").over(Window.orderBy("superstep")))


def recruit_quota(words: DataFrame, seeds: DataFrame, quota: int) -> DataFrame:
    """(id, best_quota) of the rows reached while the quota lasts.

    words: (id, pos, word), one word a place.  A seed word has the whole quota.  A row whose word at p
    has d > 0 left gives its word at i a remainder of d - |p - i|; the best remainder
    counts, and only words that got better are propagated.  best_quota is the greatest
    remainder at any of the row's words.
    """
    # gaps that no remainder can get over are as good as longer ones
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.xxhash64("word").alias("w"))))
    rows = words.groupBy("id").agg(sorted_.alias("xs"))
    fill = lambda x, i: F.greatest(F.least(F.coalesce(F.get(F.col("xs"), i + 1)["pos"] - x["pos"], F.lit(1)), F.lit(quota)) - 1, F.lit(0)).cast("int")
    dense = F.flatten(F.transform("xs", lambda x, i: F.concat(F.array(x["w"]), F.array_repeat(F.lit(None).cast("long"), fill(x, i)))))
    return quota_of_arrays(rows.select("id", dense.alias("ws")), seeds.select(F.xxhash64("word").alias("word")), quota)


def quota_of_arrays(rows: DataFrame, seeds: DataFrame, quota: int) -> DataFrame:
    """recruit_quota of rows (id, ws), ws an array of 64-bit words in their places, null where there is none; seeds: (word).

    The rows are written once and read in every step, but never shuffled: what goes on is each
    place that may have a word which got better, with the words within the quota of it.  A bitmap of
    bounded size says which may; a join with the words themselves decides.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/quota-{uuid.uuid4().hex}"
    rows.where(F.size("ws") > 0).select("id", "ws").write.parquet(path)
    rows = spark.read.parquet(path)
    out = f"word LONG, id {rows.schema['id'].dataType.simpleString()}, near ARRAY<LONG>"
    best = seeds.select("word").distinct().withColumn("d", F.lit(quota)).checkpoint()
    delta = best
    reached = []
    while True:
        found = rows.mapInArrow(_near(spark.sparkContext.broadcast(_bitmap(delta)), quota), out).join(delta, "word").select("id", "d", "near").checkpoint()
        reached.append(found.groupBy("id").agg(F.max("d").alias("d")).checkpoint())
        spread = found.select("d", F.posexplode("near").alias("i", "word")).where("word IS NOT NULL").select("word", (F.col("d") - F.abs(F.col("i") - (quota - 1))).alias("d"))
        offered = spread.where("d > 0").groupBy("word").agg(F.max("d").alias("offer"))
        delta = offered.join(best, "word", "left").where("d IS NULL OR offer > d").select("word", F.col("offer").alias("d")).checkpoint()
        if delta.isEmpty():
            break
        best = best.join(delta.select("word"), "word", "left_anti").union(delta).checkpoint()
    return reduce(DataFrame.union, reached).groupBy("id").agg(F.max("d").alias("best_quota"))


#: Bits of a bitmap of words: so many for each word, up to 8 MB, and the shifts that give a word's three places in it.
_BITS_EACH, _MOST_BITS, _SHIFTS = 24, 1 << 26, (0, 20, 37)


def _bitmap(words: DataFrame) -> np.ndarray:
    """A Bloom filter of 64-bit words, made by the executors; its size is bounded whatever their number."""
    bits = min(_MOST_BITS, 1 << max(10, (_BITS_EACH * words.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftright("word", s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS]))
    cells = words.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("x")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("x").to_numpy()
    return out


def _near(bitmap: Broadcast, quota: int):
    """Of (id, ws), (word, id, near) for each place whose word may be in a bitmap: near has the words from quota - 1 places before to as many after, null where there is none."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bitmap.value
        mask = (len(cells) << 6) - 1
        around = np.arange(1 - quota, quota)
        for batch in batches:
            column = batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.values
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy()
            lo, hi = offsets[0], offsets[-1]
            at = lo + np.flatnonzero(there[lo:hi])
            for shift in _SHIFTS:
                b = (values[at] >> shift) & mask
                at = at[(cells[b >> 6] >> (b & 63)) & 1 == 1]
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                row = np.searchsorted(offsets, part, "right") - 1
                grid = part[:, None] + around
                inside = (grid >= offsets[row][:, None]) & (grid < offsets[row + 1][:, None])
                grid = np.where(inside, grid, part[:, None])
                near = pa.array(values[grid].ravel(), mask=~(inside & there[grid]).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(around)), near)
                yield pa.RecordBatch.from_arrays([pa.array(values[part]), batch.column(0).take(pa.array(row)), lists], names=["word", "id", "near"])

    return kernel


def pregroup(words: DataFrame) -> DataFrame:
    """(id, group_id) of rows that share words, transitively; rows that share none are left out."""
    from .components import connected_components

    # a word ties its rows to its least row: a star, so edges grow with rows and not with pairs
    at = _by_word(words)
    hub = at.groupBy("word").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("word", "hub")
    edges = at.join(hub.hint("shuffle_hash"), "word").where("id <> hub").select("id", "hub").distinct()
    return connected_components(edges, "id", "hub").select(F.col("node").alias("id"), F.col("component").alias("group_id"))
