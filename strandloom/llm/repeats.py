"""Where long passages repeat: an exact, content-defined preselection.

Both substring operators need only look where some window of ``length`` tokens
occurs twice.  In every such window a k-gram is picked by winnowing (the least
k-gram hash of the window), a rule that sees the window's content alone, so equal
windows pick equal k-grams and no repeat is missed.  Documents therefore send
about 2 of 32 positions, and only those whose k-gram occurs at two places remain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir
from . import blocks, flat

#: Bits of the filter that says which documents are joined; 2 MB for the workers.
FILTER_BITS = 1 << 24


def gram_of(length: int) -> int:
    """Tokens of the k-grams that winnowing picks from: two fifths of the windows' length."""
    return max(1, 2 * length // 5)


def sliding(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over values[i:i+width] for each i; beyond the end counts as fill."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full_like(out, fill)
        shifted[: len(out) - step] = out[step:] if step < len(out) else out[:0]
        op(out, shifted, out=out)
        have += step
    return out


def winnow(hashes: np.ndarray, row_token: np.ndarray, token_row: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Token positions that winnowing picks, and the hashes of their k-grams."""
    n = len(hashes)
    if n < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    row_end = row_token[token_row + 1]
    whole = at + gram <= row_end
    grams = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    start = at[whole]
    grams[whole] = flat.ranges_hash(hashes, start, start + gram)
    width = length - gram + 1
    least = sliding(grams, width, np.minimum, np.iinfo(np.uint64).max)
    least[at + length > row_end] = 0
    # the greatest of the minima over the windows that hold position i: windows i-width+1 .. i
    best = sliding(least[::-1], width, np.maximum, 0)[::-1]
    picked = np.flatnonzero(whole & (best == grams) & (best > 0))
    return picked, grams[picked]


def anchors(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Packed (hash, id, text's hash, position) of the winnowed k-grams, by hash; docs as of documents()."""

    def pick(batches):
        box = blocks.Outbox(n)
        for batch in batches:
            ids, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for chunk in flat.chunks(batch.column(1)):
                chunk.tokenize()
                rows = chunk.token_rows()
                at, grams = winnow(chunk.hashes(), chunk.row_token, rows, length, gram_of(length))
                row = rows[at]
                owner = chunk.rows[row]
                yield from box.add(blocks.by_hash(grams, n), grams, ids[owner].astype(np.int64), of[owner].astype(np.int32), (at - chunk.row_token[row]).astype(np.uint32))
        yield from box.flush()

    return blocks.send(docs, pick, n)


def occurring_twice(keys: np.ndarray, ids: np.ndarray, of: np.ndarray, at: np.ndarray, *more: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct (key, id, text's hash, at, ..) whose key has at least two places, sorted, and each one's group start."""
    order = np.lexsort((at, of, ids, keys))
    columns = [c[order] for c in (keys, ids, of, at, *more)]
    if len(keys):
        fresh = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]]))
        columns = [c[fresh] for c in columns]
    keys = columns[0]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(keys)))
    many = np.repeat(size >= 2, size)
    begin = np.repeat(start, size)
    # group starts as indices into what remains
    index = np.cumsum(many) - 1
    return [c[many] for c in columns], index[begin[many]] if len(keys) else begin


def candidates(docs: DataFrame, length: int) -> DataFrame:
    """(id, text, places, of): the documents that share a winnowed k-gram, with its token positions.

    docs: as of documents().  A repeated (id, text) row counts once; two texts under
    one id are two documents.
    """
    n = blocks.partitions(docs.sparkSession)

    def repeated(batches):
        (_, ids, of, at), _ = occurring_twice(*blocks.gather(batches, ["<u8", "<i8", "<i4", "<u4"]))
        order = np.lexsort((at, of, ids))
        ids, of, at = ids[order], of[order], at[order].astype(np.int32)
        start = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1]))) if len(ids) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(ids)))
        for lo in range(0, len(start), 10_000):
            part = start[lo : lo + 10_000]
            b, e = part[0], part[-1] + size[lo : lo + 10_000][-1]
            yield pa.record_batch([pa.array(ids[part], pa.int64()), pa.array(of[part], pa.int32()), flat.lists(at[b:e], size[lo : lo + 10_000], pa.int32())], names=["id", "of", "places"])

    ensure_checkpoint_dir(docs.sparkSession)
    places = anchors(docs, length, n).mapInArrow(repeated, "id LONG, of INT, places ARRAY<INT>").checkpoint()
    few = only_named(docs, ["id", "of"], places, ["id", "of"])
    places = places.groupBy("id", "of").agg(F.flatten(F.collect_list("places")).alias("places"))
    return few.join(places, ["id", "of"]).select("id", "text", "places", "of")


def only_named(docs: DataFrame, columns: list[str], named: DataFrame, by: list[str], then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """The rows of docs, or what ``then`` makes of them in the same worker, whose columns may be among those of named, so that a join with it needn't shuffle the others.

    A bitmap over hashes says so, of fixed size: where it fills up, rows that no one named
    pass too, and cost shuffle only.
    """
    bit = lambda names: F.xxhash64(*names).bitwiseAND(FILTER_BITS - 1)
    filled = named.select(bit(by).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("mask")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    bitmap[filled["at"].to_numpy()] = filled["mask"].to_numpy()
    kept = docs.columns

    def pick(batches):
        for batch in batches:
            b = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            some = batch.select(range(len(kept))).filter(pa.array((bitmap[b >> 6] >> (b & 63)) & 1 == 1))
            yield then(some) if then else some

    return docs.withColumn("bit", bit(columns)).mapInArrow(flat.released(pick), schema or docs.schema)


def window_starts(places: np.ndarray, rows: np.ndarray, row_token: np.ndarray, length: int) -> np.ndarray:
    """Sorted chunk positions of the windows that hold a place; places and rows as found, in any order."""
    first = row_token[rows]
    last = row_token[rows + 1] - length
    lo = np.maximum(first, first + places - (length - gram_of(length)))
    hi = np.minimum(last, first + places)
    ok = hi >= lo
    mark = np.zeros(int(row_token[-1]) + 2, dtype=np.int32)
    np.add.at(mark, lo[ok], 1)
    np.add.at(mark, hi[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, of) of the rows that have an id, of being the text's hash; other columns play no part."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.hash(text).alias("of")).where(F.col("id").isNotNull())
