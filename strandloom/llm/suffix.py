"""Operator 1: suffix-array dedup by a distributed difference-cover sort.

The text is the candidate regions of ``repeats`` (every place where a repeat of
``length`` tokens can lie).  A symbol packs ``g`` tokens, where ``g`` divides
``length``, and a suffix is the sequence of symbols at i, i+g, i+2g and so on.  Suffixes are classed by the number
of their symbol modulo 3:

1. classes 1 and 2 are the sample: their triples of symbols are sorted and named;
2. the names, three symbols apart, form the recursion's string, whose suffixes are
   sorted by triples of names: nine symbols, at least ``length`` tokens, so that one
   step of recursion ranks the sample as far as the comparison needs;
3. class 0 is merged into the sample by its first symbols and the ranks behind them;
4. neighbours in the merged order are compared by their prefix of ``length`` tokens.

Sorting is by ranges of the leading key.  Between the steps the state is written to
the session's checkpoint folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir
from . import blocks, flat, repeats

#: Tokens that a repeat has at least.
LENGTH = 50

SCHEMA = "doc_id LONG, start_word INT, n_words INT, keep BOOLEAN"
_RANK = np.uint64(40)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _regions(found: DataFrame, length: int, n: int) -> DataFrame:
    """Packed (id, text hash, position, token) of every token that lies in a candidate window, by id."""

    def cut(batches):
        box = blocks.Outbox(n)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets, values = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values).astype(np.int64)
            for chunk in flat.chunks(batch.column(1)):
                chunk.tokenize()
                lo, hi = chunk.rows[0], chunk.rows[-1] + 1
                size = np.diff(offsets[lo : hi + 1])
                starts = repeats.window_starts(values[offsets[lo] : offsets[hi]], np.repeat(np.arange(len(size)), size), chunk.row_token, length)
                if not len(starts):
                    continue
                tokens = chunk.hashes()
                mark = np.zeros(len(tokens) + 1, dtype=np.int32)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + length, -1)
                at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                row = np.searchsorted(chunk.row_token, at, side="right") - 1
                text = flat.ranges_hash(tokens, chunk.row_token[:-1], chunk.row_token[1:])
                owner = ids[chunk.rows[row]]
                yield from box.add(blocks.by_id(owner, n), owner, text[row], (at - chunk.row_token[row]).astype(np.uint32), tokens[at])
        yield from box.flush()

    return blocks.send(found, cut, n)


def _home(batches):
    """One row per partition: its tokens, and (id, first position, length) of its regions."""
    pid = None
    parts = []
    for batch in batches:
        for p, d in zip(batch.column(0), batch.column(1)):
            pid = p.as_py()
            parts.append(blocks.unpack(d.as_py(), ["<i8", "<u8", "<u4", "<u8"]))
    if not parts:
        return
    ids, text, at, tokens = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((at, text, ids))
    ids, text, at, tokens = ids[order], text[order], at[order], tokens[order]
    same = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    fresh = np.append(True, ~(same & (at[1:] == at[:-1])))
    ids, text, at, tokens = ids[fresh], text[fresh], at[fresh], tokens[fresh]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ~((ids[1:] == ids[:-1]) & (text[1:] == text[:-1]) & (at[1:] == at[:-1] + 1))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(ids)))
    yield pa.record_batch(
        [pa.array([pid], pa.int32()), pa.array([blocks.pack([tokens])], pa.binary()), pa.array([blocks.pack([ids[start], at[start], size.astype(np.uint32)])], pa.binary())],
        names=["pid", "tokens", "regions"],
    )


class Layout:
    """Where each token of a home partition lies in its region."""

    def __init__(self, regions: bytes, g: int):
        self.ids, self.at, size = blocks.unpack(regions, ["<i8", "<u4", "<u4"])
        self.size = size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.n = int(self.size.sum())
        self.region = np.repeat(np.arange(len(size)), self.size)
        self.offset = np.arange(self.n) - self.begin[self.region]
        self.left = self.size[self.region] - self.offset
        self.digit = (self.offset // g) % 3

    def ahead(self, values: np.ndarray, i: np.ndarray, step: int) -> np.ndarray:
        """values at i+step in the same region, else 0 (below every symbol)."""
        there = self.left[i] > step
        out = np.zeros(len(i), dtype=values.dtype)
        out[there] = values[i[there] + step]
        return out


def _symbols(tokens: np.ndarray, lay: Layout, g: int) -> np.ndarray:
    """32-bit symbols of g tokens; 0 where the region ends before g tokens."""
    out, i = np.zeros(lay.n, dtype=np.uint32), np.flatnonzero(lay.left >= g)
    out[i] = (flat.ranges_hash(tokens, i, i + g) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def packing(length: int) -> int:
    """Tokens of a symbol: whole symbols make up length, and nine of them reach it."""
    return next(g for g in range(1, length + 1) if length % g == 0 and 9 * g >= length)


def _named(keys: list[np.ndarray], home: np.ndarray, at: np.ndarray, pid: int, n: int, box: blocks.Outbox):
    """Sort by keys, name equal keys alike and in order, and send the names home."""
    order = np.lexsort((at, home, *keys[::-1]))
    keys, home, at = [k[order] for k in keys], home[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    name = (np.uint64(pid) << _RANK) | np.cumsum(new).astype(np.uint64)
    back = np.lexsort((at, home))
    yield from box.add(home[back].astype(np.int64), at[back], name[back])
    yield from box.flush()


def _by_first(x: np.ndarray, n: int) -> np.ndarray:
    """Partitions by ranges of a uniform 32-bit key."""
    return ((x.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _name_symbols(n: int):
    def run(batches):
        batches = list(batches)
        if batches and any(b.num_rows for b in batches):
            pid = next(b.column(0)[0].as_py() for b in batches if b.num_rows)
            x0, x1, x2, home, at = blocks.gather(batches, ["<u4", "<u4", "<u4", "<u4", "<u4"])
            yield from _named([x0, x1, x2], home, at, pid, n, blocks.Outbox(n))

    return run


def _name_names(n: int):
    def run(batches):
        batches = list(batches)
        if batches and any(b.num_rows for b in batches):
            pid = next(b.column(0)[0].as_py() for b in batches if b.num_rows)
            n0, n1, n2, home, at = blocks.gather(batches, ["<u8", "<u8", "<u8", "<u4", "<u4"])
            yield from _named([n0, n1, n2], home, at, pid, n, blocks.Outbox(n))

    return run


def _triples(g: int, n: int):
    """Triples of symbols of the sampled suffixes, by their first symbol."""

    def run(batches):
        box = blocks.Outbox(n)
        for batch in batches:
            for pid, tokens, regions in zip(*(batch.column(c).to_pylist() for c in range(3))):
                lay = Layout(regions, g)
                x = _symbols(blocks.unpack(tokens, ["<u8"])[0], lay, g)
                i = np.flatnonzero(lay.digit != 0)
                yield from box.add(_by_first(x[i], n), x[i], lay.ahead(x, i, g), lay.ahead(x, i, 2 * g), np.full(len(i), pid, np.uint32), i.astype(np.uint32))
        yield from box.flush()

    return run


def _received(batches, kinds: list[str]):
    """(pid, home columns, joined sent columns) of a partition that gets both its home row and payloads."""
    pid, own, parts = None, None, []
    for batch in batches:
        for p, data, tokens, regions in zip(*(batch.column(c).to_pylist() for c in range(4))):
            pid = p
            if data is None:
                own = (tokens, regions)
            else:
                parts.append(blocks.unpack(data, kinds))
    sent = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
    return pid, own, sent


def _recursion(g: int, n: int):
    """Triples of names, by their first name."""

    def run(batches):
        pid, own, (at, name) = _received(batches, ["<u4", "<u8"])
        if own is None:
            return
        lay, box = Layout(own[1], g), blocks.Outbox(n)
        names = np.zeros(lay.n, dtype=np.uint64)
        names[at] = name
        i = np.flatnonzero(lay.digit != 0)
        first = names[i]
        yield from box.add((first >> _RANK).astype(np.int64), first, lay.ahead(names, i, 3 * g), lay.ahead(names, i, 6 * g), np.full(len(i), pid, np.uint32), i.astype(np.uint32))
        yield from box.flush()

    return run


def _suffixes(g: int, n: int, length: int):
    """All suffixes of at least length tokens with what the merge compares, by their first symbol."""

    def run(batches):
        _, own, (at, rank) = _received(batches, ["<u4", "<u8"])
        if own is None:
            return
        lay, box = Layout(own[1], g), blocks.Outbox(n)
        tokens = blocks.unpack(own[0], ["<u8"])[0]
        x, ranks = _symbols(tokens, lay, g), np.zeros(lay.n, dtype=np.uint64)
        ranks[at] = rank
        i = np.flatnonzero(lay.left >= length)
        # by class, as each class leaves other columns empty, and runs of zeros pack well
        i = i[np.argsort(lay.digit[i], kind="stable")]
        region = lay.region[i]
        yield from box.add(
            _by_first(x[i], n), lay.digit[i].astype(np.uint8), x[i], np.where(lay.digit[i] == 1, 0, lay.ahead(x, i, g)).astype(np.uint32), ranks[i], lay.ahead(ranks, i, g), lay.ahead(ranks, i, 2 * g),
            flat.ranges_hash(tokens, i, i + length), lay.ids[region], (lay.at[region] + lay.offset[i]).astype(np.uint32),
        )
        yield from box.flush()

    return run


def merged(cls: np.ndarray, x0: np.ndarray, x1: np.ndarray, own: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The order of all suffixes: sampled ones (cls 1, 2) by rank, others (cls 0) set between them.

    A suffix of class 0 and one of class 1 compare by first symbol and the rank one
    symbol on; with class 2 by two symbols and the rank two symbols on.
    """
    n = len(cls)
    place = np.zeros(n, dtype=np.int64)
    zero, sample = np.flatnonzero(cls == 0), np.flatnonzero(cls != 0)
    place[sample[np.argsort(own[sample], kind="stable")]] = np.arange(len(sample))
    place[zero[np.lexsort((ra[zero], x0[zero]))]] = np.arange(len(zero))
    for c in (1, 2):
        part = np.flatnonzero((cls == 0) | (cls == c))
        keys = (cls[part], ra[part], x0[part]) if c == 1 else (cls[part], rb[part], x1[part], x0[part])
        part = part[np.lexsort(keys)]
        is_zero = cls[part] == 0
        seen = np.cumsum(is_zero)
        # a sampled suffix moves up by the class-0 ones before it, and the other way round
        place[part] += np.where(is_zero, np.arange(len(part)) + 1 - seen, seen)
    return np.argsort(place, kind="stable")


def _adjacent(n: int):
    """Merge a range of suffixes and send home those whose neighbour has the same prefix."""

    def run(batches):
        box = blocks.Outbox(n)
        cls, x0, x1, own, ra, rb, prefix, ids, at = blocks.gather(batches, ["u1", "<u4", "<u4", "<u8", "<u8", "<u8", "<u8", "<i8", "<u4"])
        order = merged(cls, x0, x1, own, ra, rb)
        prefix, ids, at = prefix[order], ids[order], at[order]
        if len(ids) < 2:
            return
        equal = prefix[1:] == prefix[:-1]
        group = np.append(0, np.cumsum(~equal))
        many = np.append(False, equal) | np.append(equal, False)
        group, ids, at = group[many], ids[many], at[many]
        by = np.lexsort((at, ids, group))
        group, ids, at = group[by], ids[by], at[by]
        first = np.ones(len(ids), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        by = np.lexsort((at, ids))
        yield from box.add(blocks.by_id(ids[by], n), ids[by], at[by], first[by].astype(np.uint8))
        yield from box.flush()

    return run


def spans(ids: np.ndarray, at: np.ndarray, first: np.ndarray, length: int) -> list[np.ndarray]:
    """Runs of words (id, start, size, keep) from repeated windows sorted by (id, at)."""
    if not len(ids):
        return [ids, at, at, first.astype(bool)]
    # one axis for all documents: each gets its last window's end and one word between
    new = np.append(True, ids[1:] != ids[:-1])
    doc = np.cumsum(new) - 1
    lo = at[new]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    room = at[last] - lo + length + 1
    base = np.cumsum(room) - room
    where = base[doc] + at - lo[doc]
    marks = np.zeros((2, int(room.sum()) + 1), dtype=np.int32)
    for k, part in enumerate((where, where[first == 0])):
        np.add.at(marks[k], part, 1)
        np.add.at(marks[k], part + length, -1)
    covered, drop = (np.cumsum(m[:-1]) > 0 for m in marks)
    kind = covered.astype(np.int8) + drop
    edge = np.append(True, kind[1:] != kind[:-1])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(kind)))
    real = kind[start] > 0
    start, size = start[real], size[real]
    owner = np.searchsorted(base, start, side="right") - 1
    return [ids[new][owner], start - base[owner] + lo[owner], size, kind[start] == 1]


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words (doc_id, start_word, n_words, keep) that lie in a repeat of at least ``length`` words.

    Words are runs without ASCII white space, counted from 0.  A window of
    ``length`` words is repeated if the same words occur at another place, in any
    document.  keep is true where a run is only in first occurrences (least id, then
    least position), and false for the later copies, which may be removed.  Null and
    short texts have no runs; rows without an id are left out; a row that is there
    twice counts once; texts under one id are told apart by their content; other
    columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n, g = blocks.partitions(spark), packing(length)
    found = repeats.candidates(repeats.documents(docs, id_col, text_col), length)
    home = _regions(found, length, n).mapInArrow(_home, "pid INT, tokens BINARY, regions BINARY").checkpoint()
    del found
    release(spark)
    none = F.lit(None).cast("binary")

    def at_home(sent: DataFrame, tokens: bool) -> DataFrame:
        sent = sent.select("pid", "data", none.alias("tokens"), none.alias("regions"))
        return sent.union(home.select("pid", none, F.col("tokens") if tokens else none, "regions")).repartitionById(n, "pid")

    names = blocks.send(home, _triples(g, n), n).mapInArrow(_name_symbols(n), blocks.WIRE).checkpoint()
    release(spark)
    ranks = at_home(names, False).mapInArrow(_recursion(g, n), blocks.WIRE).repartitionById(n, "pid").mapInArrow(_name_names(n), blocks.WIRE).checkpoint()
    del names
    release(spark)
    order = at_home(ranks, True).mapInArrow(_suffixes(g, n, length), blocks.WIRE).repartitionById(n, "pid")
    repeated = blocks.send(order, _adjacent(n), n)

    def join(batches):
        ids, at, first = blocks.gather(batches, ["<i8", "<u4", "u1"])
        by = np.lexsort((at, ids))
        out = spans(ids[by], at[by].astype(np.int64), first[by], length)
        for lo in range(0, len(out[0]), 50_000):
            part = [c[lo : lo + 50_000] for c in out]
            yield pa.record_batch([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.bool_())], names=["doc_id", "start_word", "n_words", "keep"])

    return repeated.mapInArrow(join, SCHEMA)
