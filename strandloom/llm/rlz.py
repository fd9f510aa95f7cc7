"""Operator 2: substring dedup by relative Lempel-Ziv parsing.

The reference is the text of all documents as far as it repeats, cut into blocks by
hash, and every document is factored against all blocks: a factor starts at the first
window of ``length`` tokens that occurs earlier too and is the longest text from there
on that does (ties go to the least place).  Where it ends, the windows that cross the
factor's boundary are looked at, so the next factor may begin before the last one's
end and no repeat is cut short.

To find longest matches without listing pairs of places, which would be quadratic in
a group of copies:

1. windows meet in the block of their hash, which says of each class whether the tokens
   before or after it differ between its places.  Where they don't, every place goes on
   alike, so a document's repeated text becomes a short string of symbols, each a stretch
   that all its places share whole;
2. each place of a symbol is looked up in the block of the symbol, by hashes of the text
   that follows at up to 16 lengths: first doubling ones, then ones that divide the range
   that is left, until the longest match is known.  In a round, a place is compared with
   one representative of every other continuation, so cost is linear in places and rounds
   are logarithmic in the length of the repeats;
3. documents are parsed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir
from . import blocks, flat, repeats

#: Tokens that a factor has at least.
LENGTH = 50
#: Lengths at which a round compares, besides the one that is known to agree.
STEPS = 15

SCHEMA = "doc_id LONG, start_word INT, n_words INT, ref_doc_id LONG, ref_start_word INT"
_HOME = "pid INT, data BINARY, home BINARY"
#: A place as it is sent to a block: group, range of agreement in symbols (0: open), symbols left, id, text's hash, position, home partition, number there, whether it asks.
_ASK = ["<u8", "<u4", "<u4", "<u4", "<i8", "<i4", "<u4", "<i4", "<u4", "u1"] + ["<u8"] * STEPS
_STATE = ["<i8", "<i4", "<u4", "<u4", "<u8"]


def windows(found: DataFrame, length: int, n: int) -> DataFrame:
    """Packed (hash, id, text's hash, position, token before, token after) of all windows that hold a repeated k-gram, by hash."""

    def cut(batches):
        box = blocks.Outbox(n)
        for batch in batches:
            ids, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3))
            places = batch.column(2)
            offsets = np.asarray(places.offsets)
            values = np.asarray(places.values).astype(np.int64)
            for chunk in flat.chunks(batch.column(1)):
                chunk.tokenize()
                lo, hi = chunk.rows[0], chunk.rows[-1] + 1
                size = np.diff(offsets[lo : hi + 1])
                starts = repeats.window_starts(values[offsets[lo] : offsets[hi]], np.repeat(np.arange(len(size)), size), chunk.row_token, length)
                if not len(starts):
                    continue
                tokens = chunk.hashes()
                hashes = flat.ranges_hash(tokens, starts, starts + length)
                row = np.searchsorted(chunk.row_token, starts, side="right") - 1
                at = starts - chunk.row_token[row]
                # 0: none
                short = np.append((tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                before = np.where(at > 0, short[starts - 1], np.uint32(0))
                after = np.where(starts + length < chunk.row_token[row + 1], short[starts + length], np.uint32(0))
                owner = chunk.rows[row]
                yield from box.add(blocks.by_hash(hashes, n), hashes, ids[owner].astype(np.int64), of[owner].astype(np.int32), at.astype(np.uint32), before, after)
        yield from box.flush()

    return blocks.send(found, cut, n)


def _classes(n: int):
    """Send each repeated window home with where its class branches: to the left (1), to the right (2), or a text's begin (4)."""

    def run(batches):
        box = blocks.Outbox(n)
        (hashes, ids, of, at, before, after), begin = repeats.occurring_twice(*blocks.gather(batches, ["<u8", "<i8", "<i4", "<u4", "<u4", "<u4"]))
        if not len(ids):
            return
        start = np.flatnonzero(np.append(True, begin[1:] != begin[:-1]))
        size = np.diff(np.append(start, len(ids)))
        left, right = (np.repeat(np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start), size) for c in (before, after))
        flags = (left + 2 * right + 4 * (before == 0)).astype(np.uint8)
        order = np.lexsort((at, of, ids))
        out = (ids, of, at, flags, np.where(flags > 0, hashes, np.uint64(0)), np.where(right, after, np.uint32(0)))
        yield from box.add(blocks.by_id(ids[order], n), *(c[order] for c in out))
        yield from box.flush()

    return run


def _symbols(batches):
    """One row for each partition: the symbols of its documents (id, text's hash, position, windows, name), in order."""
    pid, parts = None, []
    for batch in batches:
        for p, d in zip(batch.column(0), batch.column(1)):
            pid = p.as_py()
            parts.append(blocks.unpack(d.as_py(), ["<i8", "<i4", "<u4", "u1", "<u8", "<u4"]))
    if not parts:
        return
    ids, of, at, flags, hashes, after = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((at, of, ids))
    ids, of, at, flags, hashes, after = (c[order] for c in (ids, of, at, flags, hashes, after))
    follows = np.append(False, (ids[1:] == ids[:-1]) & (of[1:] == of[:-1]) & (at[1:] == at[:-1] + 1))
    by_itself = (flags & 5) > 0
    branched = np.append(False, (flags[:-1] & 2) > 0)
    start = np.flatnonzero(~follows | by_itself | branched)
    size = np.diff(np.append(start, len(ids)))
    name = flat.mix(np.append(np.uint64(0), hashes[:-1]) ^ (np.append(np.uint32(0), after[:-1]).astype(np.uint64) * flat.BASE))
    name = np.where(by_itself, hashes, name)[start]
    yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([None], pa.binary()), pa.array([blocks.pack([ids[start], of[start], at[start], size.astype(np.uint32), name])], pa.binary())], names=["pid", "data", "home"])


class Symbols:
    """The symbols of a home partition."""

    def __init__(self, home: bytes):
        self.ids, self.of, self.at, self.size, self.name = blocks.unpack(home, _STATE)
        n = len(self.ids)
        breaks = np.append(True, (self.ids[1:] != self.ids[:-1]) | (self.of[1:] != self.of[:-1]) | (self.at[1:] != self.at[:-1] + self.size[:-1]))
        start = np.flatnonzero(breaks)
        #: symbols from each one to its region's end
        self.left = np.append(start[1:], n)[np.cumsum(breaks) - 1] - np.arange(n)

    def hashes(self, i: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hash of count symbols from i on, 0 where there are fewer."""
        fits = count <= self.left[i]
        out = np.zeros(len(i), dtype=np.uint64)
        out[fits] = flat.ranges_hash(self.name, i[fits], i[fits] + count[fits]) | np.uint64(1)
        return out


def lengths(low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
    """The step-th length between low, which agrees, and high, which doesn't (0: no bound known); the 0th is low."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    inside = np.minimum(low - (-(high - low) * step // (STEPS + 1)), high - 1)
    return np.where(high == 0, low << step, inside)


def _received(batches):
    pid, home, parts = None, None, []
    for batch in batches:
        for p, data, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
            pid = p
            if own is not None:
                home = own
            if data is not None:
                parts.append(data)
    return pid, home, parts


def _ask(n: int, all_: bool):
    """Places with the hashes of what follows, to the blocks of their groups; in the first round every symbol's group is its name."""

    def run(batches):
        pid, home, parts = _received(batches)
        if home is None:
            return
        own, box = Symbols(home), blocks.Outbox(n)
        if all_:
            i = np.arange(len(own.ids), dtype=np.uint32)
            group, low, high, active = own.name, np.ones(len(i), np.uint32), np.zeros(len(i), np.uint32), np.ones(len(i), np.uint8)
        else:
            group, low, high, i, active = (np.concatenate(c) for c in zip(*(blocks.unpack(d, ["<u8", "<u4", "<u4", "<u4", "u1"]) for d in parts))) if parts else [np.zeros(0, k) for k in ("<u8", "<u4", "<u4", "<u4", "u1")]
        for a in range(0, len(i), 500_000):
            k = i[a : a + 500_000].astype(np.int64)
            lo, hi, g = low[a : a + 500_000], high[a : a + 500_000], group[a : a + 500_000]
            follow = [own.hashes(k, lengths(lo, hi, s)) for s in range(1, STEPS + 1)]
            yield from box.add(blocks.by_hash(flat.mix(g), n), g, lo, hi, own.left[k].astype(np.uint32), own.ids[k], own.of[k], own.at[k], np.full(len(k), pid, np.int32), k.astype(np.uint32), active[a : a + 500_000], *follow)
        yield from box.flush()

    return run


def compare(group, low, high, left, ids, of, at, active, follow) -> tuple[np.ndarray, ...]:
    """For each place: the greatest step at which an earlier place of its group agrees (-1: none), the least such place, and what they share.

    follow: hashes by step, 0 where a text ends before.
    """
    m = len(ids)
    rank = np.empty(m, dtype=np.int64)
    rank[np.lexsort((at, of, ids))] = np.arange(m)
    best, ref, key = np.full(m, -1), np.full(m, -1), np.zeros(m, np.uint64)
    some = np.arange(m)
    for step, by in enumerate([group, *follow]):
        some = some[by[some] != 0] if step else some
        some = some[np.lexsort((rank[some], by[some]))]
        if not len(some):
            break
        k = by[some]
        first = np.append(True, k[1:] != k[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(some)))
        least = np.repeat(some[start], size)
        later = ~first
        best[some[later]], ref[some[later]], key[some[later]] = step, least[later], k[later]
        some = some[np.repeat(size > 1, size)]
    return best, ref, key


def _answer(n: int):
    """What is known of each place after a round: its longest match (open false), or the group and range for the next (open true)."""

    def run(batches):
        group, low, high, left, ids, of, at, pid, number, active, *follow = blocks.gather(batches, _ASK)
        best, ref, key = compare(group, low, high, left, ids, of, at, active, follow)
        i = np.flatnonzero((active > 0) & (best >= 0))
        done, agree, bound = np.zeros(len(i), bool), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for step in range(STEPS + 1):
            here = best[i] == step
            lo, hi = low[i[here]], high[i[here]]
            agree[here] = lengths(lo, hi, step)
            nxt = lengths(lo, hi, step + 1) if step < STEPS else hi.astype(np.int64)
            for s in range(step + 2, STEPS + 1):  # steps of one length
                nxt = np.where(nxt == agree[here], lengths(lo, hi, s), nxt)
            bound[here] = np.where((nxt == agree[here]) & (hi > 0), hi, nxt)
        done = (bound == agree + 1) | (left[i] == agree)
        d = i[done]
        closed, further = blocks.Outbox(n), blocks.Outbox(n)
        for batch in [*closed.add(pid[d], number[d], agree[done].astype(np.uint32), ids[ref[d]], at[ref[d]]), *closed.flush()]:
            yield batch.append_column("open", pa.array(np.zeros(batch.num_rows, bool)))
        o = i[~done]
        # the least place of a group comes along, as others may continue it
        key_, first = np.unique(key[o], return_index=True)
        r, lo, hi = ref[o[first]], agree[~done][first], bound[~done][first]
        columns = [(key[o], agree[~done].astype(np.uint32), bound[~done].astype(np.uint32), number[o], np.ones(len(o), np.uint8)), (key_, lo.astype(np.uint32), hi.astype(np.uint32), number[r], np.zeros(len(r), np.uint8))]
        for batch in [*further.add(np.concatenate([pid[o], pid[r]]), *(np.concatenate(c) for c in zip(*columns))), *further.flush()]:
            yield batch.append_column("open", pa.array(np.ones(batch.num_rows, bool)))

    return run


def parse(ids, of, at, size, reach, ref, ref_at, length: int) -> list[list[int]]:
    """Greedy factors from the symbols, sorted by place, that have an earlier occurrence: windows of each, words of its longest match, and where that is."""
    out: list[list[int]] = [[], [], [], [], []]
    ids, of, at, size, reach, ref, ref_at = (c.tolist() for c in (ids, of, at, size, reach, ref, ref_at))
    j, last, now = 0, len(ids), None
    while j < last:
        if (ids[j], of[j]) != now:
            now, least = (ids[j], of[j]), 0
        if at[j] + size[j] <= least:
            j += 1
            continue
        # inside a symbol the longest match is that of its begin, less the words before
        p = max(at[j], least)
        skip = p - at[j]
        for column, value in zip(out, (ids[j], p, reach[j] - skip, ref[j], ref_at[j] + skip)):
            column.append(value)
        # the first window that goes beyond the factor's end
        least = p + reach[j] - skip - length + 1
    return out


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factors (doc_id, start_word, n_words, ref_doc_id, ref_start_word) of at least ``length`` words.

    Words are runs without ASCII white space, counted from 0.  Each factor is the longest
    text from its start on that occurs earlier, in a document of a smaller id or further
    left in the same one, and names the least such place.  A document's first factor starts at its first window of
    ``length`` words that occurs earlier, the next ones at the first such window that ends
    beyond the factor before; so every word of a repeated window other than the
    window's first occurrence is in a factor, and nothing else is.  Null and short
    texts have no factors; rows without an id are left out; a row that is there
    twice counts once; two texts under one id are two documents, in the order of their
    hashes; other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n = blocks.partitions(spark)
    found = repeats.candidates(repeats.documents(docs, id_col, text_col), length)
    home = blocks.send(windows(found, length, n), _classes(n), n).mapInArrow(_symbols, _HOME).checkpoint()
    none = F.lit(None).cast("binary")
    at_home = lambda sent: sent.select("pid", "data", none.alias("home")).union(home).repartitionById(n, "pid")
    answers, asked = [], home.mapInArrow(_ask(n, True), blocks.WIRE)
    while True:
        answer = asked.repartitionById(n, "pid").mapInArrow(_answer(n), blocks.WIRE + ", open BOOLEAN").checkpoint()
        answers.append(answer.where("NOT open"))
        further = answer.where("open")
        if further.isEmpty():
            break
        asked = at_home(further).mapInArrow(_ask(n, False), blocks.WIRE)

    def factors(batches):
        _, home, parts = _received(batches)
        if home is None or not parts:
            return
        own = Symbols(home)
        number, count, ref, ref_at = (np.concatenate(c) for c in zip(*(blocks.unpack(d, ["<u4", "<u4", "<i8", "<u4"]) for d in parts)))
        order = np.argsort(number, kind="stable")
        i, count, ref, ref_at = number[order].astype(np.int64), count[order], ref[order], ref_at[order]
        total = np.append(0, np.cumsum(own.size, dtype=np.int64))
        out = parse(own.ids[i], own.of[i], own.at[i], own.size[i], total[i + count] - total[i] + length - 1, ref, ref_at, length)
        for lo in range(0, len(out[0]), 50_000):
            yield pa.record_batch([pa.array(c[lo : lo + 50_000], t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names=["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start_word"])

    known = answers[0]
    for more in answers[1:]:
        known = known.union(more)
    return at_home(known).mapInArrow(factors, SCHEMA)
