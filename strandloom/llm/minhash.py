"""Operator 4: MinHash near-dedup with odd sketches.

A document's shingles are the pairs of adjacent words in lower case, punctuation
aside.  Its MinHash samples fill bands; documents that share a band's hash are
candidates, and only their sketches are sent, to the bands that they share.  The samples are also folded into a parity bitmap (an odd sketch): a
sample flips one bit, so the samples of two documents that agree cancel out in
the XOR of the bitmaps, and its population count estimates how many differ.
Candidates whose estimate lies well above or below the threshold are decided by it
inside their band, on bitmaps alone; for those in between the shingles are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, ensure_checkpoint_dir
from . import blocks, flat, repeats

#: Bits of a sketch, words of a shingle, least Jaccard similarity, rows of a band, share of the pairs at the threshold that the bands are planned to find.
BITS, SHINGLE, THRESHOLD, ROWS, RECALL = 512, 2, 0.55, 4, 0.99
#: How far below and above the threshold an estimate leaves a pair in doubt: about three standard deviations (0.052 at 0.55).
BELOW, ABOVE = 0.15, 0.17


def plan(threshold: float, rows: int, recall: float) -> int:
    """Bands that find a pair at the threshold with the wanted recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = plan(THRESHOLD, ROWS, RECALL)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.zeros(256, dtype=bool)
_APART[:33] = _APART[33:48] = _APART[58:65] = _APART[91:97] = _APART[123:128] = True
_SEEDS = flat.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * flat.BASE)
_A, _B = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def words(chunk: flat.Chunk) -> np.ndarray:
    """Set the chunk's tokens to runs of letters and digits (any byte above 127 is one) and hash them in lower case.

    Lower case covers A-Z and the Latin-1 letters of UTF-8.
    """
    data = _LOWER[chunk.data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[latin] += 32
    apart = _APART[data]
    data[apart] = 32
    chunk.data = data
    return chunk.tokenize().hashes()


def shingles(chunk: flat.Chunk, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and the index of each one's row; a text of fewer words is one shingle."""
    tokens = words(chunk)
    if not len(tokens):
        return tokens, np.zeros(0, dtype=np.int64)
    row = chunk.token_rows()
    at = np.arange(len(tokens))
    end = chunk.row_token[row + 1]
    use = (at + width <= end) | (at == chunk.row_token[row])
    at = at[use]
    return flat.ranges_hash(tokens, at, np.minimum(at + width, end[use])), row[use]


def samples(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """MinHash samples, one line for each set hashes[start[i]:start[i+1]]."""
    out = np.empty((len(start), BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((hashes * _A[k] + _B[k]) >> np.uint64(32), start)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One hash for each line and band."""
    n = len(sample)
    values = sample.reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * flat.BASE, (n, BANDS)).copy()
    for r in range(ROWS):
        key = flat.mix(key ^ values[:, :, r]) * flat.BASE
    return flat.mix(key)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps (BITS bits as 64-bit words) of the samples, each with its number."""
    n, k = sample.shape
    bit = flat.mix(sample.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    parity = np.zeros((n, BITS), dtype=np.uint8)
    line = np.arange(n)
    for j in range(k):
        parity[line, bit[:, j].astype(np.int64)] ^= 1
    return np.packbits(parity, axis=1, bitorder="little").view("<u8")


#: The most differing bits at which the estimate is at least a similarity.
def most_bits(threshold: float) -> int:
    """Estimated similarity of d differing bits: 1 + n/(4k) ln(1 - 2d/n)."""
    k = BANDS * ROWS
    d = [d for d in range(BITS // 2) if 1 + BITS / (4 * k) * math.log(1 - 2 * d / BITS) >= threshold]
    return d[-1]


def links(ids: np.ndarray, sketches: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of one bucket under the verified relation, each as a star (member, least id).

    Every pair that is not yet in one component is compared, so the components are
    those of all pairs; what has been joined is not compared again.
    """
    # equal sketches first, whatever their number
    unique, of = np.unique(sketches, axis=0, return_inverse=True)
    of = of.reshape(-1)
    left = np.arange(len(unique))
    component = np.full(len(unique), -1)
    c = 0
    while len(left):
        queue = [left[0]]
        left = left[1:]
        component[queue[0]] = c
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(unique[left] ^ unique[x]).sum(axis=1, dtype=np.int32) <= most
            component[left[near]] = c
            queue.extend(left[near].tolist())
            left = left[~near]
        c += 1
    label = component[of]
    least = np.full(c, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    other = ids != least[label]
    return ids[other], least[label][other]


def doubtful(ids: np.ndarray, sketches: np.ndarray, sure: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket with more than sure and at most most differing bits, but for those in one component of links(.., sure).

    Of rows with equal sketches the one of the least id stands for all.
    """
    order = np.argsort(ids, kind="stable")
    unique, first = np.unique(sketches[order], axis=0, return_index=True)
    ids = ids[order][first]
    u, v = links(ids, unique, sure)
    star = dict(zip(u.tolist(), v.tolist()))
    root = np.array([star.get(i, i) for i in ids.tolist()])
    a, b = [], []
    for k in range(len(ids) - 1):
        d = np.bitwise_count(unique[k + 1 :] ^ unique[k]).sum(axis=1, dtype=np.int32)
        near = k + 1 + np.flatnonzero((d <= most) & (root[k + 1 :] != root[k]))
        a.append(np.full(len(near), ids[k]))
        b.append(ids[near])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact Jaccard similarity of the shingles of each two texts."""
    n, sides = len(left), []
    for column in (left, right):
        hashes, row = shingles(next(flat.chunks(column, 1 << 60)))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        sides.append((hashes[new], row[new]))
    hashes, row = (np.concatenate(c) for c in zip(*sides))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    both = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    return both / np.maximum(np.bincount(row, minlength=n) - both, 1)


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose shingles are similar enough; docs: (id, text).

    Only documents that a pair may name, by a bitmap over hashes of ids, are shuffled.
    """
    def exact(batches):
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 1_000_000, side="right")))
                part = batch.slice(lo, hi - lo)
                yield part.select([0, 1]).filter(pa.array(similarity(part.column(2), part.column(3)) >= threshold))
                lo = hi

    some = repeats.only_named(docs, ["id"], pairs.select(F.explode(F.array("u", "v")).alias("id")), ["id"])
    found = pairs.join(some.withColumnsRenamed({"id": "u", "text": "x"}), "u").join(some.withColumnsRenamed({"id": "v", "text": "y"}), "v")
    return found.select("u", "v", "x", "y").mapInArrow(flat.released(exact), "u LONG, v LONG")


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the group's least doc_id.

    Groups are the connected components of the verified candidate pairs, so copies
    of copies go together.  Null texts and texts without a letter or digit are in no
    group; rows without an id are left out; a row that is there twice is no duplicate
    of itself; other columns are ignored.
    """
    n = blocks.partitions(docs.sparkSession)
    sure, most = most_bits(min(threshold + ABOVE, 1.0)), most_bits(threshold - BELOW)
    kinds = ["<u8", "<i8"] + ["<u8"] * (BITS // 64)
    state = ["<i8", f"V{8 * BANDS}", f"V{BITS // 8}"]

    def sign(batches):
        box = blocks.Outbox(n)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in flat.chunks(batch.column(1), 1_000_000):
                hashes, row = shingles(chunk)
                if not len(hashes):
                    continue
                start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                sample = samples(hashes, start)
                owner = ids[chunk.rows[row[start]]]
                yield from box.add(blocks.by_id(owner, n), owner, band_keys(sample), odd_sketch(sample))
        yield from box.flush()

    def keep(batches):
        """One row for each partition: ids, band hashes and sketches of its documents, each once."""
        pid, parts = None, []
        for batch in batches:
            for p, d in zip(batch.column(0), batch.column(1)):
                pid = p.as_py()
                parts.append(blocks.unpack(d.as_py(), state))
        if parts:
            ids, keys, sketch = (np.concatenate(c) for c in zip(*parts))
            _, first = np.unique(np.stack([ids.view(np.uint64), *keys.view("<u8").reshape(len(ids), BANDS).T]), axis=1, return_index=True)
            yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([None], pa.binary()), pa.array([blocks.pack([c[first] for c in (ids, keys, sketch)])], pa.binary())], names=["pid", "data", "home"])

    def ask(batches):
        """Every band's hash, without the sketch, to where equal ones meet."""
        box = blocks.Outbox(n)
        for batch in batches:
            for pid, home in zip(batch.column("pid").to_pylist(), batch.column("home").to_pylist()):
                keys = blocks.unpack(home, state)[1].view("<u8")
                row, band = np.divmod(np.arange(len(keys)), BANDS)
                yield from box.add(blocks.by_hash(keys, n), keys, np.full(len(keys), pid, np.int32), row.astype(np.uint32), band.astype(np.uint8))
        yield from box.flush()

    def shared(batches):
        """The bands that several documents have, back home."""
        box = blocks.Outbox(n)
        key, pid, row, band = blocks.gather(batches, ["<u8", "<i4", "<u4", "u1"])
        order = np.argsort(key, kind="stable")
        key, pid, row, band = (c[order] for c in (key, pid, row, band))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        many = np.repeat(size > 1, size)
        back = np.lexsort((band[many], row[many]))
        yield from box.add(pid[many][back], row[many][back], band[many][back])
        yield from box.flush()

    def offer(batches):
        """Sketches of candidates, to the bands that they share."""
        home, parts = None, []
        for batch in batches:
            for data, own in zip(batch.column("data").to_pylist(), batch.column("home").to_pylist()):
                home = own or home
                parts += [blocks.unpack(data, ["<u4", "u1"])] if data is not None else []
        if home is None or not parts:
            return
        ids, keys, sketch = blocks.unpack(home, state)
        keys, sketch = keys.view("<u8").reshape(len(ids), BANDS), sketch.view("<u8").reshape(len(ids), BITS // 64)
        row, band = (np.concatenate(c) for c in zip(*parts))
        box = blocks.Outbox(n)
        for lo in range(0, len(row), 200_000):
            r = row[lo : lo + 200_000].astype(np.int64)
            key = keys[r, band[lo : lo + 200_000]]
            yield from box.add(blocks.by_hash(key, n), key, ids[r], *np.ascontiguousarray(sketch[r].T))
        yield from box.flush()

    def verify(batches):
        keys, ids, *sketch = blocks.gather(batches, kinds)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        sketch = np.stack([s[order] for s in sketch], axis=1)
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        two = start[size == 2]
        d = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int32)
        two, d = two[ids[two] != ids[two + 1]], d[ids[two] != ids[two + 1]]
        for certain, within, bucket in ((True, d <= sure, lambda *x: links(*x, sure)), (False, (d > sure) & (d <= most), lambda *x: doubtful(*x, sure, most))):
            found = [(ids[two[within] + 1], ids[two[within]])] + [bucket(ids[s : s + m], sketch[s : s + m]) for s, m in zip(start[size > 2], size[size > 2])]
            u, v = (np.concatenate(c) for c in zip(*found))
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
            for lo in range(0, pairs.shape[1], 50_000):
                part = pairs[:, lo : lo + 50_000]
                yield pa.record_batch([pa.array(part[0]), pa.array(part[1]), pa.array(np.full(part.shape[1], certain))], names=["u", "v", "certain"])

    ensure_checkpoint_dir(docs.sparkSession)
    docs = repeats.documents(docs, id_col, text_col).select("id", "text")
    home = blocks.send(docs, sign, n).mapInArrow(flat.released(keep), "pid INT, data BINARY, home BINARY").checkpoint()
    candidates = blocks.send(blocks.send(home, ask, n), shared, n).select("pid", "data", F.lit(None).cast("binary").alias("home")).union(home)
    pairs = blocks.send(candidates.repartitionById(n, "pid"), offer, n).mapInArrow(flat.released(verify), "u LONG, v LONG, certain BOOLEAN").groupBy("u", "v").agg(F.max("certain").alias("certain")).checkpoint()
    edges = pairs.where("certain").select("u", "v").union(_verified(docs, pairs.where("NOT certain AND u <> v").select("u", "v"), threshold))
    return connected_components(edges).withColumnsRenamed({"node": "doc_id", "component": "group_id"})
