"""Operator 9: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into segments that no merge can cross: before a space mark that follows
another character, and around characters that have no piece.  The distinct segments
of a chunk are encoded together as flat symbol arrays.  In a round every segment
finds its least pair rank, the leftmost pairs of that rank merge all at once, and
the arrays are compacted; segments without a pair leave.

One merge at a time, always of the leftmost pair of least rank, could do something else
only if a merge made a pair of earlier rank that takes a symbol from another
occurrence of the merged pair: from (x, y) to z, a pair (.. z, x) of a rank before z's.
The model's table is searched for such pairs, and where a rank has one, a round merges
only the leftmost occurrence.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat

#: A public BPE model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
SCHEMA = "doc_id LONG, ids ARRAY<INT>, n_tokens INT, exact BOOLEAN"
_NONE = np.int32(2**31 - 1)
#: Segments that a worker remembers between chunks, to save work only.
REMEMBERED = 400_000
#: Bytes of text that are encoded at once; a byte takes some 60 bytes of arrays.
CHUNK_BYTES = 500_000


class Model:
    """Tables of a BPE model: pieces of single characters, pair merges, bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        rank = {p: r for r, p in enumerate(sorted(normal, key=lambda p: -sp.get_score(normal[p])))}
        self.size = n
        self.chars = np.array([[ord(p), i] for p, i in normal.items() if len(p) == 1], dtype=np.int64).reshape(-1, 2)
        pairs = [(normal[p[:k]] * n + normal[p[k:]], rank[p]) for p in normal for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        self.keys, self.ranks = (np.array(c, dtype=t) for c, t in zip(zip(*pairs), (np.int64, np.int32)))
        self.of_rank = np.zeros(len(rank), dtype=np.int32)
        self.of_rank[list(rank.values())] = [normal[p] for p in rank]
        #: ranks whose occurrences have to be merged one at a time
        self.single = np.zeros(len(rank), dtype=bool)
        for a, b in ((p[:k], p[k:]) for p in normal for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal):
            for k in range(len(a) - len(b)):
                z = a[k:]
                if z.startswith(b) and z in normal and z[len(b) :] in normal and rank[a + b] < rank[z]:
                    self.single[rank[z]] = True
        self.bytes = np.zeros(256, dtype=np.int32)
        surface = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(b"" if sp.is_control(i) else p.replace("▁", " ").encode())
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.length = np.array([len(s) for s in surface], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Model:
    return Model(path)


@lru_cache(maxsize=4)
def _char_table(path: str) -> np.ndarray:
    table = np.full(0x110000, -1, dtype=np.int32)
    chars = load(path).chars
    table[chars[:, 0]] = chars[:, 1]
    return table


def _pair_ranks(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of the pairs' merges, _NONE where there is none."""
    key = left.astype(np.int64) * model.size + right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    return np.where(model.keys[at] == key, model.ranks[at], _NONE)


def merge(model: Model, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encode segments of piece ids: ids and the number of each segment's ids, in order.

    Ranks are looked up once and then again only where a merge has changed a pair.
    """
    count = len(size)
    if not count:
        return symbols, size
    segment = np.repeat(np.arange(count), size)
    rank = np.full(len(symbols), _NONE, dtype=np.int32)
    rank[:-1] = np.where(segment[:-1] == segment[1:], _pair_ranks(model, symbols[:-1], symbols[1:]), _NONE)
    done_ids, done_segments = [], []
    while len(symbols):
        start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        least = np.minimum.reduceat(rank, start)
        of = np.repeat(least, np.diff(np.append(start, len(symbols))))
        over = of == _NONE
        if over.any():
            done_ids.append(symbols[over])
            done_segments.append(segment[over])
            symbols, segment, rank, of = symbols[~over], segment[~over], rank[~over], of[~over]
        hit = np.flatnonzero(rank == of)
        if not len(hit):
            continue
        alone = model.single[rank[hit]]
        if alone.any():
            hit = hit[~alone | np.append(True, segment[hit[1:]] != segment[hit[:-1]])]
        # of pairs that overlap, every second from the left
        new = np.append(True, hit[1:] != hit[:-1] + 1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        symbols[hit] = model.of_rank[rank[hit]]
        stay = np.ones(len(symbols), dtype=bool)
        stay[hit + 1] = False
        at = hit - np.arange(len(hit))  # places after the compaction
        symbols, segment, rank = symbols[stay], segment[stay], rank[stay]
        changed = np.concatenate([at, at[at > 0] - 1])
        ahead = np.minimum(changed + 1, len(symbols) - 1)
        pairs = (changed + 1 < len(symbols)) & (segment[changed] == segment[ahead])
        rank[changed] = np.where(pairs, _pair_ranks(model, symbols[changed], symbols[ahead]), _NONE)
    ids, segment = np.concatenate(done_ids), np.concatenate(done_segments)
    order = np.argsort(segment, kind="stable")
    return ids[order], np.bincount(segment, minlength=count)


class Encoder:
    """Encodes chunks of texts; remembers segments between them."""

    def __init__(self, path: str = MODEL):
        self.model, self.table = load(path), _char_table(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _segments(self, unique: np.ndarray, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Learn segments (by hash, in order, none of them known) given one place of each in the code points cp."""
        first = self.table[cp[start]]
        plain = first >= 0
        ids, counts = merge(self.model, self.table[cp[flat.spans(start[plain], size[plain])]], size[plain])
        lengths = np.empty(len(unique), dtype=np.int64)
        lengths[plain] = counts
        strange = np.flatnonzero(~plain)
        fallback = [self.model.bytes[list(chr(c).encode("utf-8", "replace"))] for c in cp[start[strange]]]
        lengths[strange] = [len(b) for b in fallback]
        begin = np.cumsum(lengths) - lengths
        flat_ids = np.empty(int(lengths.sum()), dtype=np.int32)
        flat_ids[flat.spans(begin[plain], counts)] = ids
        if fallback:
            flat_ids[flat.spans(begin[strange], lengths[strange])] = np.concatenate(fallback)
        at = np.searchsorted(self.known, unique)
        self.begin = np.insert(self.begin, at, begin + len(self.ids))
        self.size = np.insert(self.size, at, lengths)
        self.known = np.insert(self.known, at, unique)
        self.ids = np.concatenate([self.ids, flat_ids])

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), dtype=bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def encode(self, chunk: flat.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk and the number of each text's ids."""
        rows = len(chunk.rows)
        cp = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lead = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
        begin = lead[chunk.row_start]
        filled = np.flatnonzero(np.diff(begin))
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        cp = np.insert(np.where(cp == 32, MARK, cp), begin[filled], MARK)
        row_at = begin[filled] + np.arange(len(filled))
        strange = self.table[cp] < 0
        mark = cp == MARK
        cut = np.ones(len(cp), dtype=bool)
        cut[1:] = (mark[1:] & ~mark[:-1]) | strange[1:] | strange[:-1]
        cut[row_at] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(cp)))
        hashes = flat.ranges_hash(cp.astype(np.uint64), start, start + size)
        unique, where, of = np.unique(hashes, return_index=True, return_inverse=True)
        lost = self._missing(unique)
        if len(self.known) + np.count_nonzero(lost) > REMEMBERED:  # only between chunks: a chunk needs all of its own, however many
            self._forget()
            lost[:] = True
        if lost.any():
            self._segments(unique[lost], cp, start[where[lost]], size[where[lost]])
        at = np.searchsorted(self.known, unique)[of]
        ids = self.ids[flat.spans(self.begin[at], self.size[at])]
        owner = np.searchsorted(row_at, start, side="right") - 1
        counts = np.zeros(rows, dtype=np.int64)
        counts[filled] = np.bincount(owner, weights=self.size[at], minlength=len(filled)).astype(np.int64)
        return ids, counts


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the number of each text's bytes; the space that encoding puts first is dropped."""
    length = model.length[ids]
    data = model.surface[flat.spans(model.begin[ids], length)]
    ends = np.append(0, np.cumsum(length))
    bounds = ends[np.append(0, np.cumsum(counts))]
    size = np.diff(bounds)
    filled = np.flatnonzero(size)
    first = bounds[filled]
    spaced = data[first] == 32
    keep = np.ones(len(data), dtype=bool)
    keep[first[spaced]] = False
    size[filled[spaced]] -= 1
    return data[keep], size


def encode_documents(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every row; exact says whether decoding gives the text again.

    Null texts have null ids, no tokens count of their own (null) and exact null; empty
    texts have no ids.  Rows without an id and rows that are there twice keep their
    place; special tokens' names in a text are ordinary text; other columns are ignored.
    """

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for chunk in flat.chunks(batch.column(1), CHUNK_BYTES):
                ids, counts = encoder.encode(chunk)
                data, size = decode(encoder.model, ids, counts)
                told = np.zeros(len(counts), dtype=bool)
                same_size = size == np.diff(chunk.row_start)
                if same_size.all():
                    unlike = np.append(0, np.cumsum(data != chunk.data))
                    told = unlike[chunk.row_start[1:]] == unlike[chunk.row_start[:-1]]
                else:
                    bound = np.append(0, np.cumsum(size))
                    for i in np.flatnonzero(same_size):
                        told[i] = np.array_equal(data[bound[i] : bound[i + 1]], chunk.data[chunk.row_start[i] : chunk.row_start[i + 1]])
                valid = batch.column(1).slice(int(chunk.rows[0]), len(counts)).is_valid().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array(~valid) if not valid.all() else None)
                yield pa.record_batch(
                    [batch.column(0).slice(int(chunk.rows[0]), len(counts)), lists, pa.array(counts, pa.int32(), mask=~valid), pa.array(told, mask=~valid)], names=["doc_id", "ids", "n_tokens", "exact"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(flat.released(run), SCHEMA)


def decode_documents(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids.

    Null lists give null texts and empty lists empty ones; nulls in a list and ids that
    the model doesn't have are passed over; bytes that aren't UTF-8 become U+FFFD.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            column = batch.column(1)
            for lo in range(0, len(column), 500):
                part = column.slice(lo, 500)
                values = part.flatten()
                owner = np.repeat(np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)), part.drop_null().value_lengths().to_numpy(zero_copy_only=False))
                ids = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                good = (ids >= 0) & (ids < model.size)
                counts = np.bincount(owner[good], minlength=len(part))
                data, size = decode(model, ids[good], counts)
                bound = np.append(0, np.cumsum(size))
                texts = [bytes(data[bound[i] : bound[i + 1]]).decode("utf-8", "replace") if part[i].is_valid else None for i in range(len(part))]
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(flat.released(run), "doc_id LONG, text STRING")
