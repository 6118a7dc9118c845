"""Byte-level BPE by corpus-level merge replay: encoding to ids and decoding back.

The distinct pretokens of a block of texts are laid out as one row of symbols. An inverted index leads from the rank of a
mergeable token pair to the positions where the pair stands. Merges are replayed in rank order; each looks only at its own
positions and enters the two pairs it makes with its neighbours. Every occurrence of a pretoken in the block then takes the
ids of that pretoken. Pretokens do not influence each other, so the ids do not depend on how texts fall into blocks.

NULL texts count as empty: no ids, and empty bytes back. Rows are neither dropped nor merged, repeated rows stay, all other
columns pass through. Memory is bounded by a slice of texts (or one longer text) and by ``CACHE`` kept pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, gather, list_array, slices
from .vocabulary import PATTERN, Store, read_ranks

#: Pieces of text whose ids a Python worker keeps for its next texts; a larger store is emptied.
CACHE = 250_000
#: Bytes of text that are replayed together, and distinct pretokens of one replay.
BLOCK_BYTES = 4 << 20
BLOCK = 250_000


def plain_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pretoken, by the definition: merge the leftmost pair of the lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


class Replay:
    """Merge replay over blocks of distinct pretokens, all occurrences of a pair at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted(
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        )
        self.pair = np.array([p for p, _ in pairs], dtype=np.int64)
        self.made = np.array([r for _, r in pairs], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of ids makes, -1 where it makes none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.made[at], -1)

    def block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the number of ids of each."""
        symbol = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbol)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        pair = np.full(n, -1, dtype=np.int64)  # rank of the pair that starts at a position
        pair[:-1] = np.where(after[:-1] >= 0, self.rank(symbol[:-1], symbol[1:]), -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(pair >= 0)
        if len(some):
            enter(some, pair[some])
        late: list[np.ndarray] = []  # positions in words where a merge made a pair of a lower rank
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            at = at[pair[at] == r]
            if len(at) == 0:
                continue
            if len(at) > 1:
                if len(groups) == 1:
                    at = np.unique(at)
                follows = after[at[:-1]] == at[1:]
                if follows.any():  # overlapping pairs of a run: from the left, every second one
                    keep, last = [], -1
                    for p, q in zip(at.tolist(), after[at].tolist()):
                        if p != last:
                            keep.append(p)
                            last = q
                    at = np.array(keep)
            gone = after[at]
            symbol[at] = r
            symbol[gone] = -1
            pair[gone] = -1
            follower = after[gone]
            after[at] = follower
            inside = follower >= 0
            before[follower[inside]] = at[inside]
            leader = before[at]
            touched = np.concatenate((at, leader[leader >= 0]))
            right = after[touched]
            made = self.rank(symbol[touched], symbol[right])  # position -1 is only read, and not used
            made[right < 0] = -1
            pair[touched] = made
            mergeable = made >= 0
            if mergeable.any():
                touched, made = touched[mergeable], made[mergeable]
                if made.min() < r:
                    late.append(touched[made < r])
                enter(touched, made)
        alive = symbol >= 0
        counts = np.diff(np.concatenate(([0], np.cumsum(alive)[ends - 1])))
        ids = symbol[alive]
        if late:  # the order inside such a word is settled by the definition
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.unique(np.searchsorted(ends, np.concatenate(late), side="right")).tolist():
                parts[k] = np.array(plain_merges(words[k], self.ranks), dtype=np.int64)
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts


class Encoder:
    """Ids of texts; the pieces of a block are learned together, then looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.replay, self.pattern = Replay(ranks), regex.compile(pattern)
        self.letters_stay = pattern == PATTERN  # a space and letters are one pretoken then
        self.store = Store(self.compute, CACHE)
        self.learn = self.store.learn

    def compute(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Replays the merges over the distinct pretokens of the pieces; the ids of the pieces."""
        row: dict[str, int] = {}
        flat, sizes = [], np.ones(len(new), dtype=np.int64)
        for k, p in enumerate(new):
            if self.letters_stay and p[1:].isalpha() and p[0] == " ":
                flat.append(row.setdefault(p, len(row)))
                continue
            cut = self.pattern.findall(p)
            sizes[k] = len(cut)
            flat += [row.setdefault(t, len(row)) for t in cut]
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        words = [w.encode("utf-8", "replace") for w in row]
        for low in range(0, len(words), BLOCK):
            block_ids, block_counts = self.replay.block(words[low : low + BLOCK])
            ids.append(block_ids)
            counts.append(block_counts)
        ids, counts, flat = np.concatenate(ids), np.concatenate(counts), np.array(flat, dtype=np.int64)
        lengths = np.bincount(np.repeat(np.arange(len(new)), sizes), weights=counts[flat], minlength=len(new)).astype(np.int64)
        return ids[gather(np.cumsum(counts) - counts, counts, flat)], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (learned) texts one after the other, and the number of ids of each."""
        store = self.store
        rows, sizes = store.rows(texts)
        ends = np.concatenate(([0], np.cumsum(store.lengths[rows])))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return store.values[gather(store.starts, store.lengths, rows)], np.diff(ends[bounds])


class Decoder:
    """Bytes of lists of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted((i, t) for t, i in ranks.items())
        self.last = tokens[-1][0]
        lengths = np.full(self.last + 1, -1, dtype=np.int64)
        lengths[[i for i, _ in tokens]] = [len(t) for _, t in tokens]
        self.known = lengths >= 0
        self.sizes = np.where(self.known, lengths, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(t for _, t in tokens), dtype=np.uint8)

    def decode(self, values: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each list, from the joined ids and the number of ids of each."""
        if len(values) and (values.min() < 0 or values.max() > self.last or not self.known[values].all()):
            raise ValueError("an id is not in the vocabulary")
        joined = self.letters[gather(self.starts, self.sizes, values)].tobytes()
        offset = np.concatenate(([0], np.cumsum(self.sizes[values])))
        bounds = offset[np.concatenate(([0], np.cumsum(counts)))]
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(joined)])


_encoders: dict[int, Encoder] = {}


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN, decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """All columns of ``df`` and ``ids`` (array of int): the text encoded by the ranks in the file ``path``.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A NULL text gives an empty array.
    An existing column of the name ``ids`` is replaced. With ``decoded`` a column of that name has the bytes that the ids stand for; both
    are made in one pass of one Python worker. Without ``keep_text`` the text is not sent back.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    made = {ids.lower(), decoded.lower() if decoded else ids.lower()}
    rest = [c for c in df.columns if c.lower() not in made and (keep_text or c != text)]
    (carried,) = fresh(df, "text_to_encode")
    source = df.select(F.col(f"`{text}`").alias(carried), *(f"`{c}`" for c in rest))
    schema = T.StructType([*source.schema.fields[1:], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = T.StructType([*schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(ranks.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(ranks.value, pattern)
        encoder = _encoders[key]
        decoder = Decoder(ranks.value) if decoded else None
        try:
            for block, part in ((b, p) for batch in batches for b in slices(batch, limit=BLOCK_BYTES) for p in [None, *slices(b, limit=BLOCK_BYTES // 4)]):
                if part is None:
                    encoder.learn([t or "" for t in block.column(0).to_pylist()])
                else:
                    values, lengths = encoder.encode([t or "" for t in part.column(0).to_pylist()])
                    out = [list_array(values, lengths, pa.int32())]
                    if decoder:
                        out.append(decoder.decode(values, lengths))
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], names=schema.names)
        finally:
            encoder.store.forget()  # a worker lives on for other stages

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``decoded`` (binary): the bytes that the ids stand for; NULL ids give empty bytes.

    An id outside the vocabulary is an error. An existing column of the name ``decoded`` is replaced.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    rest = [c for c in df.columns if c.lower() != decoded.lower()]
    (carried,) = fresh(df, "ids_to_decode")
    source = df.select(F.col(f"`{ids}`").alias(carried), *(f"`{c}`" for c in rest))
    schema = T.StructType([*source.schema.fields[1:], T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in batches:
            # Row by row within bounds: a slice has about SLICE_BYTES ids.
            column = batch.column(0)
            counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
            ends = np.cumsum(counts)
            low = 0
            while low < batch.num_rows:
                high = max(int(np.searchsorted(ends, ends[low] - counts[low] + (1 << 19), side="right")), low + 1)
                part = batch.slice(low, high - low)
                out = decoder.decode(np.asarray(part.column(0).flatten(), dtype=np.int64), counts[low:high])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], out], names=[*rest, decoded])
                low = high

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes the texts and decodes the ids: all columns but the text, and ``ids`` and ``decoded``."""
    return encode(df, path, text, decoded="decoded", keep_text=False)
