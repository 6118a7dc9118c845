"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of each text. A chunk ends at a word whose hash is the least among its neighbours' (``reach``
words on each side); the value depends on the last 16 bytes only, so an insertion moves the boundaries near it and no others.
(Least values lie more evenly than those that meet a divisor: a passage of some fifty words holds whole chunks but for freak
cases.) Chunks are known by a digest. A digest that stands at more than one place is a repeat; its first place (lowest
``doc_id``, then lowest position) is the one that stays.

Neighbouring later places make up a span, which then grows word by word on both sides for as long as its text goes on like that
around the first place of the chunk at its end, so that what is removed does not depend on where chunks happen to end. Spans
of fewer than ``min_words`` words are left alone. What a grown span covers is no first place any more.

Defined cases: NULL and empty texts have no chunks. Rows with the same ``doc_id`` and the same text are one document, and get
the same spans; rows with the same ``doc_id`` and different texts are told apart by their text. Rows without ``doc_id`` count
as one document after all others. A text without white space is one word, however long. Only the id and the text are read; other
columns pass through ``deduplicated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, cut, fresh, mix, slices

_WINDOW = 16
_GEAR = np.random.default_rng(19).integers(1, 2**64, 256, dtype=np.uint64)
_GEAR[0] = 0  # texts of a slice are set apart by zero bytes, which leave no trace in the hash
_LAST = (1 << 63) - 1


def gear(joined: np.ndarray) -> np.ndarray:
    """The gear hash of the last 16 bytes at each position: the sum of 2**j times the gear of the byte j places before."""
    h = _GEAR[joined]
    step = 1
    while step < _WINDOW:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint64(step)
        h = h + shifted
        step *= 2
    return h


def chunk_slice(texts: list[bytes], reach: int, max_words: int) -> tuple[np.ndarray, ...]:
    """Chunks of all texts: row, start, length (characters), words, digest, whether the row had it before, number of the first word."""
    pad = bytes(_WINDOW)
    raw = pad.join([b"", *texts, b""])
    joined = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = _WINDOW + np.concatenate(([0], np.cumsum(sizes[:-1] + _WINDOW))) if len(texts) else np.zeros(0, np.int64)
    outside = np.zeros(len(joined) + 1, dtype=np.int8)
    outside[text_start] += 1
    np.subtract.at(outside, text_start + sizes, 1)
    inside = np.cumsum(outside[:-1], dtype=np.int8) > 0
    word = inside & ~_SPACE[joined]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(text_start, starts, side="right") - 1
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    value = mix(gear(joined)[ends - 1])
    least = np.ones(len(starts), dtype=bool)
    for k in range(1, min(reach, len(starts) - 1) + 1):
        apart = row[k:] != row[:-k]
        least[:-k] &= apart | (value[:-k] < value[k:])
        least[k:] &= apart | (value[k:] <= value[:-k])
    ending = least | np.append(row[1:] != row[:-1], True)
    begin = np.flatnonzero(np.concatenate(([True], ending[:-1])))
    words = np.diff(np.append(begin, len(starts)))
    if words.max() > max_words:  # long runs without a boundary are cut evenly from their start
        parts = -(-words // max_words)
        begin = np.concatenate([np.arange(b, b + n, max_words) for b, n in zip(begin.tolist(), words.tolist())]) if len(begin) < 1000 else (
            np.repeat(begin, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * max_words
        )
        words = np.diff(np.append(begin, len(starts)))
    at, to = starts[begin], ends[begin + words - 1]
    owner = row[begin]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), to.tolist())), dtype=np.uint64, count=len(at)).view(np.int64)
    chars = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
    place = chars[at] - chars[text_start[owner]]
    again = np.ones(len(at), dtype=bool)
    again[np.unique(np.stack((owner, digests)), axis=1, return_index=True)[1]] = False
    return owner, place, chars[to] - chars[at], words, digests, again, begin - np.searchsorted(row, owner)


def _part(text: bytes) -> np.int32:
    return np.uint32(xxhash.xxh32_intdigest(text)).view(np.int32)


def chunks(df: DataFrame, text: str, key: str, reach: int, max_words: int) -> DataFrame:
    """(doc, part, word, start, length, words, digest, again) of every chunk; ``part`` tells texts of one ``doc`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = [(t or "").encode() for t in piece.column(0).to_pylist()]
                owner, place, length, words, digests, again, word = chunk_slice(texts, reach, max_words)
                docs = np.array(piece.column(1).to_pylist(), dtype=np.int64)
                parts = np.array([_part(t) for t in texts], dtype=np.int32)
                columns = [
                    pa.array(docs[owner], pa.int64()), pa.array(parts[owner], pa.int32()), *(pa.array(v, pa.int32()) for v in (word, place, length, words)),
                    pa.array(digests, pa.int64()), pa.array(again.astype(bool), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "word", "start", "length", "words", "digest", "again"])

    source = df.select(F.col(f"`{text}`"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)))
    return source.mapInArrow(run, "doc long, part int, word int, start int, length int, words int, digest long, again boolean")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LEFT, _RIGHT = 0, 1


def context(text: str, at: int, side: int, words: int) -> str:
    """The ``words`` words of a text before or after a place between words, or all that there are."""
    size = 16 * words
    while True:  # a longer stretch, until it holds the words and one that may be cut off
        stretch = text[at : at + size] if side == _RIGHT else text[max(0, at - size) : at]
        found = list(_WORD.finditer(stretch))
        if len(found) > words or len(stretch) < size:
            break
        size *= 4
    if not found:
        return ""
    return stretch[: found[:words][-1].end()] if side == _RIGHT else stretch[found[-words:][0].start() :]


def common(own: str, first: str, side: int) -> tuple[int, int]:
    """How many words two contexts share from their near end on, and how many characters of ``own`` these take."""
    mine, theirs = list(_WORD.finditer(own)), _WORD.findall(first)
    if side == _LEFT:
        mine, theirs = mine[::-1], theirs[::-1]
    n = 0
    while n < min(len(mine), len(theirs)) and mine[n].group() == theirs[n]:
        n += 1
    if n == 0:
        return 0, 0
    return n, mine[n - 1].end() if side == _RIGHT else len(own) - mine[n - 1].start()


def _contexts(requests: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(doc, part, word, digest, side, own, context) for requests (doc, part, side, at, word, digest, own), from (doc, part, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, part, w["word"], w["digest"], w["side"], w["own"], context(text, w["at"], w["side"], words))
                for doc, part, text, wanted in zip(batch["doc"], batch["part"], batch["text"], batch["wanted"]) for w in wanted
            ]
            yield pd.DataFrame(rows, columns=["doc", "part", "word", "digest", "side", "own", "context"])

    listed = requests.groupBy("doc", "part").agg(F.collect_set(F.struct("side", "at", "word", "digest", "own")).alias("wanted"))
    found = texts.join(listed, ["doc", "part"]).select("doc", "part", "text", "wanted")
    return found.mapInPandas(run, "doc long, part int, word int, digest long, side int, own boolean, context string").distinct()


def _spans(doc: int, part: int, found, grown, min_words: int) -> list[tuple]:
    """The spans of a text from its repeated chunks and the growth of its later ones, in words and characters."""
    growth = {(g["side"], g["word"]): (g["n"], g["chars"]) for g in (() if grown is None else grown)}
    runs: list[list] = []  # first word, end word, start, end, first document
    for c in found:
        if c["removed"]:
            if runs and runs[-1][1] == c["word"]:
                runs[-1][1], runs[-1][3], runs[-1][4] = c["word"] + c["words"], c["start"] + c["length"], min(runs[-1][4], c["first_doc"])
            else:
                runs.append([c["word"], c["word"] + c["words"], c["start"], c["start"] + c["length"], c["first_doc"]])
    later: list[list] = []
    for run in runs:
        left, right = growth.get((_LEFT, run[0]), (0, 0)), growth.get((_RIGHT, run[1]), (0, 0))
        run = [run[0] - left[0], run[1] + right[0], run[2] - left[1], run[3] + right[1], run[4]]
        while later and later[-1][1] >= run[0]:
            last = later.pop()
            run = [min(last[0], run[0]), max(last[1], run[1]), min(last[2], run[2]), max(last[3], run[3]), min(last[4], run[4])]
        later.append(run)
    later = [r for r in later if r[1] - r[0] >= min_words]
    first: list[list] = []
    k = 0
    for c in found:
        if c["removed"]:
            continue
        low, high = c["word"], c["word"] + c["words"]
        while k < len(later) and later[k][1] <= low:
            k += 1
        if k < len(later) and later[k][0] < high:
            continue
        if first and first[-1][1] == low:
            first[-1][1], first[-1][3], first[-1][4] = high, c["start"] + c["length"], min(first[-1][4], c["first_doc"])
        else:
            first.append([low, high, c["start"], c["start"] + c["length"], c["first_doc"]])
    return [
        (doc, part, r[2], r[3], r[1] - r[0], removed, r[4]) for removed, runs in ((True, later), (False, first)) for r in runs if r[1] - r[0] >= min_words
    ]


def repeated_spans(
    df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 16, reach: int = 3, max_words: int = 32,
) -> DataFrame:
    """(doc, part, start, end, n_words, removed, first_doc): the spans of repeated text, in characters, end exclusive.

    ``removed`` spans are the later places, the others the whole chunks of first places. ``first_doc`` is the lowest document in
    which a chunk of the span has its first place. A chunk has about 2 * ``reach`` + 1 words, ``max_words`` at most.
    """
    found = cut(chunks(df, text, key, reach, max_words))
    places = found.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.max("again").alias("twice"))
    repeated = cut(places.where((F.col("first_doc") != F.col("last_doc")) | F.col("twice")).select("digest", "first_doc"))
    removed = ((F.col("doc") != F.col("first_doc")) | F.col("again")).alias("removed")
    marked = found.join(repeated, "digest").select("doc", "part", F.struct("word", "start", "length", "words", removed, "first_doc", "digest").alias("chunk"))
    # The chunks of one text, so a list is bounded by the text.
    own = cut(marked.groupBy("doc", "part").agg(F.array_sort(F.collect_set("chunk")).alias("chunks")))

    def outer(side: int, step: int):
        """The chunks at one end of a run of later places, as requests."""
        def ends(c: Column, i: Column) -> Column:
            other = F.when(i + step >= 0, F.get("chunks", i + step))
            touches = (other["word"] == c["word"] + c["words"]) if side == _RIGHT else (other["word"] + other["words"] == c["word"])
            at, word = (c["start"] + c["length"], c["word"] + c["words"]) if side == _RIGHT else (c["start"], c["word"])
            goes_on = F.coalesce(other["removed"] & touches, F.lit(False))
            return F.when(c["removed"] & ~goes_on, F.struct(F.lit(side).alias("side"), at.alias("at"), word.alias("word"), c["digest"].alias("digest")))
        return F.filter(F.transform("chunks", ends), lambda e: e.isNotNull())

    ends = own.select("doc", "part", F.explode(F.concat(outer(_LEFT, -1), outer(_RIGHT, 1))).alias("end")).select("doc", "part", "end.*")
    # First places of the chunks at the ends; of several texts of one document that have it, the one of the lowest part.
    stays = own.select("doc", "part", F.explode(F.filter("chunks", lambda c: ~c["removed"])).alias("c"))
    firsts = stays.groupBy("c.digest").agg(F.min(F.struct("doc", "part", "c.start", "c.length")).alias("p")).select("digest", "p.*")
    at = F.when(F.col("side") == _LEFT, F.col("start")).otherwise(F.col("start") + F.col("length"))
    asked = ends.select("digest", "side").distinct().join(firsts, "digest").select("doc", "part", "side", at.alias("at"), F.lit(0).alias("word"), "digest", F.lit(False).alias("own"))
    requests = ends.select("doc", "part", "side", "at", "word", "digest", F.lit(True).alias("own")).unionByName(asked)

    @F.pandas_udf("int")
    def part_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_part(t.encode()) for t in texts], dtype="int32")

    texts = df.where(F.col(f"`{text}`") != "").select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("doc"), part_of(F.col(f"`{text}`")).alias("part"), F.col(f"`{text}`").alias("text")
    )
    around = cut(_contexts(requests, texts, 2 * max_words))
    first = around.where("NOT own").select("digest", "side", F.col("context").alias("first"))

    @F.pandas_udf("n int, chars int")
    def shared(own: pd.Series, first: pd.Series, side: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([common(*row) for row in zip(own, first, side)], columns=["n", "chars"])

    pairs = around.where("own").join(first, ["digest", "side"]).select("doc", "part", "side", "word", shared("context", "first", "side").alias("g"))
    grown = pairs.groupBy("doc", "part").agg(F.collect_set(F.struct("side", "word", "g.n", "g.chars")).alias("grown"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [s for row in zip(batch["doc"], batch["part"], batch["chunks"], batch["grown"]) for s in _spans(*row, min_words)]
            yield pd.DataFrame(out, columns=["doc", "part", "start", "end", "n_words", "removed", "first_doc"])

    whole = own.join(grown, ["doc", "part"], "left").select("doc", "part", "chunks", "grown")
    return whole.mapInPandas(join, "doc long, part int, start int, end int, n_words int, removed boolean, first_doc long")


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", **parameters: int) -> DataFrame:
    """All rows and columns of ``df``, the removed spans cut out of the text (with the white space before each)."""
    doc, part, gone = fresh(df, "doc_of_row", "part_of_row", "spans_of_row")
    spans = (
        cut(repeated_spans(df, text, key, **parameters)).where("removed")
        .groupBy(F.col("doc").alias(doc), F.col("part").alias(part)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(gone))
    )

    @F.pandas_udf("int")
    def part_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_part((t or "").encode()) for t in texts], dtype="int32")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _without(t, s) for t, s in zip(texts, spans)], dtype=object)

    keyed = df.withColumns({doc: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)), part: part_of(F.col(f"`{text}`"))})
    joined = keyed.join(spans, [doc, part], "left")
    value: Column = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(without(F.col(f"`{text}`"), F.col(gone)))
    return joined.withColumn(text, value).select(*(f"`{c}`" for c in df.columns))


def _without(text: str, spans) -> str:
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["start"]].rstrip())
        at = span["end"]
    return ("".join(kept) + text[at:]).lstrip()
