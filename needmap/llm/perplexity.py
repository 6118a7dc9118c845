"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of word trigrams per language, and bands.

Word trigrams of all documents are counted by Spark, language by language. All lengths are counted alike: trigrams and bigrams
by the different words before them, words by the different bigrams that they end, so copies of a passage count once. Discounts
come from the counts of counts, one small table a language. The counts are open-ended, so the model is never held as a whole, nor
stored: words alone are. The words of the documents are dealt, with those before, to where all windows with the same middle word
are, and their trigrams on to where all with the same last word are; what stands around a hot word is dealt by the other word too.
Both go round by round, over the whole texts each time, so that a round's share alone is on disk; a first set of rounds gives the
counts of counts, a second judges. No trigram is pruned, no word left out. Each occurrence is judged by all others: it is taken off the
counts that judge it. Words and pairs are named by 64-bit hashes; a word's hash takes in its language (lowest four bits).

Below the single words stands their spelling: what they leave is shared out by a Kneser-Ney model of the byte trigrams of the
language's distinct words, each ended by a blank. It is kept as sorted arrays of n-gram codes with their log probabilities,
looked up by binary search. A language has at most 256**3 byte trigrams whatever the corpus holds, and languages are told apart
only up to ``LANGUAGES``, so such a model's size is bounded. Languages are spelled in groups whose models have ``AT_ONCE`` entries
together (a larger one is a group of its own), one group after the other, so a task holds one group's models at a time.

A document's perplexity is the exponential of the mean negative log probability of its words, given the two words before. The
band of a language runs a number of robust deviations below and above the median of the documents' log perplexity. Texts
scatter around it by a part of their own and by one that shrinks with the root of their length, so a document's difference is
divided by the root of ``spread``² + 1 / words before deviations are measured. A document outside its language's band is rejected.

NULL and empty texts have no words: they fail the base rules. A NULL language, or one that is not listed, counts as one common
language. Repeated rows are counted and judged each. All other columns stay. A text is cut into words as a whole, however long.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, fresh, mix, slices, stored

#: Languages with a model of their own; all others share one.
LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "tr", "zh")
#: Entries of the models that are held at once (each 12 bytes in a task's memory), unless one alone has more.
AT_ONCE = 8_000_000
#: Medians are taken over a histogram of this fixed width, so that they do not depend on how rows are partitioned.
WIDTH = 1e-4
#: Log probabilities are added up as whole multiples of this, so that sums do not depend on the order of rows.
UNIT = 1e-6
#: Symbols that are counted (fixed value of the rules).
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
#: Windows are counted in so many rounds at most, each over the whole texts, of so many bytes of text at least; they are judged in more, smaller rounds.
ROUNDS, PARTS = 4, 3
ROUND_BYTES = 24 << 20
#: The windows of about so many bytes of text make a bucket.
BUCKET_BYTES = 4 << 20
#: So many windows are dealt together: a chunk for a bucket names each of its words once.
WINDOWS = 1 << 20
_START = b"\x02\x02"  # stands before each text
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first bytes of eight


def _trigrams(text: bytes) -> np.ndarray:
    """Codes of all trigrams of a text, the first two with start bytes."""
    b = np.frombuffer(_START + text, dtype=np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def _all_trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Those of all texts, one text after the other, and their number in each."""
    b = np.frombuffer(b"".join(_START + t for t in texts), dtype=np.uint8).astype(np.int32)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 2)
    own = np.ones(len(b), dtype=bool)
    own[ends - 1] = own[ends - 2] = False
    return (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[own[:-2]], sizes


def language_of(column: Column) -> Column:
    return F.when(F.lower(column).isin(*LANGUAGES), F.lower(column)).otherwise("other")


def count_trigrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n) of the byte trigrams over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(language: str, codes: np.ndarray, n: np.ndarray) -> None:
            if language in sums:
                codes, n = np.concatenate((sums[language][0], codes)), np.concatenate((sums[language][1], n))
                codes, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at, weights=n).astype(np.int64)
            sums[language] = codes, n

        for batch in batches:
            for part in slices(batch):
                texts, languages = part.column(0).to_pylist(), np.array(part.column(1).to_pylist())
                for language in np.unique(languages):
                    own = [texts[k].encode() for k in np.flatnonzero(languages == language) if texts[k]]
                    if own:
                        codes, n = np.unique(_all_trigrams(own)[0], return_counts=True)
                        add(str(language), codes, n)
        for language, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes)), pa.array(codes, pa.int32()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    counted = df.select(F.col(f"`{text}`"), language_of(F.col(f"`{lang}`"))).mapInArrow(run, "lang string, code int, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more; see ``_discounts_of``."""
    return _discounts_of(*(int((counts == k).sum()) for k in (1, 2, 3, 4)))


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts from the counts of counts (Chen and Goodman); 0.5, 1, 1.5 where these are too few."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d >= 0).all() and (d[1:] <= [1, 2, 3]).all() else np.array([0, 0.5, 1.0, 1.5])


class Model:
    """The spelling of one language: sorted codes and log probabilities of trigrams, back-off weights and probabilities below them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, counts = codes[order].astype(np.int32), counts[order]
        low = np.zeros(256) + 1 / 256
        # Unigrams and bigrams are counted by the different bytes before them.
        bigrams, kinds = np.unique(self.codes & 0xFFFF, return_counts=True)
        singles = np.bincount(bigrams & 0xFF, minlength=256)
        d = _discounts(singles)
        total = max(int(singles.sum()), 1)
        kept = np.maximum(singles - d[np.minimum(singles, 3)], 0)
        low = kept / total + (1 - kept.sum() / total) * low
        self.bigrams = bigrams.astype(np.int32)
        pair, self.low_weight = self._level(kinds, bigrams >> 8, 256)
        self.pair = pair + self.low_weight[bigrams >> 8] * low[bigrams & 0xFF]
        contexts, at = np.unique(self.codes >> 8, return_inverse=True)
        triple, weight = self._level(counts, at, len(contexts))
        self.contexts, self.weight = contexts.astype(np.int32), weight
        below = self.pair[np.searchsorted(bigrams, self.codes & 0xFFFF)]
        self.log = np.log(triple + weight[at] * below).astype(np.float32)
        self.low = low

    @staticmethod
    def _level(counts: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities and what each context leaves to shorter ones (all, for a context without counts)."""
        d = _discounts(counts)[np.minimum(counts, 3)]
        total = np.bincount(context, weights=counts, minlength=n)
        weight = np.where(total > 0, np.bincount(context, weights=np.minimum(d, counts), minlength=n) / np.maximum(total, 1), 1.0)
        return np.maximum(counts - d, 0) / total[context], weight

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        out = self.log[at].astype(np.float64)
        new = np.flatnonzero(self.codes[at] != codes)
        if len(new):
            rest = codes[new] & 0xFFFF
            b = np.minimum(np.searchsorted(self.bigrams, rest), len(self.bigrams) - 1)
            p = np.where(self.bigrams[b] == rest, self.pair[b], self.low_weight[rest >> 8] * self.low[rest & 0xFF])
            c = np.minimum(np.searchsorted(self.contexts, codes[new] >> 8), len(self.contexts) - 1)
            out[new] = np.log(np.where(self.contexts[c] == codes[new] >> 8, self.weight[c], 1.0) * p)
        return out


def language_groups(counted: DataFrame, at_once: int = AT_ONCE) -> list[list[str]]:
    """The languages of stored counts in groups of ``at_once`` entries; one row a language reaches the driver."""
    groups: list[list[str]] = []
    held = at_once
    for language, entries in sorted(tuple(r) for r in counted.groupBy("lang").count().collect()):
        if held + entries > at_once:
            groups.append([])
            held = 0
        groups[-1].append(language)
        held += entries
    return groups


def train(counted: DataFrame, languages: list[str]) -> dict[str, Model]:
    """A spelling model for each of the languages, from the counts of all its words."""
    table = counted.where(F.col("lang").isin(*languages)).toPandas()
    return {language: Model(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) for language, own in table.groupby("lang")}


def _marks() -> np.ndarray:
    """What stands before a text, by language."""
    return _of_language(mix(np.arange(1, len(LANGUAGES) + 2, dtype=np.uint64)), np.arange(len(LANGUAGES) + 1))


def _of_language(hashes: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """The hashes with the number of their language in the lowest four bits."""
    return hashes & ~np.uint64(15) | languages.astype(np.uint64)


def _hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of joined texts that end with nine blanks, eight bytes of a word at a time."""
    space = _SPACE[joined]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    eight = np.ndarray((len(joined) - 7,), "<u8", joined.data, strides=(1,))
    sizes = ends - starts
    hashes = mix((eight[starts] & _FIRST[np.minimum(sizes, 8)]) ^ mix(sizes.astype(np.uint64)))
    rows, at = np.flatnonzero(sizes > 8), 8
    while len(rows) and at < 256:
        hashes[rows] = mix(hashes[rows] + (eight[starts[rows] + at] & _FIRST[np.minimum(sizes[rows] - at, 8)]))
        at += 8
        rows = rows[sizes[rows] > at]
    for k in rows.tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(joined[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, starts, ends


class Words:
    """The words of texts: ``hashes``, each text's after three marks, where words stand (``at``) and the ``row`` of their text.

    They are ``joined`` from ``starts`` to ``ends``.
    """

    def __init__(self, texts: list[bytes], languages: np.ndarray):
        self.joined = b" ".join(texts) + b" " * 9
        words, self.starts, self.ends = _hashes(np.frombuffer(self.joined, dtype=np.uint8))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        sizes = np.diff(np.searchsorted(self.starts, ends), prepend=0) + 3
        row = np.repeat(np.arange(len(texts)), sizes)
        self.hashes = _marks()[languages[row]]
        real = np.ones(len(row), dtype=bool)
        for k in range(3):
            real[np.cumsum(sizes) - sizes + k] = False
        self.at = np.flatnonzero(real)
        self.row = row[self.at]
        self.hashes[self.at] = _of_language(mix(words ^ self.hashes[self.at]), languages[self.row])


def _places(hashes: np.ndarray) -> np.ndarray:
    """For each place one that all places of the same hash share."""
    slots = 1 << max(10, (2 * len(hashes)).bit_length())
    slot = (hashes >> np.uint64(4) & np.uint64(slots - 1)).astype(np.int64)
    table = np.zeros(slots, dtype=np.int32)
    table[slot] = np.arange(len(slot), dtype=np.int32)
    out = table[slot]
    other = np.flatnonzero(hashes[out] != hashes)
    _, first, at = np.unique(hashes[other], return_index=True, return_inverse=True)
    out[other] = other[first][at]
    return out


def _texts(df: DataFrame, text: str, lang: str, *more: Column) -> DataFrame:
    index = F.array_position(F.array(*(F.lit(x) for x in (*LANGUAGES, "other"))), language_of(F.col(f"`{lang}`"))) - 1
    return df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")), index, *more)


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    for batch in batches:
        for part in slices(batch):
            yield part, part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_numpy().astype(np.int64)


def _named(languages: np.ndarray) -> pa.Array:
    return pa.array([*LANGUAGES, "other"]).take(pa.array(languages))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def _squeezed(numbers: np.ndarray) -> bytes:
    """The numbers byte by byte, lowest bytes first, compressed: small ones take one byte or less."""
    planes = np.ascontiguousarray(numbers).reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _runs(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and (bucket, from, to) of those that have rows."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    ends = np.bincount(bucket.astype(np.int64), minlength=buckets).cumsum().tolist()
    return order, [(k, low, high) for k, (low, high) in enumerate(zip([0, *ends[:-1]], ends)) if high > low]


def _deal(keys: np.ndarray, buckets: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket of keys: its numbers (64 bits each), column after column."""
    order, runs = _runs(keys % np.uint64(buckets), buckets)
    columns = [c[order] for c in columns]
    data = [_squeezed(np.stack([c[low:high].view(np.uint64) for c in columns], axis=1)) for _, low, high in runs]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, *_ in runs], pa.int32()), pa.array([high - low for _, low, high in runs], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "size", "data"],
    )


def _dealt(table: pa.Table, columns: int) -> np.ndarray:
    """The numbers of a bucket, a row of the array for each column."""
    parts = [_numbers(x, n * columns).reshape(-1, columns).T for n, x in zip(table.column("size").to_pylist(), table.column("data").to_pylist())]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), dtype=np.uint64)


_DEALT = "bucket int, size int, data binary"


class Chunks:
    """Rows of a bucket that name words by their number in ``words``, hashes that the row holds itself, and go to a shuffle squeezed."""

    def __init__(self, n_words: int):
        self.used, self.number, self.rows = np.zeros(n_words, dtype=bool), np.zeros(n_words, dtype=np.uint32), []

    def add(self, bucket: int, hashes: np.ndarray, ids: np.ndarray, *more: np.ndarray, of_words: tuple[np.ndarray, ...] = ()) -> None:
        """``ids`` (rows of an array) of ``hashes``; ``more`` numbers of the rows or of texts, ``of_words`` those of each word."""
        self.used[ids] = True
        words = np.flatnonzero(self.used)
        self.used[words] = False
        words = words[np.argsort(hashes[words])]
        self.number[words] = np.arange(len(words), dtype=np.uint32)
        more = [c.astype(np.uint64) if c.dtype != np.uint64 else c for c in (*(c[words] for c in of_words), *more)]
        self.rows.append((bucket, len(words), _squeezed(np.diff(hashes[words], prepend=np.uint64(0))), ids.shape[1], _squeezed(self.number[ids]), [len(c) for c in more], [_squeezed(c) for c in more]))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "n_words", "words", "size", "ids", "sizes", "more"])


_CHUNKS = "bucket int, n_words int, words binary, size int, ids binary, sizes array<int>, more array<binary>"


def _chunks(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
    """The different hashes of a bucket, rows of their numbers, the numbers of each chunk's words, and what else the chunks hold."""
    rows = table.to_pylist()
    hashes = [np.cumsum(_numbers(r["words"], r["n_words"]), dtype=np.uint64) for r in rows]
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    of_words = np.split(at, np.cumsum([len(h) for h in hashes])[:-1])
    ids = [own[_numbers(r["ids"], columns * r["size"], np.uint32).reshape(columns, -1)] for own, r in zip(of_words, rows)]
    more = [[_numbers(data, n) for n, data in zip(r["sizes"], r["more"])] for r in rows]
    return words, np.concatenate(ids, axis=1), of_words, more


class Rounds:
    """How the windows are dealt: in rounds by one of their words, one after the other; in buckets by that word, or a pair if it is hot, within a round."""

    def __init__(self, n_bytes: int, rounds: int):
        self.rounds = rounds
        share = n_bytes // rounds
        self.buckets = max(1, min(6, share >> 20), share // BUCKET_BYTES)

    @classmethod
    def of(cls, n_bytes: int) -> tuple[Rounds, Rounds]:
        """To count and to judge."""
        rounds = max(1, min(ROUNDS, n_bytes // ROUND_BYTES))
        return cls(n_bytes, rounds), cls(n_bytes, rounds * PARTS if n_bytes >= ROUND_BYTES else 1)

    def has(self, words: np.ndarray, k: int) -> np.ndarray:
        return (words >> np.uint64(4)) % np.uint64(self.rounds) == np.uint64(k)


def _language(word: str) -> Column:
    """The number of a word's language."""
    return F.col(word).bitwiseAND(F.lit(15)).cast("int")


class Hot:
    """Words that stand so often that one task should not have all that is around them: their sorted hashes."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def has(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), dtype=bool)
        return self.words[np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)] == words

    def bucket(self, words: np.ndarray, others: np.ndarray, buckets: int) -> np.ndarray:
        """By the word, or by it and the other word if it is hot."""
        keys, hot = mix(words), np.flatnonzero(self.has(words))
        keys[hot] = _pair(words[hot], others[hot])
        return keys % np.uint64(buckets)


def _deal_windows(batches: Iterator[pa.RecordBatch], hot: Hot, rounds: Rounds, k: int, keyed: bool = False) -> Iterator[pa.RecordBatch]:
    """The windows (word before, first, middle, last) whose middle word is of a round; with the keys of their texts, if wanted."""

    def dealt(windows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        order, runs = _runs(hot.bucket(windows[2], windows[1], rounds.buckets), rounds.buckets)
        windows, keys = windows[:, order], keys[order] if keyed else keys
        places, hashes, out = _places(windows.reshape(-1)).reshape(windows.shape), windows.reshape(-1), Chunks(windows.size)
        for bucket, low, high in runs:
            of_texts = ()
            if keyed:
                own = keys[low:high]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                of_texts = own[first], np.diff(first, append=len(own))
            out.add(bucket, hashes, places[:, low:high], *of_texts)
        return out.batch()

    held: list[np.ndarray] = []
    held_keys: list[np.ndarray] = []
    for part, texts, languages in _each_slice(batches):
        words = Words(texts, languages)
        own = rounds.has(words.hashes[words.at - 1], k)
        at = words.at[own]
        held.append(np.stack([words.hashes[at - k] for k in (3, 2, 1, 0)]))
        held_keys.append(part.column(2).to_numpy().view(np.uint64)[words.row[own]] if keyed else at[:0].view(np.uint64))
        if sum(w.shape[1] for w in held) >= WINDOWS:
            yield dealt(np.concatenate(held, axis=1), np.concatenate(held_keys))
            held, held_keys = [], []
    if held:
        yield dealt(np.concatenate(held, axis=1), np.concatenate(held_keys))


def _trigram_counts(n_words: int, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows their trigram; of the trigrams the different words before, middle and last word, and number of the first two."""
    before, first, middle, last = ids
    context = middle * n_words + first
    known = None
    if n_words > 1 << 21:  # three numbers do not fit in 63 bits
        known, context = np.unique(context, return_inverse=True)
    trigrams, of = np.unique(context * n_words + last, return_inverse=True)
    windows = np.sort(of * n_words + before)
    n = np.bincount(windows[np.diff(windows, prepend=-1) > 0] // n_words, minlength=len(trigrams))
    context, last = np.divmod(trigrams, n_words)
    number = np.cumsum(np.diff(context, prepend=context[:1]) > 0)
    return of, n, (context if known is None else known[context]) // n_words, last, number


def _pair_counts(n_words: int, middle: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Middle word, last word and number of trigrams of the pairs that these end with."""
    pairs = np.sort(middle * n_words + last)
    at = np.flatnonzero(np.diff(pairs, prepend=-1) > 0)
    return *np.divmod(pairs[at], n_words), np.diff(at, append=len(pairs))


def _sums(of: np.ndarray, n: np.ndarray, count: int) -> list[np.ndarray]:
    """Sum of the counts of each context, and how many of them are 1, 2 and more."""
    total = np.zeros(count, dtype=np.int64)
    np.add.at(total, of, n)
    return [total, *(np.bincount(of[own], minlength=count) for own in (n == 1, n == 2, n > 2))]


#: What is summed up of the counts: trigrams and pairs by language and count, pairs by last word, counts of pairs of hot words, hot words by count.
_TRIGRAMS, _PAIRS, _LAST, _OF_HOT, _HOT = range(5)


def count_windows(df: DataFrame, text: str, lang: str, rounds: Rounds, hot: Hot) -> tuple[DataFrame, list[str]]:
    """Stored (kind, a, b, n, total): ``n`` trigrams or pairs of language ``a`` have ``b`` (5: or more) different words before them, ``total``
    together; ``n`` different words stand before the word ``a``; ``n`` pairs of the hot word ``a`` have ``b`` (3: or more), ``total`` together.

    Copies of a passage count once, so they do not vouch for each other. The second value are the folders.
    """

    def find(k: int) -> Callable:
        return lambda batches: _deal_windows(batches, hot, rounds, k)

    def count(table: pa.Table) -> pa.Table:
        words, ids, *_ = _chunks(table, 4)
        _, n, middle, last, _ = _trigram_counts(len(words), ids)
        out = []

        def by_language(kind: int, last: np.ndarray, n: np.ndarray) -> None:
            cells = (words[last] & np.uint64(15)).astype(np.int64) * 6 + np.minimum(n, 5)
            number, total = np.bincount(cells, minlength=96), np.zeros(96, dtype=np.int64)
            np.add.at(total, cells, n)
            cells = np.flatnonzero(number)
            out.append((np.full(len(cells), kind), cells // 6, cells % 6, number[cells], total[cells]))

        by_language(_TRIGRAMS, last, n)
        middle, last, n = _pair_counts(len(words), middle, last)
        often = hot.has(words)[middle]
        by_language(_PAIRS, last[~often], n[~often])
        found = np.bincount(last[~often], minlength=len(words))
        lasts = np.flatnonzero(found)
        none = np.zeros(len(lasts), dtype=np.int64)
        out.append((none + _LAST, words[lasts].view(np.int64), none, found[lasts], none))
        middle, last, n = middle[often], last[often], n[often]
        out.append((np.full(len(n), _OF_HOT), words[middle].view(np.int64), words[last].view(np.int64), n, n * 0))
        return pa.table({name: np.concatenate(c).astype(np.int64) for name, c in zip(("kind", "a", "b", "n", "total"), zip(*out))})

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def row(kind: int, a: Column, b: Column, n: Column, total: Column) -> Column:
        return F.struct(F.lit(kind).cast("long").alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), n.cast("long").alias("n"), total.cast("long").alias("total"))

    a, b, n, one = F.col("a"), F.col("b"), F.col("n"), F.lit(1)
    of_hot = F.array(row(_PAIRS, _language("b"), F.least(n, F.lit(5)), one, n), row(_LAST, b, F.lit(0), one, F.lit(0)), row(_HOT, a, F.least(n, F.lit(3)), one, n))
    schema = "kind long, a long, b long, n long, total long"
    parts = []
    for k in range(rounds.rounds):
        found = summed(_texts(df, text, lang).mapInArrow(find(k), _CHUNKS).groupBy("bucket").applyInArrow(count, schema))
        if len(hot.words):
            found = summed(found.select(F.explode(F.when(F.col("kind") == _OF_HOT, of_hot).otherwise(F.array(F.struct("kind", "a", "b", "n", "total")))).alias("x")).select("x.*"))
        parts.append(stored(found))
    return functools.reduce(DataFrame.unionAll, [part for part, _ in parts]), [path for _, path in parts]


def distinct_words(df: DataFrame, text: str, lang: str, buckets: int) -> DataFrame:
    """(lang, last, spelling, n) of every word, ``spelling`` ended by a blank, ``n`` times in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, languages in _each_slice(batches):
            words = Words(texts, languages)
            places = _places(words.hashes)
            one = np.flatnonzero(places[words.at] == words.at)
            ids, n = words.hashes[words.at[one]], np.bincount(places, minlength=1)[words.at[one]].astype(np.uint64)
            order, runs = _runs(mix(ids) % np.uint64(buckets), buckets)
            ids, n, at = ids[order], n[order], one[order]
            starts, ends, rows = words.starts[at].tolist(), words.ends[at].tolist(), []
            for bucket, low, high in runs:
                spelled = b" ".join([words.joined[a:b] for a, b in zip(starts[low:high], ends[low:high])])
                rows.append((bucket, high - low, _squeezed(np.stack((ids[low:high], n[low:high]))), len(spelled), pa.compress(spelled, codec="zstd", asbytes=True)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "size", "data", "bytes", "spelled"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, n = np.concatenate([_numbers(r["data"], 2 * r["size"]).reshape(2, -1) for r in rows], axis=1)
        spelled = [w for r in rows for w in pa.decompress(r["spelled"], decompressed_size=r["bytes"], codec="zstd", asbytes=True).split(b" ")]
        ids, at, of = np.unique(ids, return_index=True, return_inverse=True)
        sums = np.zeros(len(ids), dtype=np.int64)
        np.add.at(sums, of, n.astype(np.int64))
        spelled = pa.array([spelled[k] + b" " for k in at.tolist()], pa.binary()).cast(pa.string())
        return pa.table({"lang": _named((ids & np.uint64(15)).astype(np.int64)), "last": ids.view(np.int64), "spelling": spelled, "n": sums})

    found = _texts(df, text, lang).mapInArrow(run, "bucket int, size int, data binary, bytes long, spelled binary")
    return found.groupBy("bucket").applyInArrow(merge, "lang string, last long, spelling string, n long")


def with_spelling(words: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(last, spelled) for stored words: the log probability of its bytes, the blank at its end included."""
    counted = cut(count_trigrams(words, "spelling", "lang"))
    parts = []
    for languages in language_groups(counted, at_once):
        model = words.sparkSession.sparkContext.broadcast(train(counted, languages))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, spelled = np.array(batch.column(0).to_pylist()), np.zeros(batch.num_rows)
                raw = batch.column(2).cast(pa.binary()).to_pylist()
                for language in np.unique(names):
                    rows = np.flatnonzero(names == language)
                    codes, sizes = _all_trigrams([raw[k] for k in rows])
                    logs = model.value[str(language)].log_probabilities(codes)
                    spelled[rows] = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(spelled)], names=["last", "spelled"])

        parts.append(words.where(F.col("lang").isin(*languages)).select("lang", "last", "spelling").mapInArrow(run, "last long, spelled double"))
    out = parts[0] if parts else words.select("last", F.lit(0.0).alias("spelled"))
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


class Level:
    """The discounts of n-grams of one length by language, from (language, count up to 5, number, total) rows of all of them."""

    def __init__(self, kinds: DataFrame):
        found, totals = np.zeros((len(LANGUAGES) + 1, 6), dtype=np.int64), np.zeros(len(LANGUAGES) + 1, dtype=np.int64)
        for language, kind, n, total in kinds.collect():
            found[language, kind] = n
            totals[language] += total
        #: By the number of the language: what is discounted from counts of 0, 1, 2 and more, and of all counts together; their total.
        self.discounts = np.array([_discounts_of(*of[1:5].tolist()) for of in found])
        self.held = np.array([float(sum(d[min(k, 3)] * n for k, n in enumerate(of) if n)) for d, of in zip(self.discounts, found)])
        self.total = totals

    @classmethod
    def of(cls, grams: DataFrame, word: str, count: str) -> Level:
        return cls(grams.groupBy(_language(word), F.least(F.col(count), F.lit(5))).agg(F.count("*"), F.sum(count)))


def without(gone: np.ndarray | int, n: np.ndarray, discounts: np.ndarray, total: np.ndarray, held: np.ndarray, sure, share) -> tuple[np.ndarray, np.ndarray]:
    """The probability as ``sure`` + ``share`` * spelling, given those of the shorter n-gram, with ``gone`` (0 or 1) taken off the count.

    ``discounts`` has a row for each count.
    """
    discount = lambda x: np.take_along_axis(discounts, np.minimum(x, 3)[:, None], axis=1)[:, 0]
    rest, all_of = n - gone, total - gone
    left = np.maximum(held - discount(n) + discount(rest), 0.0)
    own = np.maximum(rest - discount(rest), 0.0)
    known, over = all_of > 0, np.maximum(all_of, 1)  # a context without other counts leaves all to shorter ones
    return np.where(known, (own + left * sure) / over, sure), np.where(known, left * share / over, share)


class HotCounts:
    """What a task needs of hot words: as first of a pair the sum of its counts and how many are 1, 2 and more; as last word ``before`` and ``spelled``."""

    def __init__(self, hot: Hot, counted: DataFrame, words: DataFrame):
        self.sums = np.zeros((4, len(hot.words)), dtype=np.int64)
        self.known = np.zeros((3, 0), dtype=np.uint64)
        if len(hot.words):
            for word, kind, n, total in counted.where(F.col("kind") == _HOT).select("a", "b", "n", "total").collect():
                at = np.searchsorted(hot.words, np.uint64(word % (1 << 64)))
                self.sums[0, at] += total
                self.sums[kind, at] += n
            rows = words.join(words.sparkSession.createDataFrame(pd.DataFrame({"last": hot.words.view(np.int64)})), "last").select("last", "before", "spelled").toPandas()
            self.known = np.stack([rows["last"].to_numpy(np.int64).view(np.uint64), rows["before"].to_numpy(np.int64).view(np.uint64), rows["spelled"].to_numpy(np.float64).view(np.uint64)])


def text_logs(
    df: DataFrame, text: str, lang: str, key: Column, words: DataFrame, levels: tuple[Level, Level, Level], hot: Hot, counts: HotCounts, rounds: Rounds, k: int,
) -> DataFrame:
    """(key, steps, n) of each text: the log probabilities of its words after middle words of a round, in ``UNIT``, and their number.

    Modified Kneser-Ney. The occurrence that is judged is left out of the counts (with its copies, which have the same word
    before): else a trigram that the corpus has once would seem well known. Discounts are those of all counts. Windows meet by their
    middle word, where all counts of a context are, then each trigram with the keys of its texts by its last word, where all trigrams
    that end with its bigram are, and ``words``. Hot words are dealt on by the first and the middle word.
    """
    buckets, (three, two, one) = rounds.buckets, levels

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _deal_windows(batches, hot, rounds, k, keyed=True)

    def weigh(table: pa.Table) -> pa.Table:
        hashes, ids, _, more = _chunks(table, 4)
        keys = np.concatenate([np.repeat(texts, n.astype(np.int64)) for texts, n in more])
        of, n, middle, last, context = _trigram_counts(len(hashes), ids)
        contexts = _sums(context, n, int(context[-1]) + 1)
        pairs = _pair_counts(len(hashes), middle, last)
        sums = _sums(pairs[0], pairs[2], len(hashes))
        often = np.flatnonzero(hot.has(hashes))
        at = np.searchsorted(hot.words, hashes[often])
        for own, all_of in zip(sums, counts.sums):
            own[often] = all_of[at]
        order, runs = _runs(hot.bucket(hashes[last], hashes[middle], buckets), buckets)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        keys, found = keys[np.argsort(place[of])], np.bincount(of)[order]
        ends = np.concatenate(([0], np.cumsum(found)))
        middle, last, context, n, out = middle[order], last[order], context[order], n[order], Chunks(len(hashes))
        for bucket, low, high in runs:
            of_context = [c[context[low:high]] for c in contexts]
            out.add(bucket, hashes, np.stack([middle[low:high], last[low:high]]), n[low:high], *of_context, found[low:high], keys[ends[low] : ends[high]], of_words=sums)
        return pa.Table.from_batches([out.batch()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
            cold = ~hot.has(columns[0])
            columns = [c[cold] for c in columns]
            yield _deal(mix(columns[0]), buckets, columns)

    def judge(windows: pa.Table, known: pa.Table) -> pa.Table:
        if not windows.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "size": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        hashes, (middle, last), of_words, more = _chunks(windows, 2)
        sums = np.zeros((4, len(hashes)), dtype=np.int64)
        for own, numbers in zip(of_words, more):
            sums[:, own] = np.maximum(sums[:, own], np.stack(numbers[:4]).astype(np.int64))
        n, total, *held, found, keys = (np.concatenate(c) for c in zip(*(numbers[4:] for numbers in more)))
        n, total, found = n.astype(np.int64), total.astype(np.int64), found.astype(np.int64)
        low = np.concatenate((counts.known, _dealt(known, 3)), axis=1)
        low = low[:, np.argsort(low[0])]
        at = np.searchsorted(low[0], hashes[last])
        before, spelled = low[1, at].view(np.int64), low[2, at].view(np.float64)
        of = (hashes[last] & np.uint64(15)).astype(np.int64)
        _, pair, kinds = np.unique(middle * len(hashes) + last, return_inverse=True, return_counts=True)
        kinds, lone = kinds[pair], (n == 1).astype(np.int64)  # without a trigram seen once its bigram has one kind less
        all_held = lambda d, counts: sum(d[:, k] * c for k, c in enumerate(counts, 1))
        below = without(np.where(kinds == 1, lone, 0), before, one.discounts[of], one.total[of], one.held[of], 0.0, 1.0)  # and its word one bigram less
        d = two.discounts[of]
        below = without(lone, kinds, d, sums[0, middle], all_held(d, sums[1:, middle]), *below)
        d = three.discounts[of]
        sure, share = without(1, n, d, total, all_held(d, held), *below)
        # The spelling of a very long word is too small for a number: its logarithm is added where nothing else is known.
        with np.errstate(divide="ignore"):
            log = np.where(sure > 0, np.log(sure + share * np.exp(spelled)), np.log(share) + spelled)
        steps = np.floor(np.abs(log) / UNIT + 0.5).astype(np.int64) * np.sign(log).astype(np.int64)
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, at, np.repeat(steps, found))
        return pa.Table.from_batches([_deal(keys, buckets, [keys, sums.view(np.uint64), np.bincount(at, minlength=len(keys)).view(np.uint64)])])

    def add(table: pa.Table) -> pa.Table:
        keys, steps, n = _dealt(table, 3)
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.zeros((2, len(keys)), dtype=np.int64)
        np.add.at(sums[0], at, steps.view(np.int64))
        np.add.at(sums[1], at, n.view(np.int64))
        return pa.table({"key": keys.view(np.int64), "steps": sums[0], "n": sums[1]})

    dealt = _texts(df, text, lang, key).mapInArrow(find, _CHUNKS).groupBy("bucket").applyInArrow(weigh, _CHUNKS)
    low = words.select("last", "before", "spelled").mapInArrow(pack, _DEALT)
    judged = dealt.groupBy("bucket").cogroup(low.groupBy("bucket")).applyInArrow(judge, _DEALT)
    return judged.groupBy("bucket").applyInArrow(add, "key long, steps long, n long")


def medians(df: DataFrame, key: str, value: Column) -> dict[str, float]:
    """The lower median of ``value`` for each key, to the histogram's width; exact and independent of the partitioning.

    Rows are counted by key and cell before any meet; what a key's rows then make up is bounded by the range of the value.
    """
    cells = df.groupBy(key, F.round(value / WIDTH).cast("long").alias("cell")).count()
    up_to = F.sum("count").over(Window.partitionBy(key).orderBy("cell"))
    total = F.sum("count").over(Window.partitionBy(key))
    half = cells.select(key, "cell", up_to.alias("up_to"), total.alias("total")).where(F.col("up_to") * 2 >= F.col("total"))
    return {r[0]: r[1] * WIDTH for r in half.groupBy(key).agg(F.min("cell")).collect()}


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    joined = np.frombuffer(text, dtype=np.uint8)
    symbols = int(SYMBOLS[joined].sum())
    chars = int(((joined & 0xC0) != 0x80).sum()) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, at, found = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(found[at] >= 2)
        marked = np.zeros(n, dtype=bool)
        for k in range(3):
            marked[starts + k] = True
        repeated = int(marked.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` and the base counts."""
    out = {m.lower() for m in _FIELDS} | (set() if keep_text else {text.lower()})
    rest = [c for c in df.columns if c.lower() not in out]
    (t,) = fresh(df, "text_to_judge")
    source = df.select(F.col(f"`{text}`").alias(t), *(f"`{c}`" for c in rest))
    schema = T.StructType([*source.schema.fields[1:], *(T.StructField(m, T.LongType()) for m in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [base_counts((value or "").encode()) for value in part.column(0).to_pylist()]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_FIELDS))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*rest, *_FIELDS])

    return source.mapInArrow(run, schema)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within, the files of a query's shuffles go when it ends, so that those of successive rounds do not add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_perplexity(df: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """All columns of ``df``, the base counts and ``log_perplexity`` (NULL without words).

    Texts are matched with their perplexity by a 64-bit hash of text and language, so repeated rows need no name of their own:
    equal texts have equal means, and all their words together the same one.
    """
    place_of = F.xxhash64(F.col(f"`{text}`"), language_of(F.col(f"`{lang}`")))
    place, mean = fresh(df, "key_of_text", "mean_of_text")
    with shuffles_end(df.sparkSession):
        n_bytes = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
        counting, judging = Rounds.of(n_bytes)
        spelled, *paths = stored(distinct_words(df, text, lang, Rounds(n_bytes // 4, 1).buckets))
        often = spelled.where(F.col("n") > BUCKET_BYTES // 16).select("last").toPandas()["last"]
        hot = Hot(often.to_numpy(np.int64).view(np.uint64))
        counted, folders = count_windows(df, text, lang, counting, hot)
        before = counted.where(F.col("kind") == _LAST).groupBy(F.col("a").alias("last")).agg(F.sum("n").alias("before"))
        words = cut(before.join(with_spelling(spelled, at_once), "last"))
        of = lambda kind: Level(counted.where(F.col("kind") == kind).groupBy("a", "b").agg(F.sum("n"), F.sum("total")))
        levels, counts = (of(_TRIGRAMS), of(_PAIRS), Level.of(words, "last", "before")), HotCounts(hot, counted, words)
        discard(df.sparkSession, [*paths, *folders])
        found = [cut(text_logs(df, text, lang, place_of, words, levels, hot, counts, judging, k)) for k in range(judging.rounds)]
    found = functools.reduce(DataFrame.unionAll, found).groupBy("key").agg((-F.sum("steps") * UNIT / F.sum("n")).alias(mean))
    given = df.select(*(f"`{c}`" for c in df.columns if c.lower() != "log_perplexity")).withColumn(place, place_of)
    judged = with_counts(given, text, keep_text).join(found.withColumnRenamed("key", place), place, "left")
    return judged.withColumnRenamed(mean, "log_perplexity").drop(place)


def with_verdicts(
    df: DataFrame, text: str = "text", lang: str = "lang", deviations: float = 4.5, spread: float = 0.02, keep_text: bool = True, at_once: int = AT_ONCE,
) -> DataFrame:
    """All columns of ``df``, the base counts, ``base_failed``, ``log_perplexity``, its band ``lower`` and ``upper``, and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. Medians and deviations
    (median absolute deviation, scaled to a standard deviation) are those of all documents that pass the base rules.
    """
    judged = cut(with_perplexity(df, text, lang, keep_text, at_once))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    key, share = fresh(judged, "band_of", "share_of_length")
    judged = judged.withColumns({
        "base_failed": failed, key: language_of(F.col(f"`{lang}`")),
        share: F.sqrt(F.lit(spread * spread) + 1 / F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
    })
    passed = judged.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).select(key, share, "log_perplexity")
    middle = medians(passed, key, F.col("log_perplexity"))
    at = lambda values: F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col(key)], F.lit(0.0)) if values else F.lit(0.0)
    off = F.abs(F.col("log_perplexity") - at(middle)) / F.col(share)
    scale = {language: 1.4826 * middling for language, middling in medians(passed, key, off).items()}
    width = F.lit(deviations) * at(scale) * F.col(share)
    judged = judged.withColumns({"lower": at(middle) - width, "upper": at(middle) + width}).drop(key, share)
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
