"""Spelling variants: words one error apart, found by search schemes on pairs of FM-indexes over the vocabulary.

Two words that differ by one inserted, deleted or replaced character share one half of the shorter search word: cut the word in two,
the error lies in one part and the other part stands at the same end of both words. So each word is searched twice: its right half is
matched exactly and extended to the left across the other half with one error, and, on the index of the reversed words, its left
half is matched exactly and extended to the right. An index lays its words between delimiters and keeps, for the sorted suffixes,
the character in front of each; a pattern is an interval of suffix ranks, one more character in front of it is two look-ups, and a
pattern with a delimiter at both ends is one word, whose rank among the delimiters is its number.

A word meets only words with the same half, so the vocabulary is dealt to shards by halves, and each shard is one index: a word is a query in
the shard of its half, and an entry in the shards of the halves that words of its length or one more or less can ask for. A shard with more than
``SHARD`` characters (one half may stand in a third of all words) is dealt on into blocks of entries, each searched by blocks of all of the shard's
queries, so the memory of a task is bounded and no pair is lost. What leaves a shard is one row for each query: the number of near
words and the most frequent one. Pairs that both searches find count in the first.

Words are the runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z in lower case. NULL and empty texts have none. All rows count, repeated
ones too; NULL keys have an empty text in the draw of ``planted``. Ties between forms go to the least word in code-point order. Very long
runs are words like others; the work for one grows with its length. Empty tables give no words.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, cut

LETTERS = "A-Za-zÀ-ÿ"
#: Characters of the entries of one index, and queries that one task searches in it.
SHARD, QUERIES = 400_000, 50_000
#: Queries whose partial matches are held at a time.
BATCH = 4096
_SIDES = ("right", "left")  # the half that is matched exactly


def runs(df: DataFrame, text: str, at_least: int, *carried: str) -> DataFrame:
    """(carried..., run): each maximal run of letters of at least so many code points, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"([{LETTERS}]{{{at_least},}})"), F.lit(1))
    run = F.col("run")
    # lower() would change letters beyond Z, which only words with bytes beyond ASCII have.
    lowered = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))
    return df.select(*(F.col(f"`{c}`") for c in carried), F.explode(found).alias("run")).withColumn("run", lowered)


def planted(run: Column, key: Column, every: int = 31) -> Column:
    """The run without one code point where the draw for (key, run) says so."""
    draw = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (draw % F.char_length(run)).cast("int")
    return F.when(draw % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, at_least: int = 7, times: int = 2) -> DataFrame:
    """(word, n) of all words of enough code points and occurrences; ``words`` is (word)."""
    counted = words.where(F.char_length("word") >= at_least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= times)


# --- index ------------------------------------------------------------------------------------------------------


class SuffixRanks:
    """FM-index of distinct words between delimiters; all searches work on arrays of intervals [low, high) of suffix ranks."""

    def __init__(self, words: list[str], letters: str):
        self.words = sorted(words)
        self.code = {c: k + 1 for k, c in enumerate(letters)}  # in code-point order; 0 is the delimiter
        self.size = len(letters) + 1
        joined = "\n" + "\n".join(self.words) + "\n"
        symbols = encoded(joined, letters)
        n = len(symbols)
        order = self._sorted_suffixes(symbols)
        before = symbols[order - 1].astype(np.int64)
        before[order == 0] = self.size  # nothing stands before the first delimiter
        by_symbol = np.argsort(before, kind="stable")
        self.before, self.width = before, n + 1
        self.keys = before[by_symbol] * self.width + by_symbol  # (symbol, rank), sorted
        less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.size))))[: self.size + 1]
        self.shift = less - np.searchsorted(self.keys, np.arange(self.size + 1) * self.width)
        self.delimiters = len(self.words) + 1

    def _sorted_suffixes(self, symbols: np.ndarray) -> np.ndarray:
        """Suffixes up to their next delimiter in order; equal ones in the order of their words, as the search needs it."""
        n = len(symbols)
        bits = max(1, int(self.size - 1).bit_length())
        step = 62 // bits
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(step):
            here = np.zeros(n, np.int64)
            here[: max(n - k, 0)] = symbols[k:]
            key = key << bits | np.where(alive, here, 0)
            alive &= here > 0
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | ~alive[order[1:]]  # one that has ended is never equal to another
        group = np.cumsum(new) - 1
        while True:
            start = np.flatnonzero(new)
            first = start[group]
            sizes = np.diff(np.append(start, n))
            open_ = np.flatnonzero(sizes[group] > 1)
            if not len(open_):
                return order
            rank = np.empty(n, np.int64)
            rank[order] = first
            inside = order[open_]
            key2 = rank[np.minimum(inside + step, n - 1)]
            again = np.lexsort((key2, first[open_]))
            order[open_] = inside[again]
            key2 = key2[again]
            same = np.zeros(len(open_), bool)
            same[1:] = (key2[1:] == key2[:-1]) & (first[open_][1:] == first[open_][:-1])
            new[open_] = ~same
            group = np.cumsum(new) - 1
            step *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        base, shift = symbol * self.width, self.shift[symbol]
        return np.searchsorted(self.keys, base + low) + shift, np.searchsorted(self.keys, base + high) + shift

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) of all letters that may stand before each interval."""
        wide = np.flatnonzero(high - low > 2 * self.size)
        narrow = np.flatnonzero(high - low <= 2 * self.size)
        widths = (high - low)[narrow]
        ends = np.cumsum(widths)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[narrow] - (ends - widths), widths)
        some = np.unique(np.repeat(narrow, widths) * (self.size + 1) + self.before[rows])
        state, letter = some // (self.size + 1), some % (self.size + 1)
        letters = np.arange(1, self.size)
        state = np.concatenate((state, np.repeat(wide, len(letters))))
        letter = np.concatenate((letter, np.tile(letters, len(wide))))
        real = (letter > 0) & (letter < self.size)
        return state[real], letter[real]

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all words that end in the last ``exact`` characters of a query and have one error before them."""
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        text = encoded("".join(queries), "".join(self.code))
        starts = np.cumsum(lengths) - lengths
        at = np.arange(len(queries))
        left, low, high = lengths.copy(), np.zeros(len(queries), np.int64), np.full(len(queries), self.delimiters)
        while True:  # the exact half, from its end
            open_ = np.flatnonzero(lengths[at] - left < exact[at])
            if not len(open_):
                break
            q = at[open_]
            left[open_] -= 1
            low[open_], high[open_] = self.extend(text[starts[q] + left[open_]], low[open_], high[open_])
            keep = high > low
            at, left, low, high = at[keep], left[keep], low[keep], high[keep]
        found: list[np.ndarray] = []
        turn, wrong = 0, [np.zeros(0, np.int64)] * 4  # (query, characters left, low, high) with the error behind them
        while len(at) or len(wrong[0]):
            next_symbol = np.where(left > 0, text[starts[at] + np.maximum(left - 1, 0)], 0)
            state, letter = self.children(low, high)
            to_low, to_high = self.extend(letter, low[state], high[state])
            own, rest = at[state], left[state]
            replaced = (rest > 0) & (letter != next_symbol[state])
            deleted = left > 0
            parts = [
                [own[replaced], rest[replaced] - 1, to_low[replaced], to_high[replaced]], [own, rest, to_low, to_high],
                [at[deleted], left[deleted] - 1, low[deleted], high[deleted]],
            ]
            goes_on = (rest > 0) & (letter == next_symbol[state])
            at, left, low, high = own[goes_on], rest[goes_on] - 1, to_low[goes_on], to_high[goes_on]
            # Those with an error already match one more character, or end at a delimiter.
            q, more, from_, to = wrong
            symbol = np.where(more > 0, text[starts[q] + np.maximum(more - 1, 0)], 0) if len(q) else np.zeros(0, np.int64)
            from_, to = self.extend(symbol, from_, to)
            ends = (more == 0) & (to > from_)
            found.append(q[ends] * len(self.words) + from_[ends])
            on = (more > 0) & (to > from_)
            parts.append([q[on], more[on] - 1, from_[on], to[on]])
            wrong = [np.concatenate(c) for c in zip(*parts)]
            turn += 1
            if turn % 16 == 0 and len(wrong[0]):  # errors at several places of a long run of equal letters lead to one pattern
                _, once = np.unique(np.stack(wrong), axis=1, return_index=True)
                wrong = [c[once] for c in wrong]
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))


def encoded(text: str, letters: str) -> np.ndarray:
    """Symbol numbers of a text over ``letters`` and line feeds."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    table = np.zeros(int(max(map(ord, letters), default=10)) + 1, np.int64)
    table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    return table[points]


def search(entries: list[tuple[str, int]], queries: list[str], side: str) -> pd.DataFrame:
    """For each query with near words among the entries: their number, and the most frequent (least word on ties)."""
    turned = (lambda w: w[::-1]) if side == "left" else (lambda w: w)
    counts = {turned(w): n for w, n in entries}
    index = SuffixRanks(list(counts), "".join(sorted({c for w in counts for c in w}.union(*map(set, queries)))))
    n_of = np.array([counts[w] for w in index.words], np.int64)
    plain = [turned(w) for w in index.words]
    by_name = np.empty(len(plain), np.int64)
    by_name[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
    best_order = np.empty(len(plain), np.int64)
    ranked = np.lexsort((by_name, -n_of))
    best_order[ranked] = np.arange(len(plain))
    rows = []
    for low in range(0, len(queries), BATCH):
        some = [turned(w) for w in queries[low : low + BATCH]]
        halves = np.array([matched(len(w), side) for w in some], np.int64)
        q, x = index.one_error(some, halves)
        if side == "left" and len(q):  # the other search has what also ends in the query's right half
            fresh = np.array([index.words[b][: len(some[a]) - halves[a]] != some[a][: len(some[a]) - halves[a]] for a, b in zip(q.tolist(), x.tolist())])
            q, x = q[fresh], x[fresh]
        if not len(q):
            continue
        first = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1))
        best = ranked[np.minimum.reduceat(best_order[x], first)]
        near = np.diff(np.append(first, len(q)))
        rows += [(queries[low + k], int(m), plain[b], int(n_of[b])) for k, m, b in zip(q[first].tolist(), near.tolist(), best.tolist())]
    return pd.DataFrame(rows, columns=["word", "n_near", "best", "best_n"])


def matched(length: int, side: str) -> int:
    """Characters of the half that is matched exactly."""
    return length - length // 2 if side == "right" else length // 2


# --- vocabulary in shards ---------------------------------------------------------------------------------------


def _placed(words: DataFrame, shards: int) -> DataFrame:
    """(side, shard, word, n, query): every word where it is searched for and where it may be found."""
    word, length = F.col("word"), F.char_length("word")
    rows = []
    for side in _SIDES:
        half = lambda of: (of - F.floor(of / 2)).cast("int") if side == "right" else F.floor(of / 2).cast("int")
        end = lambda k: word.substr(length - k + 1, k) if side == "right" else word.substr(F.lit(1), k)
        shard = lambda k: F.pmod(F.xxhash64(F.lit(side), end(k)), F.lit(shards)).cast("int")
        asked = [half(length + d) for d in (-1, 0, 1)]
        rows.append(F.array(F.struct(F.lit(side).alias("side"), shard(half(length)).alias("shard"), F.lit(True).alias("query"))))
        places = F.array_distinct(F.array(*(F.when((k > 0) & (k <= length), shard(k)) for k in asked)))
        places = F.filter(places, lambda p: p.isNotNull())
        rows.append(F.transform(places, lambda p: F.struct(F.lit(side).alias("side"), p.alias("shard"), F.lit(False).alias("query"))))
    return words.select("word", "n", F.inline(F.concat(*rows)))


def near_words(words: DataFrame, shard_chars: int = SHARD, shard_queries: int = QUERIES) -> DataFrame:
    """(word, n_near, best, best_n): the number of words one error away, and the most frequent of them; ``words`` is (word, n)."""
    words = cut(words)
    chars = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    placed = cut(_placed(words, max(1, math.ceil(4 * chars / shard_chars))))
    load = placed.groupBy("side", "shard").agg(
        F.ceil(F.sum(F.when(~F.col("query"), F.char_length("word"))) / shard_chars).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(F.col("query"), 1)) / shard_queries).cast("int").alias("turns"),
    )
    load = cut(load.where("blocks >= 1 AND turns >= 1"))  # others have nothing to find or nobody who asks
    pick = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "word"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = placed.join(load, ["side", "shard"]).select(
        "side", "shard", "word", "n", "query",
        F.when(F.col("query"), all_of("blocks")).otherwise(F.array(pick("blocks", 1))).alias("in_blocks"),
        F.when(F.col("query"), F.array(pick("turns", 2))).otherwise(all_of("turns")).alias("in_turns"),
    )
    dealt = dealt.select("side", "shard", "word", "n", "query", F.explode("in_blocks").alias("block"), "in_turns")
    dealt = dealt.select("side", "shard", "word", "n", "query", "block", F.explode("in_turns").alias("turn"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asks = part["query"].to_numpy(bool)
        entries = list(zip(part["word"][~asks], part["n"][~asks].tolist()))
        if not entries or not asks.any():
            return pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "best": pd.Series(dtype=str), "best_n": pd.Series(dtype="int64")})
        return search(entries, sorted(part["word"][asks]), key[0])

    found = dealt.groupBy("side", "shard", "block", "turn").applyInPandas(run, "word string, n_near long, best string, best_n long")
    order = F.struct((-F.col("best_n")).alias("least"), "best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("top"))
    return merged.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.least")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of the chain of forms. Each turn doubles the length that is known."""
    known = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return known


def groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word; ``words`` is (word, n).

    A word's form is the most frequent of its near words if that is at least ``ratio`` times as frequent, else NULL.
    """
    words = cut(words)
    near = near_words(words)
    is_form = F.col("best_n") >= F.col("n") * ratio
    out = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )
    return out.join(roots(out.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents) WHERE length(run) >= 7
), drawn AS (
    SELECT run, c, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL)
), words AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM drawn
), vocabulary AS (
    SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), shorter AS (
    SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)
), near AS (
    SELECT a.word AS word, b.word AS other FROM shorter a JOIN shorter b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN vocabulary w ON s.v = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN vocabulary w ON s.v = w.word
), ranked AS (
    SELECT near.word, other, n, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY near.word) AS n_near
    FROM near JOIN vocabulary ON vocabulary.word = other
), forms AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * v.n THEN other END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n
    FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND k = 1
), chain AS (
    SELECT word, form AS at FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL
), ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NULL)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends ON ends.word = forms.word
"""
