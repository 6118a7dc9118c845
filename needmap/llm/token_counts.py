"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For each pretoken the table over its bytes holds, at each length, the last token of that prefix's encoding and the number of
tokens. The last token at a length is the one vocabulary token ending there that may follow the last token of the rest: the
two, encoded together, stay two. The count is then the count of the rest plus one, so all prefixes of a pretoken are counted
in one pass. A text's table is made of those of its pieces, each worked out once, and answers how many tokens a prefix has and
where to cut for a budget without encoding anything again.

Counts are those of the tokenizers library for the file, without begin and end tokens; special strings inside a text are one
token, as is its default. ``prefix_counts[k]`` is the count of the first ``k`` characters (code points), from 0 to the whole
text. NULL and empty texts have the table ``[0]``; a very long text is one table, worked out piece by piece. All rows and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, gather, list_array, slices
from .vocabulary import PATTERN, Store, pieces, read_json_vocabulary

#: Pieces of text whose tables a Python worker keeps for its next texts; a larger store is emptied.
CACHE = 300_000
#: Bytes of text whose pieces are worked out together.
BLOCK_BYTES = 8 << 20
_PRETOKEN = regex.compile(PATTERN)
_RUNS = regex.compile(r"(\s*)(\S*)")


def merged(word: bytes, merges: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The tokens of one pretoken, by the definition: merge the leftmost pair of the lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def last_merges(ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> dict[bytes, tuple[int, bytes, bytes]]:
    """For each token that its own bytes give: the rank of its last merge (-1 for a byte) and the two parts of it.

    Empty if some pair has a lower rank than a merge that makes one of its parts; then merges do not come in the order of their ranks.
    """
    found: dict[bytes, tuple[int, bytes, bytes]] = {}
    for token in ids:
        if len(token) == 1:
            found[token] = (-1, b"", b"")
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2 and (parts[0], parts[1]) in merges:
            found[token] = (merges[parts[0], parts[1]], parts[0], parts[1])
    regular = all(found[t][0] < r for pair, r in merges.items() for t in pair if t in found)
    return found if regular else {}


class PrefixCounter:
    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int], special: list[str], formed: dict[bytes, tuple[int, bytes, bytes]] | None = None):
        self.ids, self.merges, self.longest = ids, merges, max(map(len, ids))
        self.formed = last_merges(ids, merges) if formed is None else formed
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.block: dict[str, list[int]] = {}  # tables of the pretokens of the texts at hand
        self.special_strings = special
        self.store = Store(self.compute, CACHE)

    def may_follow(self, pair: tuple[bytes, bytes]) -> bool:
        if len(self.follows) > 300_000:
            self.follows.clear()
        fits = self.follows[pair] = self.stay_two(*pair)
        return fits

    def stay_two(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens, encoded together, stay two.

        Merges come in the order of their ranks, those of one rank from the left. So the tokens on both sides of the seam are followed back in
        time: the one that was formed later is undone, and no pair at the seam may have had its turn before that.
        """
        formed, merges = self.formed, self.merges
        if left not in formed or right not in formed:
            return merged(left + right, merges) == [left, right]
        before = len(merges)  # ranks below this had their turn while the two stood at the seam
        while True:
            if merges.get((left, right), before) < before:
                return False
            l, r = formed[left][0], formed[right][0]
            if l < 0 and r < 0:
                return True
            if l > r:
                before, left = l, formed[left][2]
            else:  # of equal ranks the seam has its turn before what is right of it
                before, right = r + 1, formed[right][1]

    def stands(self, token: bytes) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = token in self.formed or merged(token, self.merges) == [token]
        return found

    def byte_counts(self, words: list[bytes]) -> Iterator[list[int]]:
        """The number of tokens of each prefix of each pretoken, from one byte on; words in order share their prefixes' work."""
        ids, longest, follows, may_follow = self.ids, self.longest, self.follows, self.may_follow
        done, last, counts = b"", [b""], [0]
        for word in words:
            same, shorter = 0, min(len(done), len(word))
            while same < shorter and done[same] == word[same]:
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    token = word[start:end]
                    if token in ids:
                        if start:
                            pair = (last[start], token)
                            fits = follows.get(pair)
                            if fits is None:
                                fits = may_follow(pair)
                        else:
                            fits = self.stands(token)
                        if fits:
                            last.append(token)
                            counts.append(counts[start] + 1)
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            done = word
            yield counts[1:]

    def pretoken(self, token: str) -> list[int]:
        """The number of tokens of each prefix of a pretoken, by characters."""
        found = self.block.get(token)
        return found if found is not None else self.pretokens([token])[0]

    def pretokens(self, tokens: list[str]) -> list[list[int]]:
        out = []
        for token, counts in zip(tokens, self.byte_counts([t.encode("utf-8", "replace") for t in tokens])):
            if not token.isascii():
                end, kept = -1, []
                for c in token:
                    end += len(c.encode("utf-8", "replace"))
                    kept.append(counts[end])
                counts = kept
            if len(token) == 3 and token[0] == "'" and token[1:].isalpha():
                counts[1] = 2  # 'r of 're is cut into two pretokens as long as the e is missing
            out.append(counts)
        return out

    def piece(self, piece: str) -> list[int]:
        """The number of tokens of each prefix of a piece: a part of a text that is cut the same whatever surrounds it.

        White space is one pretoken while nothing follows it. Once something follows, its last character stands alone or,
        if a space, belongs to what follows.
        """
        out: list[int] = []
        total = 0
        for run, rest in _RUNS.findall(piece):
            if run:
                out += [total + c for c in self.pretoken(run)]
            if not rest:
                break
            if len(run) > 1:
                total += self.pretoken(run[:-1])[-1]
            glued = run[-1:] == " "
            if run and not glued:
                total += self.pretoken(run[-1])[-1]
            counts: list[int] = []
            for token in _PRETOKEN.findall(" " + rest if glued else rest):
                table = self.pretoken(token)
                counts += [total + c for c in table]
                total += table[-1]
            out += counts[1:] if glued else counts
        return out

    def text(self, text: str) -> list[int]:
        """The table of one text with special strings in it, from the empty prefix on."""
        out, done = [0], 0
        for found in self.special.finditer(text) if self.special else ():
            part = self.plain(text[done : found.end() - 1])  # one character short of the special string it is ordinary text
            out += [out[-1] + c for c in part]
            before = out[found.start()]
            out.append(before + 1)
            done = found.end()
        return out + [out[-1] + c for c in self.plain(text[done:])]

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        total = 0
        for k, p in enumerate(pieces(text) if text else ()):
            counts = self.piece(" " + p if k else p)
            out += [total + c for c in counts]
            total += counts[-1]
        return out

    def compute(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of distinct pieces; their distinct pretokens are worked out in order."""
        words = {" "}
        for p in new:
            if p[1:].isalpha() and p[0] == " ":
                words.add(p)
            else:
                words.update(_PRETOKEN.findall(p))
        words = sorted(words, key=lambda w: w.encode("utf-8", "replace"))
        block = self.block = dict(zip(words, self.pretokens(words)))
        tables = [block[p] if p in block else self.piece(p) for p in new]
        self.block = {}
        lengths = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables))
        return np.fromiter((c for t in tables for c in t), dtype=np.int32, count=int(lengths.sum())), lengths

    def learn(self, texts: list[str]) -> None:
        self.store.learn([t for t in texts if not self.has_special(t)])

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special_strings)

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all (learned) texts one after the other, and the length of each."""
        store = self.store
        special = {k: np.array(self.text(t), dtype=np.int32) for k, t in enumerate(texts) if self.has_special(t)}
        rows, sizes = store.rows(["" if k in special else t for k, t in enumerate(texts)] if special else texts)
        lengths = store.lengths[rows]
        last = store.starts[rows] + lengths - 1
        totals = np.where(lengths > 0, store.values[last] if len(store.values) else 0, 0).astype(np.int64)
        # Tokens before each piece within its own text.
        sums = np.concatenate(([0], np.cumsum(totals)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        base = sums[:-1] - np.repeat(sums[bounds[:-1]], sizes)
        flat = store.values[gather(store.starts, store.lengths, rows)] + np.repeat(base, lengths)
        widths = np.diff(np.concatenate(([0], np.cumsum(lengths)))[bounds]) + 1
        out = np.zeros(len(flat) + len(texts), dtype=np.int32)
        filled = np.ones(len(out), dtype=bool)
        filled[np.cumsum(widths) - widths] = False
        out[filled] = flat
        if special:
            parts = np.split(out, np.cumsum(widths)[:-1])
            for k, part in special.items():
                parts[k], widths[k] = part, len(part)
            out = np.concatenate(parts)
        return out, widths


    def totals(self, texts: list[str]) -> np.ndarray:
        """The last entry of the table of each (learned) text; the tables of its pieces are not laid out."""
        store = self.store
        special = {k: self.text(t)[-1] for k, t in enumerate(texts) if self.has_special(t)}
        rows, sizes = store.rows(["" if k in special else t for k, t in enumerate(texts)] if special else texts)
        lengths = store.lengths[rows]
        last = np.maximum(store.starts[rows] + lengths - 1, 0)
        sums = np.concatenate(([0], np.cumsum(np.where(lengths > 0, store.values[last] if len(store.values) else 0, 0).astype(np.int64))))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = sums[bounds[1:]] - sums[bounds[:-1]]
        for k, n in special.items():
            out[k] = n
        return out


_counters: dict[int, PrefixCounter] = {}


def _counted(df: DataFrame, path: str, text: str, name: str, kind: T.DataType, work, keep_text: bool) -> DataFrame:
    """All columns of ``df`` and what ``work`` makes of the texts of a slice; an existing column of that name is replaced."""
    ids, merges, special = read_json_vocabulary(path)
    vocabulary = df.sparkSession.sparkContext.broadcast((ids, merges, special, last_merges(ids, merges)))
    rest = [c for c in df.columns if c.lower() != name.lower() and (keep_text or c != text)]
    (carried,) = fresh(df, "text_to_count")
    source = df.select(F.col(f"`{text}`").alias(carried), *(f"`{c}`" for c in rest))
    schema = T.StructType([*source.schema.fields[1:], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(vocabulary.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = PrefixCounter(*vocabulary.value)
        counter = _counters[key]
        try:
            for block, part in ((b, p) for batch in batches for b in slices(batch, limit=BLOCK_BYTES) for p in [None, *slices(b)]):
                if part is None:
                    counter.learn([t or "" for t in block.column(0).to_pylist()] + [""])
                else:
                    out = work(counter, [t or "" for t in part.column(0).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], out], names=[*rest, name])
        finally:
            counter.store.forget()  # a worker lives on for other stages

    return source.mapInArrow(run, schema)


def with_prefix_counts(df: DataFrame, path: str, text: str = "text", counts: str = "prefix_counts") -> DataFrame:
    """All columns of ``df`` and ``prefix_counts`` (array of int); an existing column of that name is replaced."""
    work = lambda counter, texts: list_array(*counter.tables(texts), pa.int32())
    return _counted(df, path, text, counts, T.ArrayType(T.IntegerType(), False), work, True)


def with_token_counts(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` and ``n_tokens`` (long), the last entry of each text's table; the tables stay in the worker.

    An existing column of that name is replaced. Without ``keep_text`` the text is not sent back.
    """
    work = lambda counter, texts: pa.array(counter.totals(texts), type=pa.int64())
    return _counted(df, path, text, count, T.LongType(), work, keep_text)


def tokens_of_prefix(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters; NULL beyond the text."""
    return F.get(counts, n_chars if isinstance(n_chars, Column) else F.lit(n_chars))


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1)


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens; -1 for a negative budget."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    from_end = F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True).cast("int")
    return F.when(from_end > 0, F.size(counts) - from_end).otherwise(-1)
