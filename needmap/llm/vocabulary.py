"""Byte-pair vocabularies: ranks read on the driver and shipped to the tasks (a vocabulary file is about a megabyte)."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np
import regex

#: How the vocabularies cut a text before any merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; files above this size are refused.
LIMIT_BYTES = 64 << 20
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    ranks = {}
    with open(path, "rb") as lines:
        _refuse_large(lines)
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def read_json_vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """Token bytes to id, pairs to merge rank, and special strings, from a byte-level tokenizer description."""
    with open(path, "rb") as file:
        _refuse_large(file)
        described = json.load(file)
    byte = {c: b for b, c in _visible_bytes().items()}
    plain = lambda token: bytes(byte[c] for c in token)
    special = [t["content"] for t in described["added_tokens"]]
    ids = {plain(t): i for t, i in described["model"]["vocab"].items() if t not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"])
    return ids, {(plain(a), plain(b)): r for r, (a, b) in enumerate(pairs)}, special


def _refuse_large(file) -> None:
    size = file.seek(0, 2)
    file.seek(0)
    if size > LIMIT_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is not broadcast")


def _visible_bytes() -> dict[int, str]:
    """Byte to the printable character that stands for it: itself if printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def is_unsafe(piece: str) -> bool:
    """Whether a part between two spaces may belong together with its neighbours, or is empty."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def pieces(text: str) -> list[str]:
    """The text cut at each single space between two other characters; that space belongs to what follows, but is left out.

    The pattern always cuts there and looks back no further, so pieces can be worked on one by one and, as they repeat,
    once each. ``text.split(" ")`` gives the same where no part of it is unsafe.
    """
    return _SAFE.split(text)


class Store:
    """Lists of numbers for the pieces of texts, each worked out once: ``compute`` gets distinct new pieces in full.

    A store of more than ``limit`` pieces is emptied before the next block of texts is learned.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.compute, self.limit = compute, limit
        self.forget()

    def forget(self) -> None:
        #: A piece that follows a space is known by its text; the first of a text, and any that is unsafe, by a tuple.
        self.known: dict[str | tuple[str, str], int] = {}
        self.values, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keys(self, text: str) -> list[str | tuple[str, str]]:
        head, *rest = pieces(text)
        return [("head", head), *(("rest", p) if is_unsafe(p) else p for p in rest)]

    def learn(self, texts: list[str]) -> None:
        if len(self.known) > self.limit:
            self.forget()
        found: set[str | tuple[str, str]] = set()
        for t in texts:
            head, *rest = t.split(" ")
            found.add(("head", head))
            found.update(rest)
        unsafe = {p for p in found if isinstance(p, str) and is_unsafe(p)}
        found -= unsafe
        for t in texts:
            head, _, rest = t.partition(" ")
            if is_unsafe(head) or unsafe and not unsafe.isdisjoint(rest.split(" ")):
                found.update(self.keys(t))
        new = [p for p in found if p not in self.known]
        values, lengths = self.compute([" " + p if isinstance(p, str) else p[1] if p[0] == "head" else " " + p[1] for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts = np.concatenate((self.starts, len(self.values) + np.cumsum(lengths) - lengths))
        self.values = np.concatenate((self.values, values.astype(np.int32)))
        self.lengths = np.concatenate((self.lengths, lengths))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all pieces of learned texts, and the number of pieces of each text."""
        known, rows, sizes = self.known, [], []
        for t in texts:
            before = len(rows)
            head, *rest = t.split(" ")
            try:
                if is_unsafe(head):
                    raise KeyError(head)
                rows.append(known[("head", head)])
                rows += [known[p] for p in rest]
            except KeyError:
                del rows[before:]
                rows += [known[k] for k in self.keys(t)]
            sizes.append(len(rows) - before)
        return np.array(rows, dtype=np.int64), np.array(sizes, dtype=np.int64)
