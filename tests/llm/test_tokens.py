"""Prefix counts and byte-pair encoding against the public libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from needmap.llm import bpe, token_counts
from needmap.llm.common import importable
from needmap.llm.vocabulary import PATTERN, read_json_vocabulary, read_ranks

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "a  b", "  a", "x ", "a\n\n b's we're'll x'r", "a" * 90, "日本語のテキスト  　x", "don't  \t\n x", "a \n b", "   x", "é🙂🙂" + " " * 50 + "y", "'''s 's",
    "1234 5६७", "abababab" * 6, "\x1c \x1dq", "a<|endoftext|>b  <|endoftext|> c", "<|endoftext|>", "x  <|endoftext|>  ", "I'll've 're'd\n\n\n\tend \n", "a\xa0 b \xa0c",
]
random.seed(1)
ODD += ["".join(random.choice(["a", "the", " ", "  ", "\n", "'s", "'re", "!", "9", "é", "　", "'", "L", "<|endoftext|>", ".", " x"]) for _ in range(14)) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_counts_of_every_prefix(library):
    counter = token_counts.PrefixCounter(*read_json_vocabulary(JSON))
    counter.learn(ODD + [""])
    values, lengths = counter.tables(ODD)
    at = 0
    for text, n in zip(ODD, lengths):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert values[at : at + n].tolist() == want, text
        at += n


def test_pairs_that_stay_two_by_their_seams():
    vocabulary = read_json_vocabulary(JSON)
    counter, chance = token_counts.PrefixCounter(*vocabulary), random.Random(4)
    ids, merges, _ = vocabulary
    assert counter.formed and len(counter.formed) == len(ids)
    tokens = sorted(ids, key=ids.get)
    near = [(t[:k], t[k:]) for t in chance.sample(tokens, 1500) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    pairs = near + [(a, a) for a in tokens[:600]] + [(chance.choice(tokens[:3000]), chance.choice(tokens)) for _ in range(3000)]
    for a, b in pairs:
        assert counter.stay_two(a, b) == (token_counts.merged(a + b, merges) == [a, b]), (a, b)


def test_totals_of_whole_texts(spark, library):
    importable(spark)
    rows = [(k, t, k) for k, t in enumerate([*ODD, "word and word " * 30_000, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, Text_to_count int")
    counted = token_counts.with_token_counts(df, JSON)
    assert counted.columns == ["doc_id", "text", "Text_to_count", "n_tokens"]
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t, _ in rows}
    assert token_counts.with_token_counts(df, JSON, count="Doc_id", keep_text=False).columns == ["Text_to_count", "Doc_id"]
    assert token_counts.with_token_counts(df.limit(0), JSON).count() == 0


def test_counts_answer_budgets(spark, library):
    importable(spark)
    text = "Counting tokens of prefixes, without encoding them again. " * 3
    rows = [(1, text, 5), (2, None, 6), (3, "", 7), (1, text, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_to_count int")
    counted = token_counts.with_prefix_counts(df, JSON)
    assert counted.columns == ["doc_id", "text", "text_to_count", "prefix_counts"]
    got = counted.select(
        "doc_id", token_counts.total("prefix_counts").alias("n"), token_counts.tokens_of_prefix("prefix_counts", 9).alias("nine"),
        token_counts.longest_prefix("prefix_counts", 4).alias("cut"), token_counts.longest_prefix("prefix_counts", -1).alias("none"),
    ).collect()
    n = lambda t: len(library.encode(t).ids)
    cut = max(k for k in range(len(text) + 1) if n(text[:k]) <= 4)
    assert sorted(map(tuple, got)) == [(1, n(text), n(text[:9]), cut, -1)] * 2 + [(2, 0, None, 0, -1), (3, 0, None, 0, -1)]
    assert token_counts.with_prefix_counts(df.limit(0), JSON).count() == 0


def test_encoding_is_that_of_the_library():
    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks)
    encoder.learn(ODD)
    ids, counts = encoder.encode(ODD)
    for text, part in zip(ODD, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == library.encode_ordinary(text), text


def test_merges_that_make_a_lower_rank_keep_their_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"ba": 300, b"ab": 400, b"aba": 350, b"abab": 450}
    words = [b"abab", b"aab", b"babab", b"abaab"]
    ids, counts = bpe.Replay(ranks).block(words)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [bpe.plain_merges(w, ranks) for w in words]


def test_round_trip_of_odd_rows(spark):
    importable(spark)
    rows = [(1, "Hello  world\n", 1), (None, "naïve 🙂", 2), (2, None, 3), (3, "", 4), (3, "", 4), (4, "x" * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = bpe.round_trip(df, RANKS)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out.collect())
    assert got == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.round_trip(df.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([999999],)], "ids array<int>"), RANKS).collect()
