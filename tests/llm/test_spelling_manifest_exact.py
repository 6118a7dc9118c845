"""Spelling variants, Merkle manifests and exact copies against brute force and their SQL twins."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from needmap.llm import exact, manifest, spelling
from needmap.llm.common import cut, importable
from needmap.llm.queries import ORACLE, QUERIES
from workbench.check import connect, difference


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_merkle_manifest", "op13_exact_dedup"])
def test_twins(spark, name):
    assert difference(spark, connect(SMALL), QUERIES[name], ORACLE[name], SMALL) is None


def test_stored_frames_have_measured_sizes(spark):
    df = spark.range(100).select("id", F.col("id").alias("ID"))
    for _ in range(12):  # a join's estimate is the product of its sides
        df = cut(df.toDF("a", "b").join(df.toDF("c", "d"), F.col("a") == F.col("c")).select("a", "d"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000 and df.count() == 100


# --- spelling ---------------------------------------------------------------------------------------------------


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_all_words_one_error_away(seed):
    chance = random.Random(seed)
    letters = ["ab", "abé", "abcdefgh"][seed % 3]
    counts = {"".join(chance.choices(letters, k=chance.randint(1, 9))): chance.randint(2, 40) for _ in range([3, 60, 250][seed % 3])}
    got = defaultdict(lambda: (0, (0, "")))
    for side in ("right", "left"):
        for w, near, best, n in spelling.search(list(counts.items()), sorted(counts), side).itertuples(index=False):
            before, top = got[w]
            got[w] = (before + near, min(top, (-n, best)))
    for w in counts:
        others = [x for x in counts if is_near(w, x)]
        assert got[w] == (len(others), min(((-counts[x], x) for x in others), default=(0, "")))


def test_suffixes_are_sorted_up_to_their_delimiter():
    words = sorted({"a" * k for k in range(1, 90)} | {"ab" * k for k in range(1, 40)} | {"b"})
    index = spelling.SuffixRanks(words, "ab")
    symbols = spelling.encoded("\n" + "\n".join(words) + "\n", "ab")
    order = index._sorted_suffixes(symbols).tolist()
    text = "\n" + "\n".join(words) + "\n"
    assert order == sorted(range(len(text)), key=lambda k: (text[k : text.find("\n", k) + 1] if text[k] != "\n" else "\n", k))


def test_groups_with_hot_halves_split_into_blocks(spark):
    importable(spark)
    chance = random.Random(5)
    hot = ["prefix" + "".join(chance.choices("abcd", k=6)) for _ in range(600)]
    words = {w: chance.choice([2, 3, 40, 500]) for w in [*hot, "prefixa", "prefixé", "x" * 5000, "x" * 4999]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_words(df, shard_chars=900, shard_queries=70).collect()}
    for w in words:
        others = [x for x in words if is_near(w, x)]
        best = min(((-words[x], x) for x in others), default=None)
        assert near.get(w) == ((len(others), best[1], -best[0]) if best else None)


def test_words_of_texts(spark):
    importable(spark)
    rows = [(k, f"Abcdefgh {k} ÀBCDEFGH-abcdefgh x", 1) for k in range(70)] + [(None, "abcdefgh", 1), (5, None, 1), (6, "", 1), (7, "zz" * 5000, 1), (7, "zz" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Word int")
    counts = Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n > 1}
    vocabulary = spelling.vocabulary(spelling.runs(df, "text", 7, "doc_id").select(spelling.planted(F.col("run"), F.col("doc_id")).alias("word")))
    got = {r.word: r for r in spelling.groups(vocabulary).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    for w, r in got.items():
        best = min(((-counts[x], x) for x in counts if is_near(w, x)), default=None)
        assert (r.form, r.form_n) == ((best[1], -best[0]) if best and -best[0] >= 10 * counts[w] else (None, None))
    assert spelling.groups(vocabulary.limit(0)).count() == 0


def test_roots_follow_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("a", "w11"), ("b", "a")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(got.values()) == {"w11"} and len(got) == 13


# --- manifest ---------------------------------------------------------------------------------------------------

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    """Root, and for each leaf its proof of (left, right)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            low = place - place % 3
            run = nodes[low : low + 3]
            proofs[k].append(("".join(run[: place - low]), "".join(run[place - low + 1 :])))
        nodes, at = [H("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], proofs


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_of_trees_of_all_sizes(spark, height):
    importable(spark)
    chance, rows = random.Random(height), []
    for size in [*range(1, 12), 27, 28, 100]:
        rows += [(k, f"s{size}", H(f"{size} {k}"), "x") for k in range(size)]
    rows += [(k, None, H(f"null {k}"), "x") for k in range(4)] + [(7, "same", H("a"), "x"), (7, "same", H("b"), "y"), (7, "same", H("b"), "y"), (None, "same", H("c"), "x"), (1, "", H("e"), "x")]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, Place string")
    got = manifest.manifest(df, height=height)
    assert got.columns == [*df.columns, "subroot", "root", "proof"]
    got = sorted((r.source or "", r.source is not None, -1 if r.doc_id is None else r.doc_id, r.leaf, r.Place, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got.collect())
    trees = defaultdict(list)
    for d, s, leaf, other in rows:
        trees[(s is not None, s or "")].append((-1 if d is None else d, leaf, other))
    keys = sorted(trees)
    tops = {k: brute_tree([x[1] for x in sorted(trees[k])]) for k in keys}
    root, upper = brute_tree([tops[k][0] for k in keys])
    want = []
    for k, above in zip(keys, upper):
        for (d, leaf, other), proof in zip(sorted(trees[k]), tops[k][1]):
            want.append((k[1], k[0], d, leaf, other, tops[k][0], root, proof + above))
    assert got == sorted(want)


def test_manifest_edges_and_tampering(spark):
    importable(spark)
    rows = [(1, "a", "x\n" * 200_000), (2, "a", None), (3, None, ""), (4, "a", "é")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    digest = manifest.leaf(F.col("doc_id"), F.col("source"), F.col("text"))
    leaves = df.select("doc_id", "source", digest.alias("leaf"))
    assert {r.doc_id: r.leaf for r in leaves.collect()} == {
        d: H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, t))) for d, s, t in rows
    }
    proved = manifest.manifest(leaves).withColumn("folded", manifest.folded(F.when(F.col("doc_id") == 1, F.lit(H("other"))).otherwise(F.col("leaf")), F.col("proof")))
    assert {r.doc_id: r.folded == r.root for r in proved.collect()} == {1: False, 2: True, 3: True, 4: True}
    one = manifest.manifest(leaves.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].root == one[0].subroot == one[0].leaf and one[0].proof == []
    assert manifest.manifest(leaves.limit(0)).count() == 0


# --- exact copies -----------------------------------------------------------------------------------------------


def brute_copies(rows):
    groups = defaultdict(list)
    for k, (d, text) in enumerate(rows):
        groups[text or ""].append((d is not None, d or 0, k))
    return {k: (max(g)[1] if max(g)[0] else None, len(g)) for g in groups.values() for *_, k in g}, sum(1 for _ in groups)


@pytest.mark.parametrize("bounds", [None, exact.level_bounds(1, 1, 12), exact.level_bounds(2, 2, 4)])
def test_copies_by_bytes(spark, bounds):
    chance = random.Random(9)
    texts = ["".join(chance.choices("aé", k=chance.randint(0, 9))) for _ in range(150)] + ["hot " * 30] * 90 + ["hot " * 30 + "x", "hot " * 29, None, "", "y" * 400_000, "y" * 400_000, "y" * 400_000 + "z"]
    texts += ["x" * 32, "x" * 32, "x" * 160, "x" * 160]  # these end with a level
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "hot " * 30), (None, "alone, without a key"), (3, texts[3])]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, Bytes_0 long")
    out = exact.with_copies(df, bounds=bounds)
    assert out.columns == [*df.columns, "keep_id", "group_size", "kept"]
    got = out.collect()
    want, n_groups = brute_copies(rows)
    assert sorted((r.Bytes_0, r.text, r.keep_id, r.group_size) for r in got if r.text is not None) == sorted((k, t, *want[k]) for k, (_, t) in enumerate(rows) if t is not None)
    assert sum(r.kept for r in got) == n_groups and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_edges(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (2, "a", 0), (None, None, 1), (None, "", 2)], "doc_id long, text string, Kept int")
    out = exact.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (2, "a")]
    assert exact.with_copies(df.limit(0)).count() == 0
    replaced = exact.with_copies(df)
    assert replaced.columns == ["doc_id", "text", "keep_id", "group_size", "kept"] and replaced.count() == 5
