"""Near duplicates, repeated substrings, repeated line chunks, and benchmark passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from needmap.llm import decontamination, line_chunks, near_duplicates, substrings
from needmap.llm.common import importable
from needmap.llm.queries import ORACLE, QUERIES
from workbench.check import connect, difference

random.seed(3)
WORDS = ["".join(random.choices("abcdefgh", k=6)) for _ in range(4000)]
prose = lambda n: random.choices(WORDS, k=n)


def documents(spark, table="documents", folder=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/{table}.parquet").collect()]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows, percent):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, (i, s) in enumerate(sets):
        for other in {o for x in s for o in where[x] if o < k}:
            j, t = sets[other]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_of_the_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_near_duplicates"](spark, SMALL).collect()}
    want = brute_components(documents(spark), 85)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_large_groups_chains_and_borderline_pairs(spark):
    importable(spark)
    rows, base = [], prose(120)
    for k in range(150):  # a dense group: copies of one text with a few words changed each
        copy = list(base)
        for at in random.sample(range(120), random.choice([0, 0, 1, 1, 2])):
            copy[at] = random.choice(WORDS)
        rows.append((k, " ".join(copy)))
    chain = prose(200)
    for k in range(12):  # a chain: each is near the next, the ends are not near each other
        rows.append((200 + k, " ".join(chain)))
        for at in (7 * k, 7 * k + 3):
            chain[at] = random.choice(WORDS)
    for k in range(120):  # pairs on both sides of the threshold
        text = prose(100)
        other = list(text)
        for at in random.sample(range(5, 95), random.choice([1, 1, 2, 3])):
            other[at] = random.choice(WORDS)
        rows += [(1000 + 2 * k, " ".join(text)), (1001 + 2 * k, " ".join(other))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.with_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 85)


def test_pairs_within_a_dense_family_below_the_threshold(spark):
    importable(spark)
    chance, base = random.Random(11), prose(300)

    def changed(words, at):
        out = list(words)
        for k in at:
            out[k] = chance.choice(WORDS)
        return out

    rows = []
    for k in range(150):  # four words changed in each: any two have a similarity of about 0.76, but 2k and 2k + 1 share two changes
        first = chance.sample(range(5, 295, 6), 6)
        shared = changed(base, first[:2])
        rows += [(2 * k, " ".join(changed(shared, first[2:4]))), (2 * k + 1, " ".join(changed(shared, first[4:])))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.with_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows, 85)
    assert len({c for _, c in want.values()}) > 10
    assert got == want


def test_sketches_let_every_link_through(spark):
    importable(spark)
    chance, rows = random.Random(17), []
    for k in range(80):  # pairs on both sides of the threshold, from 6 to 5,000 words
        text = chance.choices(WORDS, k=chance.choice([6, 30, 150, 700, 5000]))
        rate = chance.choice([0.005, 0.015, 0.03, 0.1])
        other = [chance.choice(WORDS) if chance.random() < rate else w for w in text]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    sets = near_duplicates.features(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 5)
    x, y = sets.where("doc_id % 2 = 0").alias("x"), sets.where("doc_id % 2 = 1").alias("y")
    for percent in (80, 85):
        let = {r[0] for r in x.join(y, F.expr("y.doc_id = x.doc_id + 1")).where(near_duplicates.may_link("x", "y", percent)).select("x.doc_id").collect()}
        ratio = {2 * k: len(a & b) / len(a | b) for k in range(80) for a, b in [(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1]))]}
        linked = {i for i, r in ratio.items() if 100 * r >= percent}
        far = {i for i, r in ratio.items() if r < percent / 100 - 0.2}
        assert linked <= let and len(linked) > 10
        assert len(far) > 10 and not far & let


def test_near_duplicates_edges(spark):
    importable(spark)
    rows = [(5, None, 1), (4, "", 1), (3, " \t\n", 1), (None, "a b c d e f", 1), (9, "A b c d e f", 2), (8, "a b c d", 2), (7, "a B c d e f", 3), (7, "a B c d e f", 3), (2, "one", 1), (6, "ONE", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Component int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.with_components(df).collect())
    assert got == [(0, 2, None, True), (2, 1, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 2, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True), (9, 2, 7, False)]
    kept = near_duplicates.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 7, 7, 8]
    assert near_duplicates.with_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 5, 8])
def test_repeated_passages_are_found_and_clean_texts_left(spark, seed):
    importable(spark)
    random.seed(seed)
    rows, planted, clean, passages = [], set(), set(), {}
    for k in range(60):
        rows.append((k, " ".join(prose(200))))
        clean.add(k)
    for k in range(40):
        passage = " ".join(prose(random.randint(51, 70)))
        for d in (100 + 3 * k, 101 + 3 * k, 102 + 3 * k):
            rows.append((d, " ".join(prose(random.randint(0, 90))) + " " + passage + " " + " ".join(prose(random.randint(0, 90)))))
            planted.add(d)
            passages[d] = passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated_spans(df).collect()
    docs = {r.doc for r in found}
    assert planted <= docs and not clean & docs
    text = dict(rows)
    assert all(sum(text[r.doc][r.start : r.end] in t for t in text.values()) >= 2 for r in found)
    assert {r.doc for r in found if not r.removed} <= {100 + 3 * k for k in range(40)}
    after = {r.doc_id: r.text for r in substrings.deduplicated(df).collect()}
    assert all(after[d] == text[d] for d in clean) and all(len(after[d]) < len(text[d]) for d in planted if d % 3 != 1)
    for d, passage in passages.items():  # whole in the first of the three, gone to the last word from the others
        assert after[d] == text[d] if d % 3 == 1 else not set(passage.split()[::10]) & (set(after[d].split()) - set(text[d].replace(passage, "").split()))


def test_boundaries_resist_shifts():
    text = " ".join(prose(600)).encode()
    cuts = lambda t: {t.decode()[s : s + n] for s, n in zip(*substrings.chunk_slice([t], 3, 32)[1:3])}
    one, two = cuts(text), cuts(b"two inserted words here " + text)
    assert len(one & two) >= len(one) - 3


def test_substring_edges(spark):
    importable(spark)
    long = " ".join(prose(80))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (None, "é " + long, 0), (4, "x" * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans_of_row int")
    spans = substrings.repeated_spans(df).collect()
    assert {(r.doc == substrings._LAST, r.removed) for r in spans} == {(False, False), (True, True)}
    out = substrings.deduplicated(df)
    assert out.columns == df.columns and out.count() == 6
    assert {r.text for r in out.where("doc_id = 3").collect()} == {long}
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_line_chunks_twin(spark):
    assert difference(spark, connect(SMALL), QUERIES["op4_line_dedup"], ORACLE["op4_line_dedup"], SMALL) is None


def test_line_chunks_edges(spark):
    block = "\n".join(" ".join(prose(6)) for _ in range(30))
    rows = [(1, block, 0), (1, block, 0), (2, "new line\n" + block, 0), (None, block + "\nlast", 0), (3, None, 0), (4, "", 0), (5, "\n\n", 0), (6, block + "\n" + block, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, LINES_of_row int")
    out = line_chunks.deduplicated(df, removed="n")
    assert out.columns == [*df.columns, "n"]
    got = sorted(((r.doc_id or 99, r.text, r.n) for r in out.collect()), key=str)
    by = {d: (t, n) for d, t, n in got}
    assert by[1] == (block, 0) and by[3] == (None, 0) and by[4] == ("", 0) and by[5] == ("\n\n", 0)
    assert by[2][1] >= 20 and by[2][0].startswith("new line") and by[99][1] >= 20 and by[99][0].endswith("last") and by[6][1] >= 40
    assert line_chunks.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", [SMALL])
def test_decontamination_is_exact(spark, folder):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = [(i, t) for i, t in documents(spark, folder=folder)]
    # Passages with a word exchanged, left out or added, in the middle of other prose; most stay above the threshold.
    for k, text in enumerate(items.values()):
        words = text.split()
        at = random.randrange(len(words))
        edited = [words[:at] + ["zzz"] + words[at + 1 :], words[:at] + words[at + 1 :], words[:at] + ["zzz"] + words[at:], words][k % 4]
        docs.append((10_000 + k, " ".join(prose(30) + edited + prose(30))))
    benchmark = [*items.items(), (900, "tiny item"), (901, None), (902, ""), (None, "an item without any id at all")]
    docs += [(20_000, "here is a Tiny  item indeed"), (20_001, "tiny item"), (20_002, None), (20_003, ""), (20_004, "so an item without any id at all is here"), (20_004, "so an item without any id at all is here")]
    found = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string"))
    got = {(r.doc, r.item_id): (round(r.similarity, 9), r.start) for r in found.collect()}
    want = {}
    known = {}
    for i, text in benchmark:
        words = (text or "").lower().split()
        if words:
            known[i] = (len(words), Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))))
    sharing = defaultdict(set)
    for i, (_, own) in known.items():
        for x in own:
            sharing[x].add(i)
    for d, text in docs:
        words = (text or "").lower().split()
        pieces = {tuple(words[k : k + size]) for size in {len(x) for x in sharing} for k in range(len(words) - size + 1)}
        for i in set().union(*(sharing[x] for x in pieces & sharing.keys())):
            n, own = known[i]
            for start in range(max(1, len(words) - n + 1)):
                part = words[start : start + n]
                seen = Counter(tuple(part[k : k + 5]) for k in range(max(1, len(part) - 4))) if part else Counter()
                both = sum((own & seen).values())
                value = both / (sum(own.values()) + sum(seen.values()) - both)
                if value >= 0.8 and value > want.get((d, i), (0,))[0] + 1e-9:
                    want[d, i] = (round(value, 9), start)
    missed = {k for k in want if k not in got}
    assert not got.keys() - want.keys() and len(missed) <= 0.02 * len(want)
    assert all(got[k] == want[k] for k in got)


def test_decontamination_edges(spark):
    passage = " ".join(prose(20))
    rows = [(1, passage, 0), (None, "x " + passage, 0), (2, None, 0), (3, "", 0), (4, "other words", 0), (4, "other words", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Part_of_row int")
    benchmark = spark.createDataFrame([(1, passage), (1, passage)], "item_id long, text string")
    out = decontamination.decontaminated(df, benchmark)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 4]
    assert decontamination.decontaminated(df, benchmark.limit(0)).count() == 6
    assert decontamination.matches(df.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_line_dedup", "op6_licence_scan"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_components_of_stars_and_paths(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 600)] + [(7, 8), (8, 7), (9, 9)]
    got = {r.id: r.component for r in near_duplicates.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 500 for k in range(500, 600)} | {7: 7, 8: 7}
    assert got == want
    assert near_duplicates.components(spark.createDataFrame(links, "u long, v long").where(F.lit(False))).count() == 0
