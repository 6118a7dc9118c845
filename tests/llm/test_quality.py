"""Quality classifier and perplexity rules."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from needmap.llm import classifier, perplexity
from needmap.llm.common import importable, shared_folder
from needmap.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_isotonic_pools_violators():
    out = classifier.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 0.6, 0.3, 1.0]))
    assert np.allclose(out, [0, 0.4, 0.4, 1])


def test_classifier_on_held_out_documents(spark):
    rows = QUERIES["op8_quality_classifier"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 30 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_classifier_does_not_read_ids_or_languages(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    score = lambda d: {r.doc_id: round(r.score, 9) for r in classifier.with_scores(d, labels, keep_text=False).select("doc_id", "score").collect()}
    assert score(docs) == score(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")))


def test_classifier_edges(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.5), (None, "", 0.5), (1, "a b c", 0.5)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (7, 0), (2, 5)], "doc_id long, quality int")
    out = classifier.with_scores(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"] and out.count() == 4
    none = classifier.with_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.with_scores(docs.limit(0), labels).count() == 0


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, seen, dup, marked = len(words), set(), 0, set()
    found = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    for k in range(n - 2):
        if found[tuple(words[k : k + 3])] > 1:
            marked |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(300).collect()]
    for text in [*texts, "", "a\x0bb\x0cc\x1cd a\xa0b a b a b", "x\r\nx\r\n\n \n", "a a a a", "é\n\né"]:
        assert perplexity.base_counts(text.encode()) == brute(text)


def plain_model(counts):
    """Modified Kneser-Ney, straight from its definition, for the trigram counts {(a, b, c): n}."""
    bigram, unigram = Counter((b, c) for _, b, c in counts), Counter()
    for (_, c) in bigram:
        unigram[c] += 1
    d3, d2, d1 = (perplexity._discounts(np.array(list(x.values()))) for x in (counts, bigram, unigram))

    def p1(c):
        total = sum(unigram.values())
        left = 1 - sum(max(n - d1[min(n, 3)], 0) for n in unigram.values()) / total
        return max(unigram[c] - d1[min(unigram[c], 3)], 0) / total + left / 256

    def level(table, discounts, context, item, below):
        own = {k: n for k, n in table.items() if k[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        n = own.get((*context, item), 0)
        return max(n - discounts[min(n, 3)], 0) / total + sum(discounts[min(x, 3)] for x in own.values()) / total * below

    return lambda a, b, c: level(counts, d3, (a, b), c, level(bigram, d2, (b,), c, p1(c)))


def test_model_is_kneser_ney():
    text = b"abracadabra abracadabra, abrakadabra: a cat and a cad had a crab; " * 2
    codes, n = np.unique(perplexity._trigrams(text), return_counts=True)
    model = perplexity.Model(codes.astype(np.int64), n.astype(np.int64))
    plain = plain_model({(int(c) >> 16, int(c) >> 8 & 255, int(c) & 255): int(k) for c, k in zip(codes, n)})
    probe = [(97, 98, 114), (97, 98, 97), (122, 122, 97), (2, 2, 97), (97, 122, 122), (98, 114, 255)]
    got = np.exp(model.log_probabilities(np.array([a << 16 | b << 8 | c for a, b, c in probe])))
    assert np.allclose(got, [plain(*x) for x in probe], rtol=1e-5)
    for context in (b"ab", b"zz", b"\x02\x02"):
        assert np.exp(model.log_probabilities(np.array([context[0] << 16 | context[1] << 8 | c for c in range(256)]))).sum() == pytest.approx(1, abs=1e-5)


def test_counts_are_those_of_all_texts(spark):
    importable(spark)
    rows = [("de", "ab ab"), ("DE", "abc"), (None, "x"), ("xx", "x"), ("en", None), ("en", "")]
    got = {(r.lang, r.code): r.n for r in perplexity.count_trigrams(spark.createDataFrame(rows, "lang string, text string").repartition(3), "text", "lang").collect()}
    want = Counter()
    for lang, text in rows:
        lang = lang.lower() if lang and lang.lower() in perplexity.LANGUAGES else "other"
        for c in perplexity._trigrams((text or "").encode()).tolist():
            want[lang, c] += 1
    assert got == dict(want)


def test_rules_keep_clean_and_reject_junk(spark):
    rows = QUERIES["op5_perplexity_rules"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id", "left").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)
    assert sum(r.kept for r in junk) <= 0.4 * len(junk)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_edges(spark):
    importable(spark)
    df = spark.createDataFrame([(1, "a b " * 40, "en", 1), (2, None, None, 2), (3, "", "en", 3), (1, "a b " * 40, "en", 1)], "doc_id long, text string, lang string, Kept int")
    out = perplexity.with_verdicts(df.drop("Kept"))
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in out.collect()) == [(1, True, False)] * 2 + [(2, True, False), (3, True, False)]
    assert perplexity.with_verdicts(df.limit(0).drop("Kept")).count() == 0


def test_groups_of_languages_give_the_same_rows(spark):
    importable(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "fr"), (-2, "", "zz"), (-3, "é" * 200_000, "ES")], docs.schema))
    rows = lambda **given: sorted(tuple(r) for r in perplexity.with_verdicts(docs, keep_text=False, **given).select("doc_id", "kept", "log_perplexity", "lower", "upper").collect())
    counted = perplexity.count_trigrams(docs, "text", "lang")
    assert len(perplexity.language_groups(counted)) == 1 < len(perplexity.language_groups(counted, 9000))
    assert rows() == rows(at_once=1)


def test_medians_are_exact_to_the_histogram(spark):
    values = [(k, float(x)) for k in "ab" for x in np.random.default_rng(ord(k)).normal(3, 1, 501)]
    got = perplexity.medians(spark.createDataFrame(values, "k string, v double").repartition(7), "k", F.col("v"))
    assert all(abs(got[k] - np.median([v for key, v in values if key == k])) <= perplexity.WIDTH for k in "ab")


def plain_perplexities(rows):
    """Mean negative log probability of the words of each (text, lang), straight from the definition: counts without the judged word's window."""
    windows = lambda text, lang: [(lang, *w) for w in zip(*(([None] * 3 + re.findall(r"[^\x20\x09-\x0D]+", text or ""))[k:] for k in range(4)))]
    every = {w for text, lang in rows for w in windows(text, lang)}

    def tables(grams):
        three = Counter((lang, a, b, c) for lang, _, a, b, c in grams)
        two = Counter((lang, b, c) for lang, _, b, c in three)
        return three, two, Counter((lang, c) for lang, _, c in two)

    full, out = tables(every), []
    discounts = {(lang, k): perplexity._discounts(np.array([n for g, n in full[k].items() if g[0] == lang])) for lang in {w[0] for w in every} for k in range(3)}
    spelling = {}
    for lang in {w[0] for w in every}:
        codes, n = np.unique(np.concatenate([perplexity._trigrams((w + " ").encode()) for _, w in full[2] if _ == lang]), return_counts=True)
        spelling[lang] = perplexity.Model(codes.astype(np.int64), n.astype(np.int64))
    for text, lang in rows:
        logs = []
        for window in windows(text, lang):
            p = float(np.exp(spelling[lang].log_probabilities(perplexity._trigrams((window[4] + " ").encode())).sum()))
            left = tables(every - {window})
            for k, gram in ((2, (lang, window[4])), (1, (lang, *window[3:])), (0, (lang, *window[2:]))):
                d = discounts[lang, k]
                own = {g: n for g, n in left[k].items() if g[:-1] == gram[:-1]}
                total, n = sum(own.values()), own.get(gram, 0)
                p = (max(n - d[min(n, 3)], 0) + sum(d[min(v, 3)] for v in own.values()) * p) / total if total else p
            logs.append(np.log(p))
        out.append(-np.mean(logs) if logs else None)
    return out


def test_perplexity_is_that_of_word_trigrams(spark):
    importable(spark)
    rng = np.random.default_rng(5)
    words = ["the", "cat", "of", "a", "hat", "sat", "größe", "on", "mat,", "x1"]
    rows = [(" ".join(rng.choice(words, 12, p=np.arange(10, 0, -1) / 55)), lang) for lang in ("en", "en", "de", "en", "en", "de")]
    rows += [rows[0], (" \t" + rows[0][0].replace(" ", "\n") + "\x0b", "en"), (rows[0][0], "de"), ("lone", "fr"), ("the cat sat on a hat and so did the cat's cat", "other"), (None, "en"), (" \n", "de")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id int, text string, lang string").repartition(5)
    got = {r.doc_id: r.log_perplexity for r in perplexity.with_verdicts(docs).collect()}
    want = plain_perplexities(rows)
    assert [got[k] is None for k in range(len(rows))] == [w is None for w in want]
    assert all(got[k] == pytest.approx(w, abs=1e-5) for k, w in enumerate(want) if w is not None)


def test_word_order_counts_beyond_three_bytes(spark):
    """Long words in an order that no other text has are less likely than in the usual one, though their bytes are the same."""
    importable(spark)
    usual = ["international", "organisations", "traditionally", "recommendation", "notwithstanding", "administration"] * 3
    rng = np.random.default_rng(6)
    rows = [(k, f"word{k} " + " ".join(usual[k % 6 : k % 6 + 9]), "en") for k in range(40)] + [(100, " ".join(usual[:9]), "en"), (101, " ".join(rng.permutation(usual[:9])), "en")]
    got = {r.doc_id: r.log_perplexity for r in perplexity.with_verdicts(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert got[101] > got[100] + 1


def test_spelling_of_a_very_long_word_is_finite(spark):
    importable(spark)
    letters = "".join(np.random.default_rng(7).choice(list("abcdefghijklmnopqrstuvwxyz"), 10_000))
    rows = [(1, "é" * 100_000, "es"), (2, "a b " + letters, "es")]
    got = {r.doc_id: r.log_perplexity for r in perplexity.with_verdicts(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert all(v is not None and np.isfinite(v) for v in got.values()) and got[2] > 100


def test_rounds_and_buckets_give_the_same_rows(spark, monkeypatch):
    importable(spark)
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 5000), ("en", "de", None)[k % 3]) for k in range(120)] + [(1000, None, "en"), (1001, "", None), (1002, "lone", "fr")]
    docs = spark.createDataFrame(rows * 2, "doc_id int, text string, lang string").repartition(3)
    rows = lambda: sorted(tuple(r) for r in perplexity.with_verdicts(docs).select("doc_id", "kept", "log_perplexity", "lower", "upper").collect())
    whole = rows()
    monkeypatch.setattr(perplexity, "ROUND_BYTES", 25_000)
    monkeypatch.setattr(perplexity, "BUCKET_BYTES", 1_000)
    counting, judging = perplexity.Rounds.of(50_000)
    assert (counting.rounds, judging.rounds) == (2, 6) and counting.buckets == 25 and judging.buckets == 8
    assert rows() == whole


def test_shuffles_of_words_do_not_add_up_on_disk(spark):
    """Successive queries over all words leave no shuffle files behind."""
    importable(spark)
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, 500)), "en") for k in range(100)], "doc_id int, text string, lang string")

    def on_disk():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        found = []
        while files.hasNext():
            found.append(files.next())
        return sum(f.length() for f in found if f.getName().startswith("shuffle_"))

    before = on_disk()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    perplexity.with_perplexity(docs)
    assert on_disk() - before < 100_000  # 50,000 words
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_judging_stores_words_not_pairs(spark):
    """What is stored grows with the distinct words, not with the pairs of words in the texts."""
    importable(spark)
    rng = np.random.default_rng(10)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, 500)), "en") for k in range(100)], "doc_id int, text string, lang string")
    folder = shared_folder(spark)
    size = lambda: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    before = size()
    perplexity.with_perplexity(docs)
    assert size() - before < 100_000  # 50,000 pairs
