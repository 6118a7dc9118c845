"""The stages of the pipeline on the smallest tables, each against its own input."""

import hashlib

import public_tokenizers
import tiktoken
from conftest import SMALL
from test_dedup import brute_components

import corpus_pipeline
from needmap.llm.vocabulary import PATTERN, read_ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    read = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS, name
        read.append({r[0]: r for r in docs.collect()})
    before = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good, lines, single, clean, coded = read
    # Rejected documents are junk, good ones stay.
    known = [i for i in before if i in labels]
    assert sum((i in good) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
    # Lines: all documents stay, texts only lose whole lines.
    assert lines.keys() == good.keys()
    for i, r in lines.items():
        rest = iter(good[i].text.split("\n"))
        assert r.text == "" or all(line in rest for line in r.text.split("\n"))
        assert r.n_chars == len(r.text)
    # One document of each group.
    want = brute_components([(i, r.text) for i, r in lines.items()], 80)
    assert single.keys() == {i for i, (_, c) in want.items() if c == i}
    # No verbatim benchmark passage is left, and no other document went.
    holds = lambda text: any(" ".join(item) in " ".join(text.lower().split()) for item in items)
    assert not any(holds(r.text) for r in clean.values())
    assert len(single.keys() - clean.keys()) <= 1 + sum(holds(single[i].text) for i in single)
    # The encoding is that of the library, and decodes to the text.
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert coded.keys() == clean.keys()
    for i, r in coded.items():
        ids = library.encode_ordinary(clean[i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest()
