import hashlib

import public_tokenizers
import pytest
import tiktoken
import zstandard

import __spark_entry__ as entry_module
import corpus_pipeline
from postmill.llm import bpe, rules, toxicity
from test_simhash import plain_components, plain_fingerprint


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_run_equals_brute_force(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    score = toxicity.learn(table("documents"), table("labels")).scorer()
    docs = {r.doc_id: r.text for r in table("documents").collect()}
    docs = {i: t for i, t in docs.items() if score(t) < 0.3}
    pack = zstandard.ZstdCompressor(level=3)
    docs = {i: t for i, t in docs.items() if rules.judge(t, rules.Bands(), pack)[-1]}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots = plain_components(set(prints.values()))
    least = {}
    for i in sorted(docs, reverse=True):
        least[roots[prints[i]]] = i
    docs = {i: docs[i] for i in least.values()}
    clean = lambda t: " ".join(t.split())
    items = [clean(r.text) for r in table("benchmark").collect()]
    docs = {i: t for i, t in docs.items() if not any(q in clean(t) for q in items)}
    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks.ids
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in entry_module.queries()["pipeline"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(odd_docs, no_docs, spark, sf_dir, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, sf_dir)
    assert out.count() <= odd_docs.count()
    if k < 4:
        assert out.columns == odd_docs.columns
    assert stage(spark, no_docs, sf_dir).collect() == []
