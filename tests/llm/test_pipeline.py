"""Each pipeline stage against a plain version over its own input, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from loomgraph.plans.store import materialize
from tests.llm.test_decontam import nearest, tokens
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import levels
from tests.llm.test_rules import brute as metrics

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = materialize(stage(spark, docs, DATA))
        if name != "sharding":
            assert docs.columns == columns
    rows = {k: [r.asDict() for r in v.collect()] for k, v in seen.items()}
    final = docs.collect()

    kept = {r["doc_id"] for r in rows["n-gram Jaccard join"]}
    for r in rows["quality rules"]:
        n, _, marks, _, repeat = metrics(r["text"])
        if n < 50 or 100 * repeat > 50 * n or marks > 0.1 * n:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.6 * len(rows["quality rules"])

    pairs = [(r["doc_id"], r["text"]) for r in rows["n-gram Jaccard join"]]
    want = {i for i, _, c in components(pairs, 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in rows["benchmark decontamination"]} == want

    items = [tokens(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in rows["benchmark decontamination"] if not any(set(x[:3]) & set(w) and nearest(x, w) <= len(x) // 8 for w in [tokens(r["text"])] for x in items)}
    assert {r["doc_id"] for r in rows["mixing sources"]} == clean

    sizes = {}
    for r in rows["mixing sources"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    got = {}
    for r in rows["sharding"]:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for s, target in levels(sizes).items():
        longest = max(len(r["text"].split()) for r in rows["mixing sources"] if r["source"] == s)
        assert abs(got.get(s, 0) - target) <= longest

    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in rows["sharding"])
    assert {r["shard"] for r in final} == set(range(corpus_pipeline.SHARDS))


def run_all(spark, docs):
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DATA))
        if name != "sharding":
            assert docs.columns == before.columns
        sizes.append(docs.count())
    return docs, sizes


def test_empty_table(spark):
    assert run_all(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(0))[1] == [0] * 5


def test_null_ids_repeats_and_clashing_names(spark):
    """Null ids stay through every stage; equal rows become one; further columns are carried along."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60)
    odd = base.selectExpr("if(doc_id % 7 = 0, null, doc_id) as doc_id", "if(doc_id % 11 = 0, null, text) as text", "lang", "if(doc_id % 5 = 0, null, source) as source", "n_chars",
                          "1 as size", "'s' as shard", "2.0 as component_id", "'k' as key", "false as kept", "map('a', 1) as more")
    docs, sizes = run_all(spark, odd.unionByName(odd.where("doc_id % 3 = 0")))
    assert sizes[0] > 0 and sizes[1] <= sizes[0] and docs.where("doc_id is null").count() > 0
    assert docs.columns == ["doc_id", "text_crc32", "size", "shard", "slot"]
