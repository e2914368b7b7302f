"""The pipeline against the stages done plainly in Python."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components, brute_fp, brute_lines, brute_mix, check_packing

from arcweave.llm import quality, queries
from arcweave.llm.common import SLICE
from arcweave.plans.materialize import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    domain = lambda s: "web" if s[-1] in "01234" else "reference" if s[-1] in "567" else "code"
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        out = materialize(stage(spark, docs, SF), "test")
        before = {r["doc_id"]: r for r in docs.collect()}
        after = out.collect()
        if not last:
            assert out.columns == docs.columns
        if name == "quality rules":
            want = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
            assert {r["doc_id"] for r in after} == want and len(after) < len(before)
        elif name == "line dedup":
            want = {k[0]: k[3] for k in brute_lines([(i, r["text"]) for i, r in before.items()])}
            assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in after} == want
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            root = brute_components([brute_fp(before[i]["text"]) for i in ids])
            assert {r["doc_id"] for r in after} == {ids[c] for c in root}
        elif name == "mixing sources":
            rows = [(i, r["text"], r["lang"], r["source"]) for i, r in before.items()]
            want = {k[0] for k in brute_mix(rows, corpus_pipeline.KEPT_SHARE, queries.MIX_WEIGHTS, queries.MIX_SEED, 1, domain)}
            assert len(want ^ {r["doc_id"] for r in after}) <= 2
        else:
            n, total = check_packing(after, 2048), sum(r["length"] for r in after)
            assert {r["doc_id"] for r in after} == set(before) and n <= 1.05 * total / 2048 + 2
        docs = out


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", SLICE), ("100", 100), ("0", SLICE)):
            spark.conf.set(key, given)
            corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    lengths = defaultdict(int)
    for r in got.collect():
        lengths[r["sequence_id"]] += r["length"]
    assert lengths and max(lengths.values()) <= 2048
    assert got.where(F.col("doc_id").isNull()).count() == 0
