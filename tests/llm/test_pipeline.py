"""The pipeline against the operators' brute-force rules, stage by stage, and on awkward rows."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from metaglean.llm import bpe, queries

from .test_operators import SF, awkward, brute_components, brute_contaminated, brute_secrets


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "secret_scan", "bpe"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect() if verdict[r.doc_id]}
    for name, f in P.STAGES:
        docs = P.stage(f(spark, docs, SF), name)
        got = {r.doc_id: r for r in docs.collect()}
        if name == "near_dedup":
            left = {i: left[i] for i, (_, c) in brute_components(list(left.items()), 5).items() if c == i}
        elif name == "decontaminate":
            hit = {i: brute_contaminated(t, items) for i, t in left.items()}
            assert all(len(t.split()) >= 13 for _, t in items)  # so any hit is of a whole window
            left = {i: t for i, t in left.items() if not hit[i][1]}
        elif name == "secret_scan":
            for i, t in left.items():
                assert (got[i].text == t) == (not brute_secrets(t)) and got[i].n_chars == len(got[i].text)
                assert not brute_secrets(got[i].text)
            left = {i: got[i].text for i in left}
        elif name == "bpe":
            t = bpe.Tokenizer(open(queries.tokenizer_path(spark), encoding="utf-8").read())
            for i, x in left.items():
                assert (got[i].n_tokens, got[i].decoded_sha256) == (len(t.encode(x)), hashlib.sha256(x.encode()).hexdigest())
        assert sorted(got) == sorted(left), name
        assert all(got[i].text == left[i] for i in left), name
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(left)


def test_awkward_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    d = awkward(spark).withColumn("n_chars", F.length("text").cast("long"))
    for docs in (d, d.limit(0)):
        docs = P.stage(docs, "docs")
        for name, f in P.STAGES:
            out = P.stage(f(spark, docs, folder), name)
            assert out.count() <= docs.count()
            if name != "bpe":
                assert out.columns == docs.columns


def test_stages_begin_without_the_free_heap_of_those_before(spark):
    """Heaps that a stage has grown took the memory that the workers of the next one need."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("decontaminate", "bpe"):
        before = full()
        dict(P.STAGES)[name](spark, docs, SF)
        assert full() > before, name
