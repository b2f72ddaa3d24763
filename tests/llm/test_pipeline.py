"""The pipeline against plain versions of what its stages decide."""
import re

import corpus_pipeline
from tidemark.llm import minmax, toxicity
from tidemark.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            scores = toxicity.toxicity(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in scores.where("predicted = 0").select("doc_id").collect())
        if name == "minmax_near":
            groups = minmax.near_duplicates(before)
            assert docs.count() == groups.select("component_id").distinct().count()
    assert counts[0] >= counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_entry_registers_the_operators():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    found = {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}
    assert found == set(range(1, 14)) and "pipeline" in names
    assert {"op1_mixture", "op3_line_dedup", "op13_quality_rules"} <= set(__spark_entry__.oracle_sql())
