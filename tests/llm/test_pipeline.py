"""The pipeline's stages on a real table, each against its own operator's verdicts."""

import corpus_pipeline
from ocellus.llm import mixing, neardup, queries, rules
from ocellus.runtime import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    clean = corpus_pipeline.toxic_out(spark, docs, sf_dir)
    gone = queries.op7_toxicity(spark, sf_dir).where("predicted = 1")
    assert clean.count() == docs.count() - gone.count() and clean.columns == columns
    passed = corpus_pipeline.rules_out(spark, clean, sf_dir)
    assert passed.count() == rules.judge(clean).where("kept").count() and passed.columns == columns
    single = corpus_pipeline.duplicates_out(spark, passed, sf_dir)
    assert single.count() == neardup.near_duplicates(passed).select("component_id").distinct().count()
    mix = corpus_pipeline.mixed(spark, single, sf_dir)
    words = lambda df: df.selectExpr(rf"coalesce(sum(regexp_count(text, '{mixing.WORD}')), 0)".replace("\\", "\\\\")).first()[0]
    assert mix.columns == columns and 1.3 * words(single) < words(mix) < 1.7 * words(single)
    out = corpus_pipeline.encoded(spark, mix, sf_dir)
    assert out.columns == ["doc_id", "ids"] and out.count() == mix.count()


def test_run_writes_each_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "ids"]
