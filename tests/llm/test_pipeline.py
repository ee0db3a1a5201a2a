"""The pipeline against its operators' own verdicts, stage by stage."""
import corpus_pipeline
from sparktab.llm import decontaminate, mixing, neardup, quality
from sparktab.llm.common import keep, table
from sparktab.llm.queries import ORACLES, QUERIES


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    verdicts = {
        "quality_rules": lambda d: {r.doc_id for r in quality.judge(d).filter("kept").collect()},
        "near_duplicates": lambda d: {r.doc_id for r in neardup.near_duplicates(d).filter("kept").collect()},
        "decontamination": lambda d: {r.doc_id for r in decontaminate.contamination(d, table(spark, folder, "benchmark")).filter("not contaminated").collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.plan(d).filter("copies > 0").collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = verdicts[name](docs)
        docs = keep(stage(spark, docs, folder), "test")
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == want and want
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert got.count() == docs.count()
    key = ["doc_id", "size", "text_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, folder).select(*key).collect()))


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
