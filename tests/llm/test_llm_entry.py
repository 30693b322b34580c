"""Registered queries, the pipeline, and what the driver relies on."""

import corpus_pipeline
from check import compare, connect

from claimscope.llm import decontaminate, simhash
from claimscope.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.01"


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_checks(spark):
    duck = connect(SF)
    for name, sql in CHECKS.items():
        assert compare(QUERIES[name](spark, SF), duck, sql) == "", name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        rows = kept.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and all(before[r["doc_id"]] == r["text"] for r in rows)
        if name != "mixing":
            assert kept.columns == docs.columns
        kept = spark.createDataFrame(rows, kept.schema)
    assert simhash.drop_near_duplicates(kept).count() == kept.count()
    assert decontaminate.leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert 0.5 * len(before) < kept.count() < len(before)
    words = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    assert sum(any(w in r["text"].lower().split() for w in words) for r in kept.collect()) < 0.02 * len(before)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
