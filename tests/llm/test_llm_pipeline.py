"""The queries of the subpackage and the pipeline on the smallest tables."""

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
import quayside.llm.queries  # noqa: F401
from quayside.llm import decontaminate, maglev, simhash
from quayside.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, duck, name):
    assert QUERIES[name](spark, SF).count() == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_stages_keep_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-3, "", "en", "src1", 0)], docs.schema
    )
    docs = docs.unionByName(extra)
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns + ["shard"] * last, name
        if not last:
            assert stage(spark, docs.limit(0), SF).count() == 0
        docs = quayside_materialize(out)
    assert docs.where(f"shard < 0 OR shard >= {maglev.SHARDS}").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found, hit = decontaminate.find_contamination(docs, bench)
    assert found.where(decontaminate.contaminated(hit)).count() == 0
    once = docs.dropDuplicates(["doc_id"]).withColumn("fp", simhash.fingerprints(F.col("text")))
    groups = simhash.cluster(once.select("doc_id", "fp")).groupBy("root").count()
    assert groups.where("count > 1").count() == 0


def quayside_materialize(df):
    from quayside.session import materialize

    return materialize(df, "stage")


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).columns[-1] == "shard"
