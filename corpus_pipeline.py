"""From raw documents to sharded training documents, in five stages.

Each stage gets the rows the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import decontaminate, maglev, mixing, simhash, toxicity
from quayside.llm.common import col, fresh, held_out, table
from quayside.llm.queries import SCORED_FOLD
from quayside.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    It learns from those labelled rows whose documents are still there.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), *SCORED_FOLD))
    score = toxicity.score(docs, model, F.col("text"))
    return docs.where(score < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    found, hit = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated(hit)).select(*[col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times."""
    mixed, mix, _ = mixing.mix(docs, F.array("source"))
    lap = fresh(mixed, "__lap")
    return mixed.withColumn(lap, F.explode(F.array_repeat(F.lit(1), F.col(mix)["copies"]))).select(*[col(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the number of its shard."""
    return maglev.assign_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Training, greedy filling and claiming slots are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
