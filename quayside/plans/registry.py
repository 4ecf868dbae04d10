"""The named queries and, where SQL can say it, the SQL they must equal."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quayside.plans.inputs import load, with_clause

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: Sequence[str] = (), oracle: str | None = None):
    """Register a function that gets its inputs as frames, in ``uses`` order."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(*[load(spark, sf_dir, u) for u in uses])

        QUERIES[name] = run
        if oracle:
            text = oracle.strip()
            prefix = with_clause(list(uses))
            own = re.match(r"WITH (RECURSIVE )?", text)
            if prefix and own:
                # The query's own CTEs follow the inputs in one list.
                prefix, text = prefix.rstrip() + ", ", text[own.end() :]
            ORACLES[name] = prefix + text
        return fn

    return register
