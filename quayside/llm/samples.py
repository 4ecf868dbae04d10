"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import col
from quayside.session import materialize


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    classes: list,
    per_class: int,
    max_bytes: int,
    held: Column,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[list[tuple[str, object]], dict]:
    """(text, label) pairs in a fixed order, and how many rows each class has.

    At most ``per_class`` labelled ids of each class take part, the first by a
    hash of the id, and of their texts what the class's share of ``max_bytes``
    holds (:func:`_within`). ``held`` marks, over a column ``doc_id``, what must
    not be learned from. Texts that occur twice count once; null texts, null ids
    and null labels are left out.
    """
    known = labels.select(col(doc_id).alias("doc_id"), col(label).alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL"
    )
    known = known.where(~held).distinct()
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r.label in classes}
    place = F.xxhash64(F.lit(7), "doc_id")
    # One scan for all classes; each task passes on no more than per_class rows of a class.
    ranked = Window.partitionBy("label").orderBy("place", "doc_id")
    chosen = (
        known.where(F.col("label").isin(classes))
        .withColumn("place", place)
        .withColumn("nth", F.row_number().over(ranked))
        .where(F.col("nth") <= per_class)
        .drop("nth")
    )
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).where("text IS NOT NULL")
    keys = {"key": F.xxhash64("doc_id", "label", "text"), "same": F.xxhash64("text"), "n": F.octet_length("text")}
    found = materialize(rows.join(F.broadcast(chosen), "doc_id").withColumns(keys), "labelled-sample")
    order = ("place", "doc_id", "same", "label")
    sizes = found.select(*order, "key", "n").distinct().orderBy(*order).collect()
    firsts = list({r.same: r for r in reversed(sizes)}.values())[::-1]
    keep = _within({c: [(r.key, r.n) for r in firsts if r.label == c] for c in classes}, max_bytes)
    if not keep:
        return [], counts
    # No more than per_class rows for each class.
    kept = docs.sparkSession.createDataFrame([(k,) for k in keep], "key bigint")
    taken = found.join(F.broadcast(kept), "key").dropDuplicates(["key"]).orderBy(*order).select("text", "label").collect()
    return [(r.text, r.label) for r in taken], counts


def _within(classes: dict[object, list[tuple[int, int]]], max_bytes: int) -> list[int]:
    """Keys of the (key, size) pairs that fit, each class having an equal share.

    A class takes its pairs in order and passes over one that does not fit, so
    it ends no earlier for a long one. What it leaves of its share goes to the
    larger classes. A class whose texts are all longer than its share has the
    shortest of them.
    """
    keep: list[int] = []
    left = max_bytes
    own = sorted((c for c in classes.values() if c), key=lambda pairs: sum(n for _, n in pairs))
    for i, pairs in enumerate(own):
        room = share = left // (len(own) - i)
        before = len(keep)
        for key, n in pairs:
            if n <= room:
                keep.append(key)
                room -= n
        if len(keep) == before:
            key, n = min(pairs, key=lambda pair: pair[1])
            keep.append(key)
            room -= n
        left = max(left - (share - room), 0)
    return keep


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
