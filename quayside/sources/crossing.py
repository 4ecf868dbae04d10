"""Records of text files whose ends only a lexer can tell.

A separator ends a record only outside of quotes and comments, and whether it
lies there depends on all the text before it. The text source still cuts files
at every separator, so they split between tasks at any size. Each split of a
file that has several is first read for what it does to the lexer's state,
whatever that is at its start; the states are then passed on from split to
split. A record that lies across splits is named by the split it begins in, and
the parts of that one record alone are brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import bounded_batches, materialize

#: The state outside of everything: a separator there ends a record.
OUTSIDE = ""

#: The state after each of some pieces, by the state before the first.
Step = Callable[[str, pa.Array], Sequence[str]]

#: A record as it is wanted, made where it is put together: long texts cleaned
#: by column functions would be cleaned again in every filter on them.
Finish = Callable[[str], str]

_Place = tuple[str, int]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Place, pa.RecordBatch]]:
    """The pieces of a batch, split of a file by split of a file."""
    for batch in batches:
        places = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)
        at = 0
        for place, rows in groupby(places):
            n = sum(1 for _ in rows)
            yield place, batch.slice(at, n)
            at += n


def _ends(after: Sequence[str]) -> np.ndarray:
    return np.flatnonzero(np.asarray(after) == OUTSIDE) + 1


def _effects(states: Sequence[str], step: Step):
    """For each split and state before it: the state after it, and the number
    of pieces up to the first and to the last end of a record (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[_Place, int] = {}
        found: dict[_Place, dict[str, tuple[str, int, int]]] = {}
        for place, batch in _runs(batches):
            # Nothing is open at the start of a file.
            begins = states if place[1] else [OUTSIDE]
            known = found.setdefault(place, {s: (s, 0, 0) for s in begins})
            before = pieces.get(place, 0)
            moved = {}
            for now in {s for s, _, _ in known.values()}:
                after = step(now, batch.column("value"))
                moved[now] = after[-1], _ends(after)
            for start, (now, first, last) in known.items():
                then, ends = moved[now]
                if len(ends):
                    first, last = first or before + int(ends[0]), before + int(ends[-1])
                known[start] = then, first, last
            pieces[place] = before + batch.num_rows
        rows = [
            (file, block, pieces[file, block], start, str(then), first, last)
            for (file, block), known in found.items()
            for start, (then, first, last) in known.items()
        ]
        if rows:
            names = ["file", "block", "pieces", "before", "after", "first_end", "last_end"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    return run


_NAMES = ["file", "record", "first", "ended"]
_RECORDS = "file string, record string, first boolean, ended boolean"
_EFFECTS = "file string, block bigint, pieces bigint, before string, after string, first_end bigint, last_end bigint"
_EDGES = "file string, block bigint, state string, owner bigint, head bigint, tail bigint, torn boolean"


def _chained(effects: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file that share a record with others.

    ``head`` pieces belong to the record that begins in split ``owner``; from
    piece ``tail`` on, if there is one, a record begins that does not end here.
    """
    out = []
    state, owner = OUTSIDE, None
    wanted = {(b, s): rest for b, s, *rest in effects[
        ["block", "before", "after", "pieces", "first_end", "last_end"]
    ].itertuples(index=False)}
    blocks = sorted({b for b, _ in wanted})
    for block in blocks:
        after, pieces, first, last = wanted[block, state]
        head = 0 if state == OUTSIDE else first or pieces
        begins = after != OUTSIDE and (state == OUTSIDE or first > 0)
        if head or begins:
            torn = after != OUTSIDE and block == blocks[-1]
            out.append((block, state, owner, head, last if begins else None, torn))
        state, owner = after, block if begins else owner
    edges = pd.DataFrame(out, columns=["block", "state", "owner", "head", "tail", "torn"])
    edges.insert(0, "file", effects["file"].iloc[0])
    return edges.astype({"owner": "Int64", "tail": "Int64"})


def _inner(separator: str, step: Step, finish: Finish):
    """Records that lie in one split, and what is left open in a file of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, held, open_, made, alone = None, OUTSIDE, [], False, 0, False

        def rest() -> Iterator[pa.RecordBatch]:
            if held and alone:
                text = finish(separator.join(held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[0]]), pa.array([text]), pa.array([made == 0]), pa.array([False])], _NAMES
                )

        for now, batch in _runs(batches):
            if now != place:
                yield from rest()
                place, held, made = now, [], 0
                state, alone = (batch.column(c)[0].as_py() for c in ("state", "alone"))
                open_ = state != OUTSIDE
            texts = batch.column("value")
            after = step(state, texts)
            state = str(after[-1])
            ends = _ends(after)
            if not len(ends):
                if not open_:
                    held.extend(texts.to_pylist())
                continue
            if len(ends) == len(texts) and not held:
                records = texts.to_pylist()
            else:
                pieces = texts.to_pylist()
                cuts = [0, *ends.tolist()]
                records = [separator.join(pieces[a:b]) for a, b in zip(cuts, cuts[1:])]
                records[0] = separator.join([*held, records[0]])
                held = pieces[cuts[-1]:]
            first = [not (place[1] or made) and i == 0 for i in range(len(records))]
            if open_:
                # The end of a record that begins in a split before.
                records, first, open_ = records[1:], first[1:], False
            made += len(records)
            if records:
                n = len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[0]] * n), pa.array(map(finish, records), pa.string()), pa.array(first), pa.array([True] * n)],
                    _NAMES,
                )
        yield from rest()

    return run


def _parts(separator: str):
    """What each split holds of records that lie across splits, without lexing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, edge, seen, head, tail = None, {}, 0, [], []

        def parts() -> Iterator[pa.RecordBatch]:
            rows = []
            if head:
                rows.append((edge["owner"], separator.join(head), False, edge["torn"] and edge["tail"] is None))
            if tail:
                rows.append((place[1], separator.join(tail), place[1] == 0 and edge["tail"] == 0, edge["torn"]))
            for owner, text, first, torn in rows:
                yield pa.RecordBatch.from_pydict({
                    "file": [place[0]], "owner": [owner], "block": [place[1]], "part": [text], "first": [first], "torn": [torn],
                })

        for now, batch in _runs(batches):
            if now != place:
                yield from parts()
                place, seen, head, tail = now, 0, [], []
                edge = {c: batch.column(c)[0].as_py() for c in ("owner", "head", "tail", "torn")}
            texts = batch.column("value")
            upto = max(0, min(edge["head"] - seen, len(texts)))
            head.extend(texts.slice(0, upto).to_pylist())
            if edge["tail"] is not None:
                tail.extend(texts.slice(min(max(0, edge["tail"] - seen), len(texts))).to_pylist())
            seen += len(texts)
        yield from parts()

    return run


def _across(separator: str, finish: Finish):
    """One record from its parts in several splits."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        text = finish(separator.join(parts.sort_values("block")["part"]))
        row = (parts["file"].iloc[0], text, parts["first"].any(), not parts["torn"].any())
        return pd.DataFrame([row], columns=_NAMES)

    return run


def read_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    separator: str,
    states: Sequence[str],
    step: Step,
    finish: Finish = str,
) -> DataFrame:
    """Columns file, record, first and ended: every record of text files.

    ``first`` marks the first record of a file. ``ended`` is false for text
    that something left open runs through to the end of its file. Empty records
    are kept, an empty file has none, and there is no order between records. Files
    of several splits are read once while this is built, for the state at each
    split; a file that is one split (a small one, or one compressed as a
    whole) is not. A record that lies across splits is held whole by one task.
    """
    bounded_batches(spark)
    raw = (
        spark.read.option("lineSep", separator)
        .option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("alone"),
            "value",
        )
    )
    effects = raw.where("NOT alone").select("file", "block", "value").mapInArrow(_effects(states, step), _EFFECTS)
    # Some rows for each split of a file; written, so that its true size decides on the join.
    edges = materialize(effects.groupBy("file").applyInPandas(_chained, _EDGES), "edges")
    crossing = not edges.isEmpty()
    inner = _inner(separator, step, finish)
    if not crossing:
        return raw.withColumn("state", F.lit(OUTSIDE)).mapInArrow(inner, _RECORDS)
    numbered = raw.withColumn("at", F.monotonically_increasing_id())

    def in_order(df: DataFrame) -> DataFrame:
        # A join by sorting would keep each split in one task, but not its order.
        return df.sortWithinPartitions("file", "block", "at")

    joined = numbered.join(edges.select("file", "block", "state"), ["file", "block"], "left")
    within = in_order(joined.fillna({"state": OUTSIDE})).mapInArrow(inner, _RECORDS)
    parts = in_order(numbered.join(edges, ["file", "block"])).mapInArrow(
        _parts(separator), "file string, owner bigint, block bigint, part string, first boolean, torn boolean"
    )
    across = parts.groupBy("file", "owner").applyInPandas(_across(separator, finish), _RECORDS)
    return within.unionByName(across)
