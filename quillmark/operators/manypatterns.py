"""Many patterns in many texts: an automaton over all patterns reads each text once.

Patterns are collected a block of ``BLOCK_BYTES`` at a time, the automaton (Aho-Corasick) is built in each worker
and kept for the block, and texts pass it in Arrow batches.  A set beyond one block is dealt by hash into as many blocks
as it needs, each with a pass of its own, so no pattern list of unknown size is broadcast and no row meets a pattern
that it doesn't hold.

Null and empty patterns match nothing, equal ones are one; a null text holds nothing; rows that hold no pattern
are left out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
_BUILT: dict = {}


def _automaton(mark: str, patterns: list[str]):
    import ahocorasick

    if mark not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            a.add_word(p, k)
        a.make_automaton()
        _BUILT[mark] = a
    return _BUILT[mark]


def contained(texts: DataFrame, column: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Each row with each distinct pattern that its ``column`` holds: the row's columns, ``pattern`` and n, how often
    (overlapping finds count)."""
    spark = texts.sparkSession
    own = patterns.select(F.col(pattern).alias("p")).where("p is not null and p != ''").distinct()
    size = own.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0
    kinds = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    schema = f"{kinds}, `{pattern}` string, n bigint"
    place = texts.columns.index(column)
    out = spark.createDataFrame([], schema)
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        held = [r.p for r in own.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).collect()]  # about BLOCK_BYTES
        if held:
            out = out.unionByName(texts.where(F.col(column).isNotNull()).mapInArrow(_run(spark.sparkContext.broadcast(held), uuid.uuid4().hex, place, pattern), schema))
    return out


def _run(shipped, mark: str, place: int, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shipped.value
        a = _automaton(mark, patterns)
        for batch in batches:
            rows, found, counts = [], [], []
            for k, text in enumerate(batch.column(place).to_pylist()):
                seen: dict[int, int] = {}
                for _, p in a.iter(text):
                    seen[p] = seen.get(p, 0) + 1
                rows += [k] * len(seen)
                found += [patterns[p] for p in seen]
                counts += seen.values()
            if rows:
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string()), pa.array(counts, pa.int64())], [*own.schema.names, pattern, "n"])

    return run
