"""Folds over a key's rows in order: one shuffle and sort, then a pass that keeps one state, whatever a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, by: str, order: list[str | Column], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], schema: str, end: Callable[[dict, object], dict | None] | None = None) -> DataFrame:
    """What ``step`` gives for each row (None: nothing), a key's rows in order. A key begins with ``start()``; ``step`` gets
    that state, which it may change, and the row as a dict; ``end`` gets the last state and the key. Rows come in Arrow batches, so nothing is held but a batch and
    a state."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def plain(c: pa.Array) -> list:
        if c.null_count == len(c):
            return [None] * len(c)
        return c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist()

    def table(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in kind], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, new = {}, None, True
        for b in batches:
            names, out = b.schema.names, []
            at = names.index(by)
            for values in zip(*map(plain, b.columns), strict=True):
                if new or values[at] != key:
                    if end and not new and (got := end(state, key)) is not None:
                        out.append(got)
                    state, key, new = start(), values[at], False
                got = step(state, dict(zip(names, values, strict=True)))
                if got is not None:
                    out.append(got)
            yield table(out)
        if end and not new and (got := end(state, key)) is not None:
            yield table([got])

    # With a number of its own, as the pass costs more than its few bytes tell.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.col(by)).sortWithinPartitions(by, *order).mapInArrow(run, schema)
