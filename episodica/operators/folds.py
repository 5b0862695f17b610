"""Folds over rows in order, with a state that is carried from row to row: Spark sorts, and no key's rows are ever held together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: str) -> DataFrame:
    """What a machine gives for each key's rows in order; ``schema`` is that of the keys and of what it gives.

    ``start()`` makes a machine for a key. ``machine.step(row)`` takes the columns of ``rows`` other than the keys, as a tuple, and returns the rows to give out;
    ``machine.end()`` returns the last ones. A task streams its keys one after another and holds one machine.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n, fields = len(keys), StructType.fromDDL(schema)
    rest = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, now, machine, out = to_arrow_schema(fields), None, None, []

        def add(key: tuple, found: Iterable[tuple]) -> None:
            out.extend((*key, *x) for x in found)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[:n]
                if machine is None or key != now:
                    if machine is not None:
                        add(now, machine.end())
                    now, machine = key, start()
                add(key, machine.step(row[n:]))
            if out:
                yield batch_of()
                out.clear()
        if machine is not None:
            add(now, machine.end())
        if out:
            yield batch_of()

    dealt = rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)
