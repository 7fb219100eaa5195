"""Running sequential rules over bounded groups, many groups to a task.

Greedy assignment, fixpoints and state machines depend on an order that no aggregate expresses. Rows are dealt by the group's
keys, sorted, and streamed; one group at a time is held, so a task's memory is that of its largest group. Groups are frames or
sources, whose sizes the data model bounds; ``most`` makes an overflow an error instead of a surprise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema


class BudgetExceeded(RuntimeError):
    """A group is larger than its budget."""


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[tuple]], Iterable[tuple]], schema: str, most: int = 4096) -> DataFrame:
    """``fn`` on the rows (tuples of all columns, in ``order``) of each group; its results are rows of ``schema``."""
    width = [df.columns.index(k) for k in keys]
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def close() -> None:
            if group:
                out.extend(fn(group))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[i] for i in width)
                if key != now:
                    close()
                    now, group = key, []
                group.append(row)
                if len(group) > most:
                    raise BudgetExceeded(f"group {key} has more than {most} rows")
            yield flush()
        close()
        yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` on an iterator over the rows (tuples of all columns, in ``order``) of each group; its results are rows of ``schema``. Nothing but
    what ``fn`` keeps is held, so groups may have any size."""
    width = [df.columns.index(k) for k in keys]
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = (x for _, group in groupby(rows, key=lambda row: tuple(row[i] for i in width)) for x in fn(group))
        while out := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def roots(edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Smallest member of each node's connected component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def components(edges: DataFrame, keys: list[str], a: str, b: str, most: int = 1_000_000) -> DataFrame:
    """``keys``, id and root of every node that an edge touches."""
    n = len(keys)
    ddl = ", ".join(f"{k} {t}" for k, t in edges.select(*keys).dtypes) + ", id long, root long"
    fn = lambda rows: [(*rows[0][:n], i, r) for i, r in roots((x[n], x[n + 1]) for x in rows).items()]
    return map_groups(edges.select(*keys, a, b), keys, [a, b], fn, ddl, most)
