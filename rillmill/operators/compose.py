"""Composition: branches that are gathered again, user functions over groups, attribution of outputs to inputs, and cached scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window


def scatter_gather(df: DataFrame, branches: dict[str, Column], select: dict[str, Column] | None = None, name: str = "gathered") -> DataFrame:
    """Each row with a struct of what every branch makes of it; a branch whose ``select`` condition doesn't hold for a row gives null there."""
    select = select or {}
    parts = [(F.when(select[k], c) if k in select else c).alias(k) for k, c in branches.items()]
    return df.withColumn(name, F.struct(*parts))


def fan_out(df: DataFrame, parent: str, ports: dict[str, Column]) -> DataFrame:
    """(parent, port, value): one row for each port of each row."""
    entries = [F.struct(F.lit(k).alias("port"), c.alias("value")) for k, c in ports.items()]
    return df.select(parent, F.explode(F.array(*entries)).alias("_e")).select(parent, "_e.port", "_e.value")


def fan_in(rows: DataFrame, parent: str, order: str = "value") -> DataFrame:
    """(parent, arrived): for each parent a map from port to the array of what arrived there, in order."""
    lists = rows.groupBy(parent, "port").agg(F.array_sort(F.collect_list(order)).alias("_l"))
    return lists.groupBy(parent).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("port", "_l")))).alias("arrived"))


class Rows:
    """Neighbouring rows of a sorted batch: a column by its name as an array, null among whole numbers as None, and how many there are."""

    __slots__ = ("columns", "lo", "hi")

    def __init__(self, columns: dict[str, np.ndarray], lo: int, hi: int):
        self.columns, self.lo, self.hi = columns, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][self.lo : self.hi]


def _array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column as an array; whole numbers and truth values with nulls as objects, so that none is rounded."""
    if column.null_count and not pa.types.is_floating(column.type):
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places, from 1, at which a row's keys differ from those of the row before; null is a key, and so is NaN."""
    new = np.zeros(max(len(rows) - 1, 0), dtype=bool)
    for k in keys:
        a, b = _array(rows[k])[1:], _array(rows[k])[:-1]
        null = rows[k].is_null().to_numpy()
        new |= (a != b) & ~((a != a) & (b != b)) | (null[1:] != null[:-1])
    return np.flatnonzero(new) + 1


def _by_group(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple, dict[str, np.ndarray], int, int], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of ``make(key, columns, first, end)`` for each group of rows with the same keys. Groups pass through a task as a sorted stream, many to a batch; only a group is kept whole."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        columns = {c: _array(rows[c]) for c in rows.column_names}
        edges = [0, *_begins(rows, keys).tolist(), len(rows)]
        names = [columns[k] for k in keys]
        made = [r for lo, hi in zip(edges, edges[1:]) for r in make(tuple(c[lo] for c in names), columns, lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in made], type=f.type, from_pandas=True) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on
        for b in batches:
            if not len(b):
                continue
            if held:
                at = _begins(pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), b]), keys) - 1
            else:
                at = _begins(pa.Table.from_batches([b]), keys)
            if not len(at):
                held.append(b)
                continue
            yield emit([*held, b.slice(0, int(at[-1]))] if at[-1] else held)
            held = [b.slice(int(at[-1]))]
        if held:
            yield emit(held)

    by = [F.col(c).asc_nulls_last() for c in order]
    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(run, schema)


def summarize_rows(df: DataFrame, keys: list[str], order: list[str], summary: Callable[[tuple, Rows], dict], schema: str) -> DataFrame:
    """One row for each key from ``summary(key, rows in order)``, an opaque function; null is a key. A key's rows are in one task's memory, so prefer built-in aggregates where they can say the same."""
    return _by_group(df, keys, order, lambda key, columns, lo, hi: (summary(key, Rows(columns, lo, hi)),), schema)


def on_match(left: DataFrame, right: DataFrame, key: str, match: Callable[[tuple, Rows, Rows], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of ``match(key, rows of the left, rows of the right)`` for each key of either side; as in a join, a null key meets no other."""

    def side(df: DataFrame, k: int, mark: str) -> DataFrame:
        return df.select(F.col(key).alias("_key"), F.when(F.col(key).isNull(), k).otherwise(-1).alias("_apart"), F.lit(k).alias("_side"), *(F.col(c).alias(mark + c) for c in df.columns))

    def make(key: tuple, columns: dict[str, np.ndarray], lo: int, hi: int) -> Iterable[dict]:
        mid = lo + int(np.searchsorted(columns["_side"][lo:hi], 1))
        ours = lambda mark: {c[2:]: v for c, v in columns.items() if c.startswith(mark)}
        return match(key[:1], Rows(ours("l_"), lo, mid), Rows(ours("r_"), mid, hi))

    both = side(left, 0, "l_").unionByName(side(right, 1, "r_"), allowMissingColumns=True)
    return _by_group(both, ["_key", "_apart"], ["_side"], make, schema)


def on_window(df: DataFrame, time: str, size: int, order: list[str], handle: Callable[[int, int, Rows], dict], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tumbling window that has rows, from ``handle(start, end, rows in order)``; times are whole numbers and windows begin at multiples of size. Rows without a time are a window without start and end."""
    start = F.floor(F.col(time) / size).cast("bigint") * size

    def make(key: tuple, columns: dict[str, np.ndarray], lo: int, hi: int) -> tuple[dict]:
        begin = None if key[0] is None else int(key[0])
        return (handle(begin, None if begin is None else begin + size, Rows(columns, lo, hi)),)

    return _by_group(df.withColumn("_start", start), ["_start", *keys], order, make, schema)


def derive(df: DataFrame, id_: str, children: Column, name: str) -> DataFrame:
    """One row for each element of ``children``, with the id of the row it comes from in ``parent_ids`` and a ``data_id`` of its own made of that id and its place."""
    out = df.select(id_, F.posexplode(children).alias("place", name))
    return out.select(F.array(id_).alias("parent_ids"), F.concat_ws("/", id_, "place").alias("data_id"), "place", name)


def passed(df: DataFrame, **changed: Column) -> DataFrame:
    """The same data in new envelopes: data_id stays, the other columns may change, and the row becomes its own parent's child."""
    return df.withColumns({**changed, "parent_ids": F.array("data_id")})


def outputs_by_input(inputs: DataFrame, outputs: DataFrame, index: str, sources: str, value: str) -> DataFrame:
    """(index, outputs): what each input led to, in order of value; an input without output has an empty array, and an output of several sources is listed under each of them, once."""
    listed = outputs.select(F.explode(F.array_distinct(sources)).alias(index), value).groupBy(index).agg(F.array_sort(F.collect_list(value)).alias("outputs"))
    return inputs.select(index).join(listed, index, "left").withColumn("outputs", F.coalesce("outputs", F.array().cast(listed.schema["outputs"].dataType)))


def with_cache(df: DataFrame, column: str, cache: DataFrame, score: Callable[[str], float | None]) -> tuple[DataFrame, DataFrame]:
    """(df with ``score``, new rows (key, score) for the cache): values known by the hash of their content are looked up, the others are asked once each.

    What the scorer can't tell (None) is null in the result and isn't kept, so that it is asked again the next time.
    """
    keyed = df.withColumn("_key", F.sha2(F.col(column), 256))
    known = cache.select(F.col("key").alias("_key"), F.col("score").alias("_known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["_key"], "score": pd.array([score(v) for v in b["_v"]], dtype="Float64")})

    missing = keyed.where(F.col(column).isNotNull()).join(known, "_key", "left_anti").groupBy("_key").agg(F.first(column).alias("_v"))
    asked = missing.mapInPandas(run, "key string, score double").where("score is not null")
    every = known.unionByName(asked.select(F.col("key").alias("_key"), F.col("score").alias("_known")))
    return keyed.join(every, "_key", "left").drop("_key").withColumnRenamed("_known", "score"), asked


def paced(df: DataFrame, key: str, time: str, seq: str, rps: float, burst: int) -> DataFrame:
    """df with ``released``: when a token bucket of ``burst`` tokens, refilled at ``rps`` a time unit, lets each row of a key pass, in order of time and seq.

    The bucket's state after a row is one number (the theoretical arrival time), so a key's rows pass through a task as a sorted stream, batch by batch.
    """
    out = df.repartition(key).sortWithinPartitions(key, time, seq)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, due = object(), 0.0
        for b in batches:
            released = []
            for k, t in zip(b[key], b[time]):
                if k != last:
                    last, due = k, float("-inf")
                at = max(float(t), due - (burst - 1) / rps)
                due = max(due, at) + 1 / rps
                released.append(at)
            yield b.assign(released=released)

    return out.mapInPandas(run, df.withColumn("released", F.lit(0.0)).schema)


def first_n(items: Column, n: int) -> Column:
    """The first n of a list, in its order."""
    return F.slice(items, 1, n)


def paged(df: DataFrame, condition: Column, order: list[Column], size: int, most: int) -> DataFrame:
    """The rows that meet the condition, in order, with their page from 0; it ends after ``most`` rows."""
    hits = df.where(condition)
    row = F.row_number().over(Window.orderBy(*order)) - 1
    return hits.orderBy(*order).limit(most).withColumn("page", F.floor(row / size).cast("int"))
