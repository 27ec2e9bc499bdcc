"""Ordered key-value tables: range scans and point writes as DataFrame operations. Keys are compared by their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_end(prefix: str) -> bytes | None:
    """The least byte string after all that begin with the prefix; None if there is none."""
    b = bytearray(prefix.encode())
    while b and b[-1] == 0xFF:
        b.pop()
    if not b:
        return None
    b[-1] += 1
    return bytes(b)


def in_range(key: Column, kind: str, a: str | None = None, b: str | None = None) -> Column:
    """Condition of a range: all, at_least, at_most, greater_than, less_than, closed, closed_open, open_closed, open or prefix. Comparisons of strings reach the scan."""
    if kind == "all":
        return key.isNotNull()
    if kind == "prefix":
        return key.startswith(a)
    low = {"at_least": key >= a, "greater_than": key > a, "closed": key >= a, "closed_open": key >= a, "open_closed": key > a, "open": key > a}
    top = a if b is None else b
    high = {"at_most": key <= top, "less_than": key < top, "closed": key <= top, "closed_open": key < top, "open_closed": key <= top, "open": key < top}
    if kind not in low and kind not in high:
        raise ValueError(kind)
    return low.get(kind, F.lit(True)) & high.get(kind, F.lit(True)) if kind in low and kind in high else low.get(kind, high.get(kind))


def scan(df: DataFrame, kind: str, a: str | None = None, b: str | None = None, key: str = "key", backward: bool = False) -> DataFrame:
    """Rows of a range in key order, or backward."""
    return df.where(in_range(F.col(key), kind, a, b)).orderBy(F.desc(key) if backward else F.asc(key))


def put(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with the rows of new written over it."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def put_new(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with those rows of new whose key it doesn't have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def delete(old: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def bulk_append(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old and then new, sorted; every new key must come after the old ones."""
    last = old.agg(F.max(key)).first()[0]
    first = new.agg(F.min(key)).first()[0]
    if last is not None and first is not None and first <= last:
        raise ValueError(f"key {first!r} is out of order after {last!r}")
    return old.unionByName(new.sortWithinPartitions(key))
