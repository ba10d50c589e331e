"""Set and multiset operations on relations and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def immutable_only(files: str | Column, mutable: str | Column) -> Column:
    """Files that are not among the mutable ones."""
    return F.array_except(files, mutable)


def remove_first(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less one equal row for each row of ``gone`` that has one."""
    return rows.exceptAll(gone)


def file_handles(df: DataFrame, is_handle=lambda t: isinstance(t, T.StructType) and {"path", "hash"} <= set(t.names)) -> Column | None:
    """An array of all file handles in nested columns, by a walk over the schema; None if the schema has none."""

    def found(c: Column, t: T.DataType) -> Column | None:
        if is_handle(t):
            return F.filter(F.array(c), lambda x: x.isNotNull())
        if isinstance(t, T.StructType):
            parts = [found(c[f.name], f.dataType) for f in t.fields]
            parts = [F.coalesce(p, F.array()) for p in parts if p is not None]
            return F.concat(*parts) if parts else None
        inner = t.elementType if isinstance(t, T.ArrayType) else t.valueType if isinstance(t, T.MapType) else None
        if inner is None or found(F.lit(None), inner) is None:
            return None
        items = c if isinstance(t, T.ArrayType) else F.map_values(c)
        return F.flatten(F.transform(items, lambda x: F.coalesce(found(x, inner), F.array())))

    parts = [found(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    parts = [F.coalesce(p, F.array()) for p in parts if p is not None]
    return F.array_distinct(F.concat(*parts)) if parts else None
