"""Memo keys: a name, a version and a hash of the canonical text of the input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a null. No value's text begins with it: those begin with their length.
NULL_MARK = "~"


def canonical_text(*columns: str | Column) -> Column:
    """One text for the values of the columns, in their order; different values have different texts.

    A value is its length in bytes, a colon and its text, so no value can run into the next one; a null is ``~``. Doubles have
    no canonical text; cast them first. Nested values have one as ``nested_text``.
    """
    cols = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(F.lit(""), *(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit(NULL_MARK)) for c in cols))


def nested_text(column: str | Column) -> Column:
    """One text for a nested value: JSON without null fields, so that a new optional field keeps old keys."""
    return F.to_json(column)


def data_hash(*columns: str | Column) -> Column:
    return F.sha2(canonical_text(*columns), 256)


def memo_key(name: str | Column, version: int | Column, *columns: str | Column) -> Column:
    """``name-version-hash``: what a result is stored under. The code version is no part of it."""
    name = F.lit(name) if isinstance(name, str) else name
    version = F.lit(version) if isinstance(version, int) else version
    return F.concat_ws("-", name, version.cast("string"), data_hash(*columns))
