"""Scalar functions over texts, paths, hashes and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 256 << 10
NAME_LENGTH = 80


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(content: str | Column) -> Column:
    """The first four bytes of the MD5 of the first 256 KiB, as a signed big-endian integer."""
    head = F.substring(_c(content).cast("binary"), 1, HEAD_BYTES)
    unsigned = F.conv(F.substring(F.md5(head), 1, 8), 16, 10).cast("bigint")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def full_content_hash(content: str | Column) -> Column:
    """SHA-256 of all bytes, for stores that should tell apart files with equal heads and sizes."""
    return F.sha2(_c(content).cast("binary"), 256)


def base64(content: str | Column) -> Column:
    """Base64 on one line, whatever its length; Spark may break it after 76 characters."""
    return F.translate(F.base64(_c(content).cast("binary")), "\r\n", "")


def session_of(proxy: str | Column) -> Column:
    """What stands before the first ``~``; null where that is nothing or there is none."""
    p = _c(proxy)
    return F.when(F.instr(p, "~") > 1, F.substring_index(p, "~", 1))


def uri_scheme(uri: str | Column) -> Column:
    """The scheme; a URI without one is a file."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(_c(uri), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))), F.lit("file"))


def uri_authority(uri: str | Column) -> Column:
    return F.regexp_extract(_c(uri), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def uri_path(uri: str | Column) -> Column:
    return F.regexp_extract(_c(uri), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def file_name(path: str | Column) -> Column:
    """The last segment that is not empty; null where there is none."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


def cache_file_name(key: str | Column, name: str | Column) -> Column:
    """A name for a local copy: SHA-256 of its key and up to 80 harmless characters of its name."""
    return F.concat_ws("-", F.sha2(_c(key), 256), F.substring(F.regexp_replace(_c(name), r"[^\p{L}\p{Nd}._-]", "_"), 1, NAME_LENGTH))


def java_hash(text: str) -> int:
    """Java's String.hashCode, for hashes of entity tags."""
    h = 0
    for unit in re.findall(b"..", text.encode("utf-16-be"), re.S):
        h = (31 * h + int.from_bytes(unit, "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def etag_hash(text: str | Column) -> Column:
    """``java_hash`` of a text of the basic plane as a column; -1 for null, as where a server names no tag."""
    units = F.filter(F.split(_c(text), ""), lambda x: x != "")
    h = F.aggregate(units, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + F.ascii(x)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(_c(text).isNull(), F.lit(-1).cast("bigint")).when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def part_size(part: str | Column, first: int, step: int = 800, most: int = 1_900_000_000, tiers: int = 40) -> Column:
    """Size of an upload part: ``first``, doubled after every ``step`` parts, at most ``most``."""
    tier = F.greatest(F.least(F.floor((_c(part) - 1) / step), F.lit(tiers)), F.lit(0))
    return F.least(F.lit(first).cast("double") * F.pow(F.lit(2.0), tier), F.lit(float(most))).cast("bigint")


def merge_maps(left: str | Column, right: str | Column, combine) -> Column:
    """Both maps; values of keys in both are combined, others kept as they are."""
    return F.map_zip_with(_c(left), _c(right), lambda _, a, b: F.when(a.isNotNull() & b.isNotNull(), combine(a, b)).otherwise(F.coalesce(a, b)))


def label_set(labels: str | Column, comma: str | Column) -> Column:
    """Labels of a list and of a comma-separated text, trimmed, without empty ones, each once."""
    more = F.transform(F.split(_c(comma), ","), lambda x: F.trim(x))
    return F.filter(F.array_union(F.transform(_c(labels), lambda x: F.trim(x)), more), lambda x: x != "")


def gpu_ids(ids: str | Column, comma: str | Column) -> Column:
    """Ids of a list and of a comma-separated text, sorted and distinct."""
    more = F.transform(F.filter(F.transform(F.split(_c(comma), ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(_c(ids), more)))
