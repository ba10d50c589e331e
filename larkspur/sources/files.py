"""Files opened, hashed, copied and written where the rows are: executors move the bytes, the driver sees handles only."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import HEAD_BYTES
from larkspur.sources.shared import materialize

HANDLES = "path string, byte_size long, hash int"
PIECE = 8 << 20
#: Files beside others that Hadoop's local file system keeps for itself.
CHECKSUM = re.compile(r"\..*\.crc$")


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3 or s3a, gs or a plain path)."""
    if "://" not in uri or uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    authority, _, path = rest.partition("/")
    # names may hold what a URI would have to escape, so only the store is parsed
    system, top = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}")
    return system, f"{top.rstrip('/')}/{path}"


def head_hash(head: bytes) -> int:
    """The content hash of ``scalars.content_hash`` for the first bytes of a file."""
    return struct.unpack(">i", hashlib.md5(head[:HEAD_BYTES]).digest()[:4])[0]


def pieces(system: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """The bytes of a file, a piece at a time."""
    with system.open_input_stream(path, compression=None) as source:
        while piece := source.read(PIECE):
            yield piece


def handle_at(system: pafs.FileSystem, path: str) -> tuple[int, int] | None:
    """(size, hash) of a file, from its head alone; None where there is none."""
    info = system.get_file_info(path)
    if info.type != pafs.FileType.File:
        return None
    with system.open_input_stream(path, compression=None) as source:
        return info.size, head_hash(source.read(HEAD_BYTES))


def _equal(system: pafs.FileSystem, one: str, two: str) -> bool:
    a, b = (system.get_file_info(p) for p in (one, two))
    if b.type != pafs.FileType.File or a.size != b.size:
        return False
    with system.open_input_stream(one, compression=None) as x, system.open_input_stream(two, compression=None) as y:
        while p := x.read(PIECE):
            if p != y.read(PIECE):
                return False
    return True


def put(root: str, path: str, content: Iterable[bytes], overwrite: bool) -> tuple[str, int, int]:
    """Write a file; returns its handle (path, size, hash). A file appears whole or not at all.

    The same content at a path is left alone, so a row that runs again changes nothing. Other content replaces it
    (``overwrite``), or the old file is kept as ``path.old.N``.
    """
    system, target = open_path(f"{root}/{path}")
    system.create_dir(os.path.dirname(target), recursive=True)
    part, size, head = f"{target}.part-{os.urandom(6).hex()}", 0, b""
    with system.open_output_stream(part, compression=None) as out:
        for piece in content:
            out.write(piece)
            size += len(piece)
            if len(head) < HEAD_BYTES:
                head += piece[: HEAD_BYTES - len(head)]
    if _equal(system, part, target):
        system.delete_file(part)
        return path, size, head_hash(head)
    if not overwrite and system.get_file_info(target).type == pafs.FileType.File:
        n = 0
        while system.get_file_info(f"{target}.old.{n}").type != pafs.FileType.NotFound:
            n += 1
        system.move(target, f"{target}.old.{n}")
    system.move(part, target)
    return path, size, head_hash(head)


def sink(rows: DataFrame, root: str, name_col: str, content_col: str, *, overwrite: bool = False) -> DataFrame:
    """Handles (path, byte_size, hash) of a file per row, written by the executors that hold the rows.

    The content is text, bytes, or an array of either, written one after another; null is empty. Names are paths below ``root``
    and tell the rows apart; rows without a name write nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                parts = [] if content is None else [content] if isinstance(content, str | bytes | bytearray) else content
                made.append(put(root, name, (p.encode() if isinstance(p, str) else bytes(p) for p in parts), overwrite))
            yield pd.DataFrame(made, columns=["path", "byte_size", "hash"])

    named = rows.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name"), F.col(content_col).alias("content"))
    return named.mapInPandas(run, HANDLES)


def under(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, empty ones too, relative to it: executors list the folders of a level together."""
    kinds = "path string, is_file boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, at = open_path(f"{folder}/{path}" if path else folder)
                found = system.get_file_info(pafs.FileSelector(at, allow_not_found=True))
                rows = [(f"{path}/{x.base_name}" if path else x.base_name, x.type == pafs.FileType.File) for x in found if not CHECKSUM.match(x.base_name)]
                yield pd.DataFrame(rows, columns=["path", "is_file"])

    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        here = materialize(level.mapInPandas(run, kinds), "listing")
        found.append(here.where("is_file").select("path"))
        level = here.where("not is_file").select("path")
        if level.isEmpty():
            return functools.reduce(DataFrame.union, found)
        level = level.repartition(spark.sparkContext.defaultParallelism)


def copy(files: DataFrame, root: str, *, overwrite: bool = False) -> DataFrame:
    """Handles of files (uri, name) of any file system, copied below ``root`` a piece at a time by executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [put(root, name, pieces(*open_path(uri)), overwrite) for uri, name in zip(batch["uri"], batch["name"], strict=True)]
            yield pd.DataFrame(made, columns=["path", "byte_size", "hash"])

    return files.select("uri", "name").mapInPandas(run, HANDLES)


def listed(paths: DataFrame, root: str) -> DataFrame:
    """Handles of those of the paths (path) below ``root`` that are files; only their heads are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, handle_at(*open_path(f"{root}/{p}"))) for p in batch["path"]]
            yield pd.DataFrame([(p, *h) for p, h in found if h is not None], columns=["path", "byte_size", "hash"])

    return paths.select("path").mapInPandas(run, HANDLES)


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of files below ``root``, each read whole by the executor that holds its row, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame({"path": [path], "content": [b"".join(pieces(*open_path(f"{root}/{path}")))]})

    return paths.select("path").mapInPandas(run, "path string, content binary")


def registered(uris: DataFrame) -> DataFrame:
    """Handles of files anywhere (uri), by their URIs; those that are not there have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(u, handle_at(*open_path(u))) for u in batch["uri"]]
            yield pd.DataFrame([(u, *h) for u, h in found if h is not None], columns=["path", "byte_size", "hash"])

    return uris.select("uri").mapInPandas(run, HANDLES)


def read(root: str, path: str, offset: int = 0) -> bytes:
    """The bytes of a file from an offset on, where this is called: in a task body, for a handle among its inputs."""
    system, target = open_path(f"{root}/{path}")
    with system.open_input_file(target) as source:
        source.seek(offset)
        return source.read()


def local_copy(root: str, path: str, byte_size: int, hash: int) -> str:
    """The path of a copy of a file on this machine, made once and checked against its handle whenever it is used."""
    key = hashlib.sha256(f"{root}/{path}:{byte_size}:{hash}".encode()).hexdigest()
    target = os.path.join(tempfile.gettempdir(), f"{key}-{''.join(c if c.isalnum() or c in '._-' else '_' for c in path.rsplit('/', 1)[-1])[:80]}")
    if not os.path.exists(target) or handle_at(pafs.LocalFileSystem(), target) != (byte_size, hash):
        part = f"{target}.{os.getpid()}-{os.urandom(4).hex()}"
        with open(part, "wb") as out:
            for piece in pieces(*open_path(f"{root}/{path}")):
                out.write(piece)
        os.replace(part, target)
    if handle_at(pafs.LocalFileSystem(), target) != (byte_size, hash):
        raise FileNotFoundError(f"{root}/{path} is not the file of {byte_size} bytes and hash {hash}")
    return target
