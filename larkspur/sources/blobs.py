"""Files with handles: scoped paths, import with versions, reading, history and encryption.

A handle is (path, byte_size, hash). Paths are relative to a root folder. Single files go through Hadoop's file systems on the
driver; ``sink``, ``import_files``, ``contents`` and ``listing`` take or give DataFrames, and executors move the bytes.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import HEAD_BYTES
from larkspur.sources import files
from larkspur.sources.files import head_hash
from larkspur.sources.shared import materialize

CHUNK = 4 << 20
IV_BYTES, TAG_BYTES = 12, 16


@dataclass(frozen=True)
class Handle:
    path: str
    byte_size: int
    hash: int


def scoped_path(prefix: list[str] | tuple[str, ...], data_hash: str | Column, name: str | Column) -> Column:
    """prefix/hash/name: a place of its own for each input, so invocations never collide."""
    cols = [F.col(x) if isinstance(x, str) else x for x in (data_hash, name)]
    return F.concat_ws("/", *map(F.lit, prefix), *cols)


class BlobStore:
    """Files under a root folder. Importing other content to a path keeps the old file as ``path.old.N``."""

    def __init__(self, spark: SparkSession, root: str, *, overwrite: bool = False, deletion: bool = False, prefix: tuple[str, ...] = ()):
        self.spark, self.root, self.overwrite, self.deletion, self.prefix = spark, root.rstrip("/"), overwrite, deletion, prefix
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getClass().getSimpleName() == "LocalFileSystem":
            self._fs = self._fs.getRaw()  # without checksum files, which executors do not write

    def scoped(self, *more: str) -> BlobStore:
        """The store with a longer prefix."""
        return self.at(*self.prefix, *more)

    def at(self, *prefix: str) -> BlobStore:
        """The store with another prefix."""
        return BlobStore(self.spark, self.root, overwrite=self.overwrite, deletion=self.deletion, prefix=prefix)

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}"

    def put(self, name: str, data: bytes) -> Handle:
        """Import bytes. The same content at the same path is left alone; a file appears whole or not at all."""
        path = "/".join((*self.prefix, name))
        made = Handle(path, len(data), head_hash(data))
        target = self._path(self.uri(path))
        if self._fs.exists(target):
            if self._fs.getFileStatus(target).getLen() == len(data) and self._read(path) == data:
                return made
            if not self.overwrite:
                n = 0
                while self._fs.exists(self._path(f"{self.uri(path)}.old.{n}")):
                    n += 1
                self._fs.rename(target, self._path(f"{self.uri(path)}.old.{n}"))
            else:
                self._fs.delete(target, False)
        part = self._path(f"{self.uri(path)}.part-{os.urandom(6).hex()}")
        out = self._fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        self._fs.mkdirs(target.getParent())
        self._fs.rename(part, target)
        return made

    def sink(self, rows: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
        """Handles of a file per row, written under the store's prefix where the rows are (see ``files.sink``)."""
        named = rows.withColumn(name_col, F.concat(F.lit("".join(f"{p}/" for p in self.prefix)), F.col(name_col)))
        return materialize(files.sink(named, self.root, name_col, content_col, overwrite=self.overwrite), "handles")

    def import_files(self, folder: str) -> DataFrame:
        """Handles of all files under a folder of any file system, copied by executors with their paths below it."""
        found = files.under(self.spark, folder)
        name = F.concat(F.lit("".join(f"{p}/" for p in self.prefix)), F.col("path"))
        dealt = found.select(F.concat(F.lit(f"{folder.rstrip('/')}/"), "path").alias("uri"), name.alias("name")).repartition(self.spark.sparkContext.defaultParallelism)
        return materialize(files.copy(dealt, self.root, overwrite=self.overwrite), "handles")

    def import_folder(self, folder: str) -> list[Handle]:
        """``import_files`` for folders of few files: their handles as a list."""
        return [Handle(*r) for r in self.import_files(folder).toLocalIterator()]

    def contents(self, handles: DataFrame) -> DataFrame:
        """(path, content) of files (path), read by executors."""
        return files.contents(handles, self.root)

    def local(self, handle: Handle) -> str:
        """A local copy, checked against the handle and reused while it fits."""
        return files.local_copy(self.root, handle.path, handle.byte_size, handle.hash)

    def _read(self, path: str, offset: int = 0, most: int | None = None) -> bytes:
        source = self._fs.open(self._path(self.uri(path)))
        try:
            source.seek(offset)
            return bytes(source.readAllBytes() if most is None else source.readNBytes(most))
        finally:
            source.close()

    def get(self, path: str, offset: int = 0) -> bytes:
        """The bytes of a file from an offset on."""
        return self._read(path, offset)

    def text(self, path: str) -> str:
        return self.get(path).decode("utf-8")

    def find(self, name: str) -> Handle | None:
        path = "/".join((*self.prefix, name))
        if not self._fs.exists(self._path(self.uri(path))):
            return None
        return Handle(path, self._fs.getFileStatus(self._path(self.uri(path))).getLen(), head_hash(self._read(path, 0, HEAD_BYTES)))

    def accessible(self, handle: Handle, *, content: bool = True) -> bool:
        """Whether the file is there, with its size and hash if ``content``."""
        target = self._path(self.uri(handle.path))
        if not self._fs.exists(target):
            return False
        if not content:
            return True
        return self._fs.getFileStatus(target).getLen() == handle.byte_size and head_hash(self._read(handle.path, 0, HEAD_BYTES)) == handle.hash

    def delete(self, handle: Handle) -> bool:
        """Delete a file if the store allows it and the file is the one the handle means."""
        return self.deletion and self.accessible(handle) and self._fs.delete(self._path(self.uri(handle.path)), False)

    def listing(self) -> DataFrame:
        """(path, byte_size, hash) of all files; executors read their heads, and nothing else of them."""
        return files.listed(files.under(self.spark, self.root), self.root)


class EncryptedStore(BlobStore):
    """A store whose files are AES-256-GCM in chunks: the chunk size (4 bytes), then per chunk IV, cipher text and tag.

    Handles are of the cipher text. Content equal to what is stored is left alone; reading from an offset decrypts from the start.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, *, chunk: int = CHUNK, **how):
        super().__init__(spark, root, **how)
        self.key, self.chunk = key, chunk
        if len(bytes.fromhex(key)) != 32:
            raise ValueError("a key is 32 bytes in hex")

    def at(self, *prefix: str) -> EncryptedStore:
        return EncryptedStore(self.spark, self.root, self.key, chunk=self.chunk, overwrite=self.overwrite, deletion=self.deletion, prefix=prefix)

    def put(self, name: str, data: bytes) -> Handle:
        found = self.find(name)
        if found is not None and self.get(found.path) == data:
            return found
        return super().put(name, encrypt(data, bytes.fromhex(self.key), self.spark, self.chunk))

    def get(self, path: str, offset: int = 0) -> bytes:
        return decrypt(self._read(path), bytes.fromhex(self.key), self.spark, offset)

    def local(self, handle: Handle) -> str:
        plain = f"{super().local(handle)}.plain-{os.urandom(4).hex()}"
        with open(plain, "wb") as out:
            out.write(self.get(handle.path))
        return plain

    def sink(self, rows: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
        return super().sink(rows.withColumn(content_col, encrypted(content_col, self.key, self.chunk)), name_col, content_col)

    def import_files(self, folder: str) -> DataFrame:
        found = files.under(self.spark, folder)
        return self.sink(files.contents(found, folder).withColumnRenamed("path", "name"))

    def contents(self, handles: DataFrame) -> DataFrame:
        return super().contents(handles).withColumn("content", decrypted("content", self.key))


def encrypted(content: str | Column, key: str, chunk: int = CHUNK) -> Column:
    """The parts of the cipher text of a column, in the form of ``EncryptedStore``: an array, the chunk size first."""
    data = F.coalesce((F.col(content) if isinstance(content, str) else content).cast("binary"), F.lit(b""))
    secret = F.unhex(F.lit(key))
    count = F.ceil(F.octet_length(data) / chunk).cast("int")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    coded = F.transform(every, lambda i: F.aes_encrypt(F.substring(data, i * chunk + 1, F.lit(chunk)), secret, F.lit("GCM")))
    return F.concat(F.array(F.lit(struct.pack(">i", chunk))), coded)


def decrypted(content: str | Column, key: str) -> Column:
    """The plain bytes of a column of files of an ``EncryptedStore``."""
    data = F.col(content) if isinstance(content, str) else content
    secret = F.unhex(F.lit(key))
    step = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("int") + IV_BYTES + TAG_BYTES
    count = F.ceil((F.octet_length(data) - 4) / step).cast("int")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    plain = F.transform(every, lambda i: F.aes_decrypt(F.substring(data, i * step + 5, step), secret, F.lit("GCM")))
    return F.aggregate(plain, F.lit(b""), lambda a, x: F.concat(a, x))


def encrypt(data: bytes, key: bytes, spark: SparkSession, chunk: int = CHUNK) -> bytes:
    """AES-256-GCM in chunks: the chunk size (4 bytes), then per chunk IV, cipher text and tag. Runs in the driver's JVM."""
    parts = []
    for i in range(0, len(data), chunk):
        iv = os.urandom(IV_BYTES)
        parts.append(iv + _cipher(spark, 1, key, iv, data[i : i + chunk]))
    return struct.pack(">i", chunk) + b"".join(parts)


def decrypt(data: bytes, key: bytes, spark: SparkSession, offset: int = 0) -> bytes:
    """The plain bytes from an offset on."""
    size = struct.unpack(">i", data[:4])[0] + IV_BYTES + TAG_BYTES
    parts = [data[i : i + size] for i in range(4, len(data), size)]
    return b"".join(_cipher(spark, 2, key, p[:IV_BYTES], p[IV_BYTES:]) for p in parts)[offset:]


def _cipher(spark: SparkSession, mode: int, key: bytes, iv: bytes, data: bytes) -> bytes:
    crypto = spark._jvm.javax.crypto
    cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(mode, crypto.spec.SecretKeySpec(bytearray(key), "AES"), crypto.spec.GCMParameterSpec(8 * TAG_BYTES, bytearray(iv)))
    return bytes(cipher.doFinal(bytearray(data)))


def histories(inputs: DataFrame, history: DataFrame) -> DataFrame:
    """(task, file, made_by): for rows (task, files) the recorded producer of each input file."""
    return inputs.select("task", F.explode("files").alias("file")).join(history, "file").select("task", "file", "made_by")
