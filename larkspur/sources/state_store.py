"""A shared state with compare-and-set: each version is a file that can be created only once."""

from __future__ import annotations

import gzip
import json
import random
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the version first, again and again."""


class VersionedState:
    """JSON state under a folder. ``update`` applies a pure function to the newest version and writes the next one.

    A version that another writer made meanwhile makes the update start over on it, with growing pauses. An unchanged state is
    not written. States are compressed; one of more than ``most`` bytes is refused before anything is written.
    """

    def __init__(self, spark: SparkSession, folder: str, *, most: int = (400 << 10) - (2 << 10), keep: int = 8):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._gateway, self.folder, self.most, self.keep = spark._sc._gateway, folder.rstrip("/"), most, keep
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[6:-3]) for n in names if n.startswith("state-") and n.endswith(".gz"))

    def _name(self, version: int) -> Any:
        return self._path(f"{self.folder}/state-{version:012d}.gz")

    def read(self) -> tuple[int, Any]:
        """The newest version and its state; 0 and None where there is none."""
        while True:
            versions = self._versions()
            if not versions:
                return 0, None
            try:
                source = self._fs.open(self._name(versions[-1]))
                data = bytes(source.readAllBytes())
                source.close()
                return versions[-1], json.loads(gzip.decompress(data))
            except Exception as e:
                if "FileNotFound" not in str(e):
                    raise

    def update(self, change: Callable[[Any], Any], tries: int = 20) -> Any:
        """The state after ``change``, applied exactly once."""
        for n in range(tries):
            version, state = self.read()
            new = change(json.loads(json.dumps(state)))
            if new == state:
                return state
            data = gzip.compress(json.dumps(new, separators=(",", ":")).encode())
            if len(data) > self.most:
                raise ValueError(f"the state has {len(data)} bytes; at most {self.most} are allowed")
            if self._create(version + 1, data):
                for old in self._versions()[: -self.keep]:
                    self._fs.delete(self._name(old), False)
                return new
            time.sleep(random.uniform(0, 0.01 * 2 ** min(n, 7)))
        raise Conflict(f"{tries} updates in a row met another writer")

    def _create(self, version: int, data: bytes) -> bool:
        part = self._path(f"{self.folder}/part-{random.getrandbits(64):x}")
        out = self._fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        try:
            # the file context fails on an existing target, where the file system may replace it
            context = self._gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs.getUri())
            options = self._gateway.new_array(self._gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(part, self._name(version), options)
            return True
        except Exception as e:
            self._fs.delete(part, False)
            if "AlreadyExists" in str(e):
                return False
            raise
