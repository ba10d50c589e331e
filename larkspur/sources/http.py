"""Files behind HTTP: sizes and entity tags, reading by ranges with retries, and download into a folder, by executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from larkspur.functions.scalars import java_hash
from larkspur.sources.files import HANDLES, put

PART = 50 << 20
RETRIES = 3
TIMEOUT = 60


def _ask(url: str, method: str, first: int | None, last: int | None, retries: int, wait: float) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body); server errors, cut bodies and lost connections are tried again, with growing pauses."""
    for n in range(retries + 1):
        try:
            headers = {} if first is None else {"Range": f"bytes={first}-{last}"}
            with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=TIMEOUT) as answer:
                body = answer.read()
                return answer.status, {k.lower(): v for k, v in answer.headers.items()}, body
        except urllib.error.HTTPError as e:
            if e.code < 500 or n == retries:
                raise
        except OSError:
            if n == retries:
                raise
        except Exception as e:  # a body that ends early
            if n == retries:
                raise OSError(f"{url}: {e}") from e
        time.sleep(wait * 2**n)
    raise AssertionError


def describe(url: str, *, retries: int = RETRIES, wait: float = 0.5) -> tuple[int, int, bool]:
    """(size, hash, takes ranges): the hash is that of the entity tag, -1 without one; the size is -1 if the server does not tell it."""
    _, headers, _ = _ask(url, "HEAD", None, None, retries, wait)
    tag = headers.get("etag")
    return int(headers.get("content-length", -1)), -1 if tag is None else java_hash(tag), "bytes" in headers.get("accept-ranges", "")


def pieces(url: str, *, offset: int = 0, part: int = PART, retries: int = RETRIES, wait: float = 0.5) -> Iterator[bytes]:
    """The bytes of a file from an offset on, a range at a time where the server gives ranges, else in one piece."""
    size, _, ranges = describe(url, retries=retries, wait=wait)
    if ranges and size > 0:
        for first in range(offset, size, part):
            last = min(first + part, size) - 1
            status, _, body = _ask(url, "GET", first, last, retries, wait)
            if status != 206:  # a promise not kept: the whole file
                yield body[first:]
                return
            if len(body) != last - first + 1:
                raise OSError(f"{url}: {len(body)} bytes for {first} to {last}")
            yield body
        return
    yield _ask(url, "GET", None, None, retries, wait)[2][offset:]


def registered(urls: DataFrame, *, retries: int = RETRIES, wait: float = 0.5) -> DataFrame:
    """Handles of files (url), by their URLs; what a server does not give has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for url in batch["url"]:
                try:
                    size, tag, _ = describe(url, retries=retries, wait=wait)
                except OSError:
                    continue
                made.append((url, size, tag))
            yield pd.DataFrame(made, columns=["path", "byte_size", "hash"])

    return urls.select("url").mapInPandas(run, HANDLES)


def fetched(urls: DataFrame, *, part: int = PART, retries: int = RETRIES, wait: float = 0.5) -> DataFrame:
    """(url, content, error): the bytes of every file (url), or why there are none. A row fails on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                try:
                    row = (url, b"".join(pieces(url, part=part, retries=retries, wait=wait)), None)
                except (OSError, ValueError) as e:
                    row = (url, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["url", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, content binary, error string")


def downloaded(urls: DataFrame, root: str, *, part: int = PART, retries: int = RETRIES, wait: float = 0.5, overwrite: bool = False) -> DataFrame:
    """Handles of files (url, name) written below ``root`` as ranges come in; one that cannot be read fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [put(root, name, pieces(url, part=part, retries=retries, wait=wait), overwrite) for url, name in zip(batch["url"], batch["name"], strict=True)]
            yield pd.DataFrame(made, columns=["path", "byte_size", "hash"])

    return urls.select("url", "name").mapInPandas(run, HANDLES)
