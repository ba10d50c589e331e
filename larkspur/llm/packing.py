"""Packing of tokenized documents into fixed-length training sequences, balanced by attention cost.

A document is its token ids followed by an end id. Whole blocks of ``capacity`` tokens become sequences of their own;
what is left of each document is packed. The cost of a piece of n tokens is ``linear * n + quadratic * n * n``
(attention does not cross documents), the cost of a sequence the sum over its pieces. Within a window of
consecutive documents the least number of sequences that can hold all tokens is opened, and documents, longest
first, go to the sequence of lowest cost that has room. A document for which no sequence has room is cut
over the cheapest sequences with any room, so a window leaves less than one sequence of padding.

Everything happens where the text is read: there is no shuffle, a task holds one window of remainders
(under ``window * capacity`` ids), and a lost executor costs the re-run of its input splits.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import slices
from larkspur.sources.shared import per_worker

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)
#: How byte-level BPE vocabularies spell bytes. Printable bytes stand for themselves, the
#: others for code points from 256 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the pre-tokenizer of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """``text -> ids`` for a byte-level BPE tokenizer file.

    Where the file is a plain byte-level BPE whose merges have the order of its ids, its ranks are run by the
    faster of the two installed libraries, which gives the same ids; any other file by the library that made it.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    spell = {chr(b): b for b in PRINTABLE}
    spell |= {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    made = [vocab.get(m.replace(" ", "", 1)) for m in merges]
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and not spec.get("normalizer")
        and not model.get("ignore_merges")
        and None not in made
        and made == sorted(made)
        and len(made) == len(vocab) - 256
        and all(c in spell for t in vocab for c in t)
    )
    if not plain:
        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    ranks = {bytes(spell[c] for c in t): i for t, i in vocab.items()}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents shorter than ``capacity``.

    Ties: equal lengths in the order given, equal costs to the sequence opened first.
    """
    n = -(-sum(lengths) // capacity)
    free, cost = np.full(n, capacity), np.zeros(n)
    pieces = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[d]
        while left:
            fits = free >= left
            if not fits.any():
                fits = free > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            k = min(left, int(free[s]))
            pieces.append((d, start, k, s, capacity - int(free[s])))
            free[s] -= k
            cost[s] += linear * k + quadratic * k * k
            start, left = start + k, left - k
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    window: int = 4096,
) -> DataFrame:
    """One row per piece (see the module) of every row of ``docs``; columns as in ``SCHEMA``.

    Null text counts as empty: the document is its end id alone. Repeated rows are packed each on its own; a null id
    stays null; other columns are ignored; an empty table gives no rows. ``tokenizer`` is the path of a tokenizer
    file on every executor. ``sequence_id`` is unique over the result, and ``offset`` is gapless from 0 in each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("encoder", tokenizer), lambda: encoder(tokenizer))
        here = TaskContext.get().partitionId() << 40
        sequences = 0
        rows: list[tuple] = []
        held: list[tuple] = []  # doc id, start of the remainder, ids of the remainder, ids of the document

        def price(n: int) -> float:
            return linear * n + quadratic * n * n

        def flush() -> None:
            nonlocal sequences
            lengths = [len(h[2]) for h in held]
            for d, start, k, s, offset in assign(lengths, capacity, linear, quadratic):
                doc, base, ids, total = held[d]
                crc = zlib.crc32(ids[start : start + k])
                rows.append((doc, base + start, k, crc, total, here + sequences + s, offset, price(k)))
            sequences += -(-sum(lengths) // capacity)
            held.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 7 + [pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            for part in slices(batch, text_col):
                ids_of = part.column(id_col).to_pylist()
                for doc, text in zip(ids_of, part.column(text_col).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), end_id).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        crc = zlib.crc32(ids[start : start + capacity])
                        rows.append((doc, start, capacity, crc, len(ids), here + sequences, 0, price(capacity)))
                        sequences += 1
                    if whole < len(ids):
                        held.append((doc, whole, ids[whole:].copy(), len(ids)))
                    if len(held) >= window:
                        flush()
                if len(rows) >= 20_000:
                    yield out()
        flush()
        yield out()

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, SCHEMA.replace("doc_id", f"`{id_col}`", 1)
    )
