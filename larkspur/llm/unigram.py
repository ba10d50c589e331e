"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The text gets the dummy prefix of its model and its spaces become whitespace markers. The segmentation of highest
total log score is found over a trie of the pieces' UTF-8 bytes; a character that no piece covers alone scores 10
less than the lowest piece and is spelled in byte pieces where the model has them (else unknown; a run of
unknown characters is one id). Of equal scores the segmentation whose last piece begins first wins.

Where no piece has a marker after another character, the best segmentation of a text is that of its parts
between such places, so each distinct part is solved once per batch, many at a time as array operations, and kept
in a bounded cache of the worker. Texts are read whole, without a shuffle.

Log scores: a unigram file has them. A file of merges has ranks instead, from which Zipf's rule makes log
scores: -ln(rank + 1) - ln(sum of 1 / (rank + 1) over all pieces).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.batches import slices
from larkspur.sources.shared import ship

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
CACHE = 300_000
FEW = 12
TRIES = 32


class DoubleArray:
    """A trie over byte strings: child c of node s is base[s] + c if check of that is s. value: item or -1."""

    def __init__(self, items: dict[bytes, int]):
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        root: dict = {}
        for text, item in items.items():
            node = root
            for b in text:
                node = node.setdefault(b, {})
            node[-1] = item
        todo, free, top = [(0, root)], 1, 1  # free: no free place is lower; top: from here on all are free
        while todo:
            s, node = todo.pop()
            value[s] = node.pop(-1, -1)
            if not node:
                continue
            own = sorted(node)
            while check[free] >= 0:
                free += 1
            # a few tries in the gaps, then behind everything
            at, tries = max(1, free - own[0]), 0
            while at + own[0] < top and any(check[at + c] >= 0 for c in own):
                at, tries = at + 1, tries + 1
                if tries == TRIES:
                    at = max(1, top - own[0])
            while max(at + own[-1], free) + 257 >= len(check):
                for array, fill in ((base, 0), (check, -1), (value, -1)):
                    array += [fill] * len(array)
            while any(check[at + c] >= 0 for c in own):
                at += 1
            base[s] = at
            for c in own:
                check[at + c] = s
                todo.append((at + c, node[c]))
            top = max(top, at + own[-1] + 1)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Model:
    """Pieces, log scores and settings of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = [p.type for p in proto.pieces]
        score = np.array([p.score for p in proto.pieces], np.float64)
        if proto.trainer_spec.model_type == pb.TrainerSpec.BPE:
            usable = np.isin(kinds, (NORMAL, USER_DEFINED))
            score = -np.log1p(-np.minimum(score, 0)) - np.log((1 / (1 - np.minimum(score, 0)))[usable].sum())
        self.score = score
        self.lists: tuple[list, ...] | None = None  # the trie for single steps, made when first needed
        self.kept = Parts()
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalization rules are supported")
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.fallback = proto.trainer_spec.byte_fallback and min(self.bytes) >= 0
        items = {p.piece.encode(): i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.unknown_score = float(min(score[i] for i in items.values())) - 10 if items else -10.0
        self.trie = DoubleArray(items)
        self.longest = max(map(len, items), default=0)
        self.splits = not any(MARKER in p.decode().lstrip(MARKER) for p in items)
        spoken = [
            p.piece.replace(MARKER, " ").encode() if p.type in (NORMAL, USER_DEFINED) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else b""
            for p in proto.pieces
        ]
        self.spoken_size = np.array([len(x) for x in spoken])
        self.spoken_start = np.cumsum(self.spoken_size) - self.spoken_size
        self.spoken_pool = np.frombuffer(b"".join(spoken), np.uint8)
        # a spelled character costs the unknown score, at its first byte
        self.price = score.copy()
        self.price[self.unknown] = self.unknown_score
        for b, i in enumerate(self.bytes):
            if i >= 0:
                self.price[i] = 0.0 if b & 0xC0 == 0x80 else self.unknown_score

    def parts(self, text: str) -> list[str]:
        """The parts of a text that are segmented on their own, with markers."""
        if not text:
            return []
        marked = (" " if self.prefix else "") + text
        marked = marked.replace(" ", MARKER)
        return re.findall(f"{MARKER}*[^{MARKER}]+|{MARKER}+", marked) if self.splits else [marked]

    def solve(self, parts: list[str], kept: Parts) -> None:
        """Add the ids of parts to ``kept``."""
        data = {p: p.encode("utf-8", "surrogatepass") for p in parts}
        order = sorted(parts, key=lambda p: len(data[p]))
        at = 0
        while at < len(order):
            shortest = len(data[order[at]])
            group = order[at : at + max(1, min(8192, (1 << 20) // (shortest + 8)))]
            if len(data[group[-1]]) > 2 * shortest + 8:
                group = [p for p in group if len(data[p]) <= 2 * shortest + 8]
            if len(group) > FEW:
                self._many(group, [data[p] for p in group], kept)
            else:
                for p in group:
                    ids = self._one(data[p])
                    kept.add([p], np.array(ids, np.int32), np.array([len(ids)]))
            at += len(group)

    def _path(self, data: bytes, piece: list[int], back: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(data)
        while end > 0:
            if piece[end] >= 0:
                ids.append(piece[end])
            elif self.fallback:
                ids += [self.bytes[b] for b in reversed(data[back[end] : end])]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            end = back[end]
        return ids[::-1]

    def _one(self, data: bytes) -> list[int]:
        """One part of any length, step by step."""
        if self.lists is None:
            self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        base, check, value, score = self.lists
        n = len(data)
        best, piece, back = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            node, here, alone = 0, best[i], False
            for end in range(i + 1, n + 1):
                t = base[node] + data[end - 1]
                if not base[node] or check[t] != node:
                    break
                node = t
                v = value[node]
                if v >= 0:
                    alone |= end - i == width
                    if here + score[v] > best[end]:
                        best[end], piece[end], back[end] = here + score[v], v, i
            if not alone and here + self.unknown_score > best[i + width]:
                best[i + width], piece[i + width], back[i + width] = here + self.unknown_score, -1, i
        return self._path(data, piece, back)

    def _many(self, parts: list[str], data: list[bytes], kept: Parts) -> None:
        """Many parts of similar length at once: each step of the trie is taken by all of them together."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        size = np.fromiter(map(len, data), np.int64, len(data))
        most = int(size.max())
        text = np.full((len(data), most + 1), -1, np.int32)
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), size)
        text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        best = np.full((len(data), most + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full(best.shape, -1, np.int32)
        back = np.zeros(best.shape, np.int32)
        for i in range(most):
            rows = np.flatnonzero((text[:, i] >= 0) & (text[:, i] & 0xC0 != 0x80))
            if not len(rows):
                continue
            lead = text[rows, i]
            width = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
            alone = np.zeros(len(data), bool)
            live, node, wide = rows, np.zeros(len(rows), np.int32), width
            for n in range(1, min(self.longest, most - i) + 1):
                c = text[live, i + n - 1]
                t = base[node] + c
                ok = (c >= 0) & (base[node] > 0)
                ok[ok] = check[t[ok]] == node[ok]
                live, node, wide = live[ok], t[ok], wide[ok]
                if not len(live):
                    break
                v = value[node]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    r, p = live[hit], v[hit]
                    alone[r[wide[hit] == n]] = True
                    score = best[r, i] + self.score[p]
                    better = score > best[r, i + n]
                    r = r[better]
                    best[r, i + n], piece[r, i + n], back[r, i + n] = score[better], p[better], i
            lost = ~alone[rows]
            r, end = rows[lost], i + width[lost]
            score = best[r, i] + self.unknown_score
            better = score > best[r, end]
            r, end = r[better], end[better]
            best[r, end], piece[r, end], back[r, end] = score[better], -1, i
        # all ways back at once: one step of each part at a time
        end, live, steps = size.copy(), np.arange(len(data)), []
        taken, odd = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
        while len(live):
            p = piece[live, end[live]]
            steps.append((live, p))
            odd[live] |= p < 0
            taken[live] += 1
            end[live] = back[live, end[live]]
            live = live[end[live] > 0]
        last = np.cumsum(taken) - 1
        ids = np.zeros(taken.sum(), np.int32)
        for i, (live, p) in enumerate(steps):
            ids[last[live] - i] = p
        if odd.any():  # parts with characters that no piece covers are spelled one by one
            plain = np.repeat(~odd, taken)
            kept.add([p for p, o in zip(parts, odd.tolist(), strict=True) if not o], ids[plain], taken[~odd])
            for r in np.flatnonzero(odd).tolist():
                own = self._path(data[r], piece[r].tolist(), back[r].tolist())
                kept.add([parts[r]], np.array(own, np.int32), np.array([len(own)]))
        else:
            kept.add(parts, ids, taken)

    def encode(self, texts: list[str | None], kept: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, their number per text, and the score of each; ``kept`` caches parts."""
        parts = [self.parts(t or "") for t in texts]
        new = set(chain.from_iterable(parts)).difference(kept.slot)
        if len(kept.slot) + len(new) > CACHE:
            kept.clear()
            new = set(chain.from_iterable(parts))
        self.solve(list(new), kept)
        per_text = np.fromiter(map(len, parts), np.int64, len(parts))
        slots = np.fromiter(map(kept.slot.__getitem__, chain.from_iterable(parts)), np.int64, per_text.sum())
        ids, size = kept.gather(slots)
        owner = np.repeat(np.repeat(np.arange(len(parts)), per_text), size)
        if not self.fallback and len(ids):  # runs of unknown characters over the ends of parts
            first = np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (owner[1:] != owner[:-1])]
            ids, owner = ids[first], owner[first]
        counts = np.bincount(owner, minlength=len(parts))
        return ids, counts, np.bincount(owner, self.price[ids], minlength=len(parts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids in a row: markers become spaces, byte pieces bytes (invalid ones U+FFFD), the dummy prefix goes."""
        size = self.spoken_size[ids]
        data = self.spoken_pool[np.repeat(self.spoken_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.cumsum(np.r_[0, counts])].tolist()
        texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


class Parts:
    """Solved parts: a slot for each, and the ids of all slots in one array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.slot)
        while n + len(parts) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.slot.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(parts)] = self.used + np.cumsum(counts)
        self.used += len(ids)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one after another, and their number per slot."""
        start = self.start[slots]
        size = self.start[slots + 1] - start
        return self.ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _with(df: DataFrame, added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c not in {f.name for f in added}]
    return kept, T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + added)


def _texts(texts: list[str], gap: np.ndarray) -> pa.Array:
    return pa.array([None if g else t for t, g in zip(texts, gap.tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, model: str, *, text_col: str = "text", decode_to: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``log_score`` for every row, and the text of its ids in ``decode_to`` if given.

    The new columns replace those of their names.

    Null text gives null ids and score; empty text gives no ids and score 0. Equal texts get equal ids. ``model`` is the
    path of a model file on the driver. An empty table gives no rows.
    """
    shared = ship(docs.sparkSession, "unigram", Model(model))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_score", T.DoubleType())]
    kept, schema = _with(docs, added + ([T.StructField(decode_to, T.StringType())] if decode_to else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                texts = part.column(text_col)
                gap = texts.is_null().to_numpy(zero_copy_only=False)
                ids, counts, score = shared().encode(texts.to_pylist(), shared().kept)
                ends = pa.array(np.cumsum(np.r_[0, counts]).astype(np.int32), mask=np.r_[gap, False])
                lists = pa.ListArray.from_arrays(ends, pa.array(ids))
                cols = [*(part.column(c) for c in kept), lists, pa.array(score, mask=gap)]
                if decode_to:
                    cols.append(_texts(shared().decode(ids, counts), gap))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids in column ``to``; null ids give null, an id outside the model an error."""
    shared = ship(tokens.sparkSession, "unigram", Model(model))
    kept, schema = _with(tokens, [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids_col)
                gap = lists.is_null().to_numpy(zero_copy_only=False)
                counts = np.where(gap, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                text = shared().decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _texts(text, gap)], schema.names)

    return tokens.mapInArrow(run, schema)
