"""Language identification in two steps: language family first, then the language within it.

Features of a text: its letters in lower case, every run of other characters one space, as UTF-8; counts of the byte
1-, 2- and 3-grams of the whole text, hashed into ``dims`` bins; square roots of their shares (a unit vector). Linear
support vector machines (squared hinge loss) decide: one against the rest between families, one against one
between the languages of a family, by votes and then by summed margins; in a family of more than WIDE languages, whose
pairs would be too many, one against the rest. A sigmoid fitted to the training margins
turns a margin into a confidence; the score of a prediction is the product of the two steps' confidences.

Only the fit is bounded: of each language at most ``sample`` different texts, those with the smallest hash, take part,
``rows`` over all languages, and at most ``labels`` languages, those with the most rows. Each Spark task keeps the smallest hashes of the texts
it reads and each text among the chosen ones once, so copies of a text, however many, count once and the driver
gets ``rows`` sparse vectors at most. Prediction runs where the text is read, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.batches import slices
from larkspur.sources.shared import ship

UNKNOWN = "und"
#: Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
OTHER = re.compile(r"[\W\d_]+")
CHUNK = 1 << 20
#: Languages of a family up to which every pair has a test of its own.
WIDE = 48
PARTS = 32


def family_of(lang: str) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


def features(text: str | None, dims: int) -> np.ndarray | None:
    """The unit vector of a whole text, or None if it is null or has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = f" {OTHER.sub(' ', text.lower())} ".encode()
    counts = np.zeros(dims)
    for at in range(0, len(data), CHUNK):  # of long texts a part at a time; parts overlap by two bytes
        b = np.frombuffer(data[max(0, at - 2) : at + CHUNK], np.uint8).astype(np.uint32)
        new = min(at, 2)
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 257 + b[2:]
        for grams, skip, mix in ((b, new, 2654435761), (two, max(0, new - 1), 2246822519), (three, 0, 3266489917)):
            counts += np.bincount((grams[skip:] * np.uint32(mix)) >> np.uint32(32 - dims.bit_length() + 1), minlength=dims)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss (a last weight is the bias), by accelerated gradient steps.

    y is 1 or -1; both classes weigh the same in the loss.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 100
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # the largest eigenvalue of the weighted Gram matrix
        v = x.T @ (weight.astype(x.dtype) * (x @ v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1 + 2 * np.linalg.norm(x.T @ (weight.astype(x.dtype) * (x @ v))))
    w = ahead = np.zeros(x.shape[1], np.float64)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(x.dtype)))
        new = ahead - step * (ahead - 2 * (x.T @ (weight * y * slack).astype(x.dtype)))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_sigmoid(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that turns a margin into the probability of y = 1 (smoothed targets, Newton)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """The fitted two-step classifier; ``langs`` may be empty (everything is unknown)."""

    def __init__(self, x: np.ndarray, langs: list[str], dims: int):
        self.dims, self.langs = dims, sorted(set(langs))
        of = np.array([family_of(k) for k in langs])
        lang = np.array(langs)
        self.families = sorted(set(of))
        self.members = {f: [k for k in self.langs if family_of(k) == f] for f in self.families}
        self.tests: list[tuple[str, str, str]] = []  # kind or family, for, against
        rows: list[np.ndarray] = []
        scale: list[tuple[float, float]] = []

        def add(name: tuple[str, str, str], keep: np.ndarray, y: np.ndarray) -> None:
            w = fit_svm(x[keep], y)
            m = x[keep] @ w[:-1].astype(np.float32) + w[-1]
            self.tests.append(name)
            rows.append(w)
            scale.append(fit_sigmoid(m, y))

        every = np.ones(len(lang), bool)
        if len(self.families) == 2:
            add(("", self.families[0], self.families[1]), every, np.where(of == self.families[0], 1.0, -1.0))
        elif len(self.families) > 2:
            for f in self.families:
                add(("", f, ""), every, np.where(of == f, 1.0, -1.0))
        for f, own in self.members.items():
            if len(own) > WIDE:
                keep = of == f
                for p in own:
                    add((f, p, ""), keep, np.where(lang[keep] == p, 1.0, -1.0))
                continue
            for p, q in combinations(own, 2):
                keep = (lang == p) | (lang == q)
                add((f, p, q), keep, np.where(lang[keep] == p, 1.0, -1.0))
        self.own_tests = {f: [(i, p, q) for i, (g, p, q) in enumerate(self.tests) if g == f] for f in self.families}
        self.weights = np.array(rows, np.float32).reshape(-1, dims + 1).T.copy()
        self.scale = np.array(scale).reshape(-1, 2)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score for each row of x."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(x)
        margins = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-np.clip(margins * self.scale[:, 0] + self.scale[:, 1], -30, 30)))
        out = []
        for m, s in zip(margins, sure, strict=True):
            family, score = self.families[0], 1.0
            if len(self.families) == 2:
                family, score = (self.families[0], s[0]) if s[0] >= 0.5 else (self.families[1], 1 - s[0])
            elif len(self.families) > 2:
                k = int(s[: len(self.families)].argmax())
                family, score = self.families[k], s[k]
            own = self.members[family]
            best = own[0]
            tests = self.own_tests[family]
            if len(own) > WIDE:
                k = max(tests, key=lambda t: s[t[0]])
                best, score = k[1], score * s[k[0]]
            elif len(own) > 1:
                votes = dict.fromkeys(own, (0, 0.0))
                for i, p, q in tests:
                    n, t = votes[p if s[i] >= 0.5 else q]
                    votes[p if s[i] >= 0.5 else q] = (n + 1, t)
                    votes[p] = (votes[p][0], votes[p][1] + float(m[i]))
                    votes[q] = (votes[q][0], votes[q][1] - float(m[i]))
                best = max(own, key=votes.get)
                score *= min(s[i] if p == best else 1 - s[i] for i, p, q in tests if best in (p, q))
            out.append((best, float(min(1.0, max(0.0, score)))))
        return out


def fit(labelled: DataFrame, *, text_col: str, lang_col: str, sample: int, rows: int, labels: int, dims: int) -> Model:
    """Fit on at most ``sample`` different texts of each language (see the module)."""
    spark = labelled.sparkSession
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).cast("string").rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(labels).collect()
    if not counts:
        return Model(np.zeros((0, dims), np.float32), [], dims)
    if len(counts) == labels:
        known = known.where(F.col("lang").isin([r.lang for r in counts]))
    each = max(2, min(sample, rows // len(counts)))
    known = known.withColumn("place", F.xxhash64("text"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            names, of = np.unique(batch.column("lang").to_numpy(zero_copy_only=False), return_inverse=True)
            place = batch.column("place").to_numpy()
            for k, name in enumerate(names.tolist()):
                found = place[of == k]
                kept[name] = np.unique(np.concatenate([kept[name], found]) if name in kept else found)[:each]
        for name, places in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places)], ["lang", "place"])

    # twice: each Spark task keeps the least it reads, then PARTS ones those of all; the driver merges PARTS * rows at most
    kinds = "lang string, place long"
    found = known.select("lang", "place").mapInArrow(smallest, kinds).repartition(PARTS).mapInArrow(smallest, kinds).collect()
    places: dict[str, list[int]] = {}
    for r in found:
        places.setdefault(r.lang, []).append(r.place)
    limits = [(k, sorted(set(v))[:each][-1]) for k, v in places.items()]
    limit = F.broadcast(spark.createDataFrame(limits, "lang string, last long"))
    chosen = known.join(limit, "lang").where("place <= last").select("lang", "text", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for k, at, t in zip(*(part.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True):
                    if (k, at) not in seen:
                        seen.add((k, at))
                        found.append((k, at, features(t, dims)))
                found = [(k, at, v) for k, at, v in found if v is not None]
                bins = [np.flatnonzero(v) for _, _, v in found]
                cols = [[k for k, _, _ in found], [at for _, at, _ in found], [i.astype("<u2").tobytes() for i in bins], [v[i].astype("<f4").tobytes() for (_, _, v), i in zip(found, bins, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lang", "place", "bins", "values"])

    got = chosen.mapInArrow(run, "lang string, place long, bins binary, values binary").dropDuplicates(["lang", "place"]).collect()
    got.sort(key=lambda r: (r.lang, r.place))
    x = np.zeros((len(got), dims), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r.bins, "<u2")] = np.frombuffer(r["values"], "<f4")
    return Model(x, [r.lang for r in got], dims)


def identify(
    docs: DataFrame,
    learn_from: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 400,
    rows: int = 20_000,
    labels: int = 1024,
    dims: int = 4096,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) for every row; both replace columns of these names.

    The model learns from the rows where ``learn_from`` holds and ``lang_col`` is not null, at most ``sample`` different texts of each
    language, ``rows`` in all (two of each at least) and the ``labels`` languages with the most rows; a prediction sees the text alone. Text that is null or without a letter, and every text if there
    is nothing to learn from, gets ``und`` with score 0. Equal texts get equal predictions; ties between languages
    go to the first in order of votes, margins and then code. Very long texts count whole. Repeated rows each get their
    prediction; other columns stay as they are. An empty table gives no rows. ``dims`` is a power of two
    up to 65536.
    """
    model = fit(docs.where(learn_from), text_col=text_col, lang_col=lang_col, sample=sample, rows=rows, labels=labels, dims=dims)
    shared = ship(docs.sparkSession, "langid", model)
    kept = docs.drop("lang_pred", "score")
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        for batch in batches:
            for part in slices(batch, text_col):
                found = [features(t, dims) for t in part.column(text_col).to_pylist()]
                letters = [v for v in found if v is not None]
                said = iter(m.predict(np.array(letters, np.float32).reshape(-1, dims)))
                out = [(UNKNOWN, 0.0) if v is None else next(said) for v in found]
                cols = [pa.array([x[i] for x in out], schema.types[i]) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *schema.names])

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema.fields]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType(fields + added))
