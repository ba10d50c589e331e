"""Persistent memoization of named, versioned functions over rows.

A task is a name, a version, a function over pandas batches and the columns that make its key. ``submit`` answers every
row of a DataFrame: rows with equal keys run once, keys in the store are not run, results are written to the store before
they are returned. Results are stored as JSON, so a result that no longer decodes under the task's schema counts
as a miss. A row whose function fails carries an error instead of a value; other rows are not affected.
"""

from __future__ import annotations

import base64
import functools
import threading
import types
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.keys import memo_key, nested_text
from larkspur.operators.settings import Settings
from larkspur.operators.sets import file_handles
from larkspur.sources.shared import materialize, per_worker

#: The memo key while rows are answered; no input column may have this name.
KEY = "__memo_key"
STORE = "key string, task string, version int, result string, started timestamp, ended timestamp, lineage array<string>"


class SubmissionError(RuntimeError):
    """A task body tried to submit, or a task is not well defined."""


@dataclass(frozen=True)
class Task:
    """A named, versioned function: pandas rows in, pandas rows of ``out`` in the same order."""

    name: str
    version: int
    body: Callable[[pd.DataFrame], pd.DataFrame]
    columns: tuple[str, ...]
    out: T.StructType
    key_columns: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)

    def key(self, schema: T.StructType | None = None) -> Column:
        """The memo key; it covers ``key_columns`` if given (the rest of the input does not matter), else all inputs.

        With the schema of the rows, nested columns count as their canonical JSON, maps in order of their keys.
        """
        kinds = {f.name: f.dataType for f in schema.fields} if schema else {}

        def part(c: str) -> str | Column:
            if isinstance(kinds.get(c), T.MapType):
                return nested_text(F.array_sort(F.map_entries(c)))
            return nested_text(c) if isinstance(kinds.get(c), T.ArrayType | T.StructType) else c

        return memo_key(self.name, self.version, *map(part, self.key_columns or self.columns))


REGISTRY: dict[tuple[str, int], Task] = {}


def task(name: str, version: int, columns: list[str], out: str, key_columns: list[str] | None = None, **labels: str) -> Callable:
    """Register a function as a task. A function with captured variables is refused: its key would not cover them."""

    def register(body: Callable[[pd.DataFrame], pd.DataFrame]) -> Task:
        if isinstance(body, types.FunctionType) and body.__closure__:
            raise SubmissionError(f"the body of {name} captures variables; pass them as columns")
        made = Task(name, version, body, tuple(columns), T._parse_datatype_string(out), tuple(key_columns or ()), labels)
        REGISTRY[name, version] = made
        return made

    return register


class Store:
    """Results by key, a Parquet table partitioned by task and version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, t: Task | None = None) -> DataFrame:
        """All results, or those of a task; an unreadable or missing store is empty."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(conf).exists(at):
            return self.spark.createDataFrame([], STORE)
        found = self.spark.read.schema(STORE).option("ignoreCorruptFiles", "true").parquet(self.path)
        return found.where((F.col("task") == t.name) & (F.col("version") == t.version)) if t else found

    def append(self, results: DataFrame) -> None:
        results.select(*(f.split()[0] for f in STORE.split(", "))).write.mode("append").partitionBy("task", "version").parquet(self.path)


def hits(keys: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Keys with a stored result."""
    return keys.join(store.select(key), key, "left_semi")


def misses(keys: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Keys without one; these are run."""
    return keys.join(store.select(key), key, "left_anti")


def coalesced(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row per key: what is run for all rows that share it."""
    return rows.dropDuplicates([key])


def waiters(rows: DataFrame, key: str = "key", proxy: str = "proxy") -> DataFrame:
    """(key, proxies, n): the distinct waiters of each key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(proxy)).alias("proxies"), F.count_distinct(proxy).alias("n"))


def newest_request(rows: DataFrame, key: str, request: str, order: str) -> DataFrame:
    """(key, request, n_requests): where submissions of a key ask for different resources, the newest counts."""
    return rows.groupBy(key).agg(F.max_by(request, order).alias(request), F.count_distinct(request).alias("n_requests"))


def fan_out(results: DataFrame, waiting: DataFrame, key: str = "key") -> DataFrame:
    """A row per waiter with the result of its key."""
    return waiting.join(results, key)


def verify_files(results: DataFrame, listing: DataFrame, *, key: str = "key", check_content: bool = True) -> DataFrame:
    """(key, valid): whether all files that a result refers to are in the listing.

    results: (key, files array<struct<path, byte_size, hash, mutable>>); listing: (path, byte_size, hash). Immutable files
    must have the listed size and hash as well; mutable ones must exist. A result without files is valid.
    """
    each = results.select(key, F.explode_outer("files").alias("f")).select(key, "f.*")
    there = listing.select("path", F.col("byte_size").alias("_size"), F.col("hash").alias("_hash"), F.lit(True).alias("_there"))
    same = F.col("mutable") | ((F.col("byte_size") == F.col("_size")) & (F.col("hash") == F.col("_hash"))) if check_content else F.lit(True)
    ok = F.col("path").isNull() | F.coalesce(F.col("_there") & same, F.lit(False))
    return each.join(there, "path", "left").groupBy(key).agg(F.bool_and(ok).alias("valid"))


def all_or_run(wanted: DataFrame, listing: DataFrame, group: str, path: str = "path") -> DataFrame:
    """(group, n_wanted, n_found, complete): a list of files replaces a run only if every one of them exists."""
    found = listing.select(F.col(path)).distinct().withColumn("_there", F.lit(1))
    joined = wanted.select(group, path).distinct().join(found, path, "left")
    counted = joined.groupBy(group).agg(F.count("*").alias("n_wanted"), F.count("_there").alias("n_found"))
    return counted.withColumn("complete", F.col("n_wanted") == F.col("n_found"))


def _plain(x: Any) -> Any:
    """What JSON has no form for, in the form that Spark's reader of JSON expects; anything else fails its row."""
    if isinstance(x, bytes | bytearray | memoryview):
        return base64.b64encode(bytes(x)).decode()
    if isinstance(x, Decimal):
        return str(x)
    for name in ("isoformat", "tolist"):  # dates and times; arrays and their scalars
        if hasattr(x, name):
            return getattr(x, name)()
    raise TypeError(f"a result of type {type(x).__name__} cannot be stored")


def _run_bodies(rows: DataFrame, t: Task) -> DataFrame:
    """(key, result, error, started, ended) for each row of (KEY, columns)."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        names = [f.name for f in t.out.fields]

        def call(part: pd.DataFrame) -> tuple[list, list]:
            made = t.body(part[list(t.columns)].reset_index(drop=True))
            if len(made) != len(part):
                raise ValueError(f"{t.name} returned {len(made)} rows for {len(part)}")
            records = made[names].astype(object).where(made[names].notna(), None).to_dict("records")
            return [json.dumps({k: v for k, v in r.items() if v is not None}, default=_plain) for r in records], [None] * len(part)

        for batch in batches:
            started = pd.Timestamp.now()
            try:
                value, error = call(batch)
            except Exception:  # find the rows that fail; the others keep their results
                value, error = [], []
                for i in range(len(batch)):
                    try:
                        v, e = call(batch.iloc[i : i + 1])
                    except Exception as x:
                        v, e = [None], [f"{type(x).__name__}: {x}"]
                    value += v
                    error += e
            yield pd.DataFrame({"key": batch[KEY], "result": value, "error": error, "started": started, "ended": pd.Timestamp.now()})

    return rows.select(KEY, *t.columns).mapInPandas(body, "key string, result string, error string, started timestamp, ended timestamp")


def decoded(results: DataFrame, schema: T.StructType) -> DataFrame:
    """(key, value) of the stored results that decode under a schema; others are no results."""
    strict = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = results.select("key", F.from_json("result", strict, {"mode": "PERMISSIVE"}).alias("v")).where("v is not null and v._corrupt_record is null")
    return parsed.select("key", F.struct(*(F.col("v")[f.name].alias(f.name) for f in schema.fields)).alias("value"))


def verified(results: DataFrame, listing: DataFrame, *, check_content: bool = True) -> DataFrame:
    """The rows of results (key, value) all of whose files are in the listing (see ``verify_files``).

    Files are found in the value wherever they are nested, as structs with a path and a hash. A field ``mutable`` marks those
    that need only exist; without it all are immutable.
    """
    handles = file_handles(results.select("value"))
    if handles is None:
        return results
    kind = results.select(handles.alias("h")).schema["h"].dataType.elementType.names
    gone = lambda h: h["mutable"] if "mutable" in kind else F.lit(False)
    files = F.transform(handles, lambda h: F.struct(h["path"].alias("path"), h["byte_size"].alias("byte_size"), h["hash"].alias("hash"), gone(h).alias("mutable")))
    valid = verify_files(results.select("key", files.alias("files")), listing, check_content=check_content).where("valid")
    return results.join(valid.select("key"), "key", "left_semi")


def executed(t: Task, todo: DataFrame, store: Store | None, attempts: int = 1, lineage: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run different keys (KEY and the task's columns) and store their results: (key, result, error, started, ended) of those that
    succeeded and of those that failed ``attempts`` times."""
    done = None
    for n in range(max(1, attempts)):
        ran = materialize(_run_bodies(todo, t), "memo-run")
        good, bad = ran.where("error is null"), ran.where("error is not null")
        done = good if done is None else done.unionByName(good)
        if n + 1 < attempts:
            if bad.isEmpty():
                break
            todo = todo.join(bad.select(F.col("key").alias(KEY)), KEY, "left_semi")
    if store is not None:
        trail = F.array(*map(F.lit, lineage or [])).cast("array<string>")
        store.append(done.select("*", F.lit(t.name).alias("task"), F.lit(t.version).alias("version"), trail.alias("lineage")))
    return done, bad


def submit(
    t: Task,
    rows: DataFrame,
    store: Store,
    *,
    use_cache: bool | None = None,
    no_cache: bool = False,
    attempts: int | None = None,
    lineage: list[str] | None = None,
    listing: DataFrame | None = None,
    prefix: str = "",
) -> DataFrame:
    """``rows`` with ``key``, ``value`` (struct of the task's columns), ``error`` and ``from_cache``.

    Equal keys run once. ``use_cache=False`` skips the lookup, ``no_cache`` the write. A failed key runs up to ``attempts``
    times. With a ``listing`` (path, byte_size, hash) of the files that exist, a stored result is a hit only if all files it refers
    to are there unchanged. A lookup that fails counts as one without hits. What is not given comes from ``Settings``. The
    answers replace input columns of their names; ``prefix`` gives them others. Only the driver may submit.
    """
    if TaskContext.get() is not None:
        raise SubmissionError("a task body must not submit")
    spark, settings = rows.sparkSession, Settings.of(rows.sparkSession)
    if KEY in rows.columns:
        raise SubmissionError(f"no column may be named {KEY}")
    rows = rows.withColumn(KEY, t.key(rows.schema))
    distinct = coalesced(rows.select(KEY, *dict.fromkeys(t.columns)), KEY)
    todo, found = distinct, None
    if settings.cache_enabled if use_cache is None else use_cache:
        try:
            known = decoded(store.table(t), t.out).dropDuplicates(["key"])
            found = known.join(distinct.select(F.col(KEY).alias("key")), "key", "left_semi")
            if listing is not None and settings.verify_files:
                found = verified(found, listing, check_content=settings.check_content)
            found = materialize(found, "memo-hits")
        except Exception as e:
            warnings.warn(f"the lookup of {t.name} failed, so everything runs: {e}", stacklevel=2)
            found = None
    if found is not None:
        todo = distinct.join(found.select(F.col("key").alias(KEY)), KEY, "left_anti")
    done, bad = executed(t, todo, None if no_cache else store, settings.resubmit_attempts if attempts is None else attempts, lineage)
    answers = done.unionByName(bad).select("key", F.from_json("result", t.out).alias("value"), "error", F.lit(False).alias("from_cache"))
    if found is not None:
        answers = answers.unionByName(found.select("key", "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache")))
    answers = materialize(answers, "memo-answers").select(F.col("key").alias(KEY), *(F.col(c).alias(f"{prefix}{c}") for c in ("value", "error", "from_cache")))
    names = [f"{prefix}{c}" for c in ("key", "value", "error", "from_cache")]
    own = [c for c in rows.columns if c not in (KEY, *names)]
    return rows.select(KEY, *own).join(answers, KEY, "left").select(*own, F.col(KEY).alias(names[0]), *names[1:])


def audited(rows: DataFrame, *messages: Column, to: str = "logs") -> DataFrame:
    """``rows`` with log records of their own: messages that are not null, stamped with the time of the query."""
    records = [F.struct(m.cast("string").alias("data"), F.current_timestamp().alias("ts")) for m in messages]
    return rows.withColumn(to, F.filter(F.array(*records), lambda r: r["data"].isNotNull()))


def inherit(lineage: str | Column, own: str | Column) -> Column:
    """The ancestors of a child: those of its parent, then the parent."""
    lineage, own = (F.col(x) if isinstance(x, str) else x for x in (lineage, own))
    return F.array_append(lineage, own)


def inherited_priority(base: str | Column, parent: str | Column) -> Column:
    base, parent = (F.col(x) if isinstance(x, str) else x for x in (base, parent))
    return base + parent + 1


def inherited_labels(parent: str | Column, own: str | Column) -> Column:
    return F.concat(parent, own)


@contextmanager
def node_local(key: str, build: Callable[[], Any], release: Callable[[Any], None] | None = None) -> Iterator[Any]:
    """A resource of a worker process: made by the first of its users, given to all others, released after the last one.

    Users that come while it is made wait for it. If making it fails, all who wait get the error, and the next user tries again.
    """
    slots, lock = per_worker("node-local", dict), per_worker("node-local-lock", threading.Lock)
    with lock:
        slot = slots.get(key)
        first = slot is None
        if first:
            slot = slots[key] = {"n": 0, "ready": threading.Event(), "value": None, "error": None}
        slot["n"] += 1
    try:
        if first:
            try:
                slot["value"] = build()
            except BaseException as e:
                slot["error"] = e
                raise
            finally:
                slot["ready"].set()
        slot["ready"].wait()
        if slot["error"] is not None and not first:
            raise SubmissionError(f"{key} could not be made") from slot["error"]
        yield slot["value"]
    finally:
        with lock:
            slot["n"] -= 1
            last = slot["n"] == 0
            if slots.get(key) is slot and (last or slot["error"] is not None):
                del slots[key]
        if last and slot["error"] is None and release is not None:
            release(slot["value"])


def memoized(t: Task, store: Store) -> Callable[[DataFrame], DataFrame]:
    """``rows -> answers`` for a task and a store."""
    return functools.partial(submit, t, store=store)
