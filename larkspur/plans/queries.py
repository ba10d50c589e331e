"""Queries over the input tables, one for each operator of the engine, with equal SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import keys, resources, scalars
from larkspur.functions.resources import Request, Supply
from larkspur.functions.selectors import And, Has, Not, Or, affinity_labels, matches, to_json
from larkspur.operators import memo, metrics, schedule, sets
from larkspur.plans import barrier, recursion
from larkspur.plans.relations import relation, with_relations
from larkspur.sources.shared import new_path, table
from larkspur.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *relations: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_relations(sql, *relations)
        return f

    return register


def text(value: str) -> str:
    """SQL of the canonical text of a value that is a string."""
    return f"CASE WHEN {value} IS NULL THEN '~' ELSE concat(CAST(strlen({value}) AS VARCHAR), ':', {value}) END"


def joined(array: str) -> F.Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


# --- keys and memoization -------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, concat_ws('-', 'price', '1', sha256(concat({text('CAST(o_custkey AS VARCHAR)')}, {text('o_orderpriority')}))) AS key FROM orders")
def memo_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", keys.memo_key("price", 1, "o_custkey", "o_orderpriority").alias("key"))


_SEGMENT = "nullif(c_mktsegment, 'BUILDING')"


@query(f"SELECT c_custkey, sha256(concat({text('CAST(c_nationkey AS VARCHAR)')}, {text(_SEGMENT)})) AS data_hash FROM customer")
def key_of_part_of_input(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf, "customer").select("c_custkey", keys.data_hash("c_nationkey", segment).alias("data_hash"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def memo_hits(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    return memo.hits(memo.coalesced(orders.select("key")), orders.where("o_orderstatus = 'F'"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def memo_misses(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    return memo.misses(memo.coalesced(orders.select("key")), orders.where("o_orderstatus = 'F'"))


def rate_body(rows):
    import pandas as pd

    level = rows["o_orderpriority"].str.slice(0, 1).astype("int64")
    return pd.DataFrame({"rank": level * 100 + rows["o_custkey"] % 10, "urgent": (level <= 2).astype("int64")})


def _rate(columns: list[str] | None = None) -> memo.Task:
    return memo.Task("rate", 1, rate_body, ("o_custkey", "o_orderpriority"), memo.T._parse_datatype_string("rank long, urgent long"), tuple(columns or ()))


_RATED = "100 * CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + o_custkey % 10 AS rank, CASE WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 1 ELSE 0 END::BIGINT AS urgent"


@query(f"SELECT o_orderkey, {_RATED}, false AS from_cache FROM orders")
def memo_project(spark: SparkSession, sf: str) -> DataFrame:
    """A memoized projection on an empty store: everything runs, each key once."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = memo.submit(_rate(), rows, memo.Store(spark, new_path(spark, "store")))
    return out.select("o_orderkey", "value.rank", "value.urgent", "from_cache")


@query(f"SELECT o_orderkey, {_RATED}, o_orderkey % 2 = 0 OR (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0) AS from_cache FROM orders")
def memo_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """The same after half of the orders were submitted before: their keys come from the store."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    store = memo.Store(spark, new_path(spark, "store"))
    memo.submit(_rate(), rows.where("o_orderkey % 2 = 0"), store)
    return memo.submit(_rate(), rows, store).select("o_orderkey", "value.rank", "value.urgent", "from_cache")


@query(f"SELECT concat_ws('-', 'rate', '1', sha256({text('o_orderpriority')})) AS key, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority")
def memo_part_key_runs_once(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ only outside the key columns share one run."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = memo.submit(_rate(["o_orderpriority"]), rows, memo.Store(spark, new_path(spark, "store")))
    return out.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, 1::BIGINT AS runs, count(*) AS submissions FROM events GROUP BY user_id")
def run_once(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"))
    once = memo.coalesced(events).groupBy("key").agg(F.count("*").alias("runs"))
    return once.join(events.groupBy("key").agg(F.count("*").alias("submissions")), "key")


@query("SELECT key, string_agg(DISTINCT CAST(launcher AS VARCHAR), ',' ORDER BY CAST(launcher AS VARCHAR)) AS proxies, count(DISTINCT launcher) AS n FROM queue_events GROUP BY key", "queue_events")
def waiters(spark: SparkSession, sf: str) -> DataFrame:
    events = relation(spark, sf, "queue_events").withColumn("proxy", F.col("launcher").cast("string"))
    return memo.waiters(events).select("key", joined("proxies").alias("proxies"), "n")


@query("SELECT launcher, arg_max(memory, key) AS memory, count(DISTINCT memory) AS n_requests FROM submissions GROUP BY launcher", "submissions")
def newest_request(spark: SparkSession, sf: str) -> DataFrame:
    return memo.newest_request(relation(spark, sf, "submissions"), "launcher", "memory", "key")


@query("SELECT o_orderkey AS proxy, o_custkey AS key, c_acctbal AS result FROM orders JOIN customer ON o_custkey = c_custkey")
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("result"))
    waiting = table(spark, sf, "orders").select(F.col("o_orderkey").alias("proxy"), F.col("o_custkey").alias("key"))
    return memo.fan_out(results, waiting).select("proxy", "key", "result")


@query(
    "SELECT d.doc_id // 2 AS key, bool_and(l.doc_id IS NOT NULL AND (d.doc_id % 2 = 0 OR d.n_chars % 3 = l.quality)) AS valid "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"
)
def verify_on_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Each result refers to two documents; labels list what exists (hash: quality), even ids are mutable."""
    docs = table(spark, sf, "documents")
    file = F.struct(
        F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("long").alias("byte_size"), (F.col("n_chars") % 3).cast("int").alias("hash"), (F.col("doc_id") % 2 == 0).alias("mutable")
    )
    results = docs.groupBy(F.expr("doc_id div 2").alias("key")).agg(F.collect_list(file).alias("files"))
    listing = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("long").alias("byte_size"), F.col("quality").alias("hash"))
    return memo.verify_files(results, listing)


@query("SELECT source, count(*) AS n_wanted, count(l.doc_id) AS n_found, count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def from_file_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").select("source", F.col("doc_id").alias("path"))
    return memo.all_or_run(wanted, table(spark, sf, "labels").select(F.col("doc_id").alias("path")), "source")


@query("SELECT o_orderkey, CAST(o_custkey % 10 + o_orderkey % 5 + 1 AS BIGINT) AS priority FROM orders")
def inherited_priority(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", memo.inherited_priority(F.col("o_custkey") % 10, F.col("o_orderkey") % 5).cast("long").alias("priority"))


@query("SELECT node, array_to_string(list_concat(labels, [concat('own:', CAST(cpu AS VARCHAR))]), ',') AS labels FROM nodes", "nodes")
def inherited_labels(spark: SparkSession, sf: str) -> DataFrame:
    own = F.array(F.concat(F.lit("own:"), F.col("cpu").cast("string")))
    return relation(spark, sf, "nodes").select("node", F.array_join(memo.inherited_labels(F.col("labels"), own), ",").alias("labels"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 < 2 THEN 'hit' ELSE 'run again' END AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) END AS n FROM orders")
def decode_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A stored result that does not decode under the schema of today is a miss; one without a field that may be missing is a hit."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    result = F.when(key % 4 == 0, F.concat(F.lit('{"n":'), F.col("o_custkey").cast("string"), F.lit("}"))).when(key % 4 == 1, "{}").when(key % 4 == 2, '{"n":"many"}').otherwise("no json")
    found = memo.decoded(orders.select(key.alias("key"), result.alias("result")), memo.T._parse_datatype_string("n long"))
    outcome = F.when(F.col("value").isNull(), "run again").otherwise("hit")
    return orders.select(key.alias("key")).join(found, "key", "left").select("key", outcome.alias("outcome"), F.col("value.n").cast("string").alias("n"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey")


def file_body(rows):
    import pandas as pd

    return pd.DataFrame({"f": [{"path": f"f/{c}", "byte_size": c % 1000, "hash": c % 7, "mutable": c % 11 == 0} for c in rows["c_custkey"].tolist()]})


@query("SELECT c_custkey, c_custkey % 3 = 2 OR (c_custkey % 11 = 0 AND c_custkey % 3 = 1) AS from_cache FROM customer")
def verified_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A second run, when of the files that results refer to some are gone (0 of 3), some changed (1 of 3): those that are not all there run again."""
    rows, c = _customers(spark, sf), F.col("c_custkey")
    t = memo.Task("file", 1, file_body, ("c_custkey",), memo.T._parse_datatype_string("f struct<path string, byte_size long, hash long, mutable boolean>"))
    store = memo.Store(spark, new_path(spark, "store"))
    memo.submit(t, rows, store)
    listing = rows.where(c % 3 > 0).select(F.concat(F.lit("f/"), c.cast("string")).alias("path"), (c % 1000).alias("byte_size"), (c % 7 + F.when(c % 3 == 1, 1).otherwise(0)).alias("hash"))
    return memo.submit(t, rows, store, listing=listing).select("c_custkey", "from_cache")


def strict_body(rows):
    import pandas as pd

    bad = rows["o_custkey"][rows["o_custkey"] % 10 == 3]
    if len(bad):
        raise ValueError(f"no customer {bad.iloc[0]}")
    return pd.DataFrame({"n": rows["o_custkey"] * 2})


def _strict() -> memo.Task:
    return memo.Task("strict", 1, strict_body, ("o_custkey",), memo.T._parse_datatype_string("n long"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN concat('ValueError: no customer ', CAST(o_custkey AS VARCHAR)) END AS error, CASE WHEN o_custkey % 10 <> 3 THEN CAST(o_custkey * 2 AS VARCHAR) END AS n FROM orders")
def failing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A failure reaches the rows of its key and no others."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return memo.submit(_strict(), rows, memo.Store(spark, new_path(spark, "store"))).select("o_orderkey", "error", F.col("value.n").cast("string").alias("n"))


@query("SELECT CASE WHEN o_custkey % 10 = 3 THEN 'failed' WHEN o_custkey % 2 = 0 THEN 'cache_hit' ELSE 'completed' END AS outcome, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def outcome_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the keys of a run after an earlier one: completed, failed, or known from before."""
    rows, store = table(spark, sf, "orders").select("o_custkey"), memo.Store(spark, new_path(spark, "store"))
    memo.submit(_strict(), rows.where("o_custkey % 2 = 0"), store)
    return metrics.outcomes(memo.submit(_strict(), rows, store))


@query("SELECT DISTINCT o_orderpriority, false AS from_cache, 0::BIGINT AS stored FROM orders")
def no_cache_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Work that is not to be kept runs again each time."""
    rows, store = table(spark, sf, "orders").select("o_custkey", "o_orderpriority"), memo.Store(spark, new_path(spark, "store"))
    t = _rate(["o_orderpriority"])
    memo.submit(t, rows, store, no_cache=True)
    again = memo.submit(t, rows, store, no_cache=True).select("o_orderpriority", "from_cache").distinct()
    return again.withColumn("stored", F.lit(store.table(t).count()))


def lines_body(rows):
    import pandas as pd

    from larkspur.sources import files

    read = [[int(x) for x in files.read(root, f["path"]).split()] for root, f in zip(rows["root"], rows["f"], strict=True)]
    return pd.DataFrame({"n": [len(x) for x in read], "total": [sum(x) * by for x, by in zip(read, rows["times"].tolist(), strict=True)]})


@query("SELECT CAST(doc_id // 64 AS BIGINT) AS folder, times, count(*) AS n, CAST(sum(doc_id) * times AS BIGINT) AS total FROM documents, (VALUES (1::BIGINT), (3::BIGINT)) t(times) GROUP BY doc_id // 64, times")
def files_in_input(spark: SparkSession, sf: str) -> DataFrame:
    """Files written by executors are, with a number, the inputs of submissions that read them."""
    from larkspur.sources.blobs import BlobStore

    store = BlobStore(spark, new_path(spark, "blobs"), prefix=("ids",))
    docs = table(spark, sf, "documents").select(F.expr("doc_id div 64").alias("folder"), F.col("doc_id").cast("string").alias("id"))
    handles = store.sink(docs.groupBy("folder").agg(F.array_join(F.collect_list("id"), "\n").alias("content")).select(F.col("folder").cast("string").alias("name"), "content"))
    numbers = F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("times")
    rows = handles.select(F.substring_index("path", "/", -1).cast("long").alias("folder"), F.struct("path", "byte_size", "hash").alias("f"), numbers).withColumn("root", F.lit(store.root))
    t = memo.Task("lines", 1, lines_body, ("f", "times", "root"), memo.T._parse_datatype_string("n long, total long"), ("f", "times"))
    return memo.submit(t, rows, memo.Store(spark, new_path(spark, "store"))).select("folder", "times", "value.n", "value.total")


@query(
    "SELECT concat('s/', CAST(s_suppkey AS VARCHAR)) AS path, CAST(strlen(s_name) AS BIGINT) AS byte_size, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM "
    "(SELECT s_suppkey, s_name, CAST(concat('0x', substr(md5(s_name), 1, 8)) AS BIGINT) AS h FROM supplier)"
)
def executor_files(spark: SparkSession, sf: str) -> DataFrame:
    """Handles of a file for each row, as a listing of the folder finds them."""
    from larkspur.sources.blobs import BlobStore

    store = BlobStore(spark, new_path(spark, "blobs"))
    store.scoped("s").sink(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("content")))
    return store.listing()


# --- composition ----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def scatter_gather(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_returnflag", F.floor("l_quantity").cast("long").alias("q"))
    return items.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


def fib_body(rows):
    import pandas as pd

    return pd.DataFrame({"fib": [n if n < 2 else sum(x["value"]["fib"] for x in inputs) for n, inputs in zip(rows["n"].tolist(), rows["inputs"], strict=True)]})


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 16) SELECT n, a AS fib FROM f")
def recursion_fib(spark: SparkSession, sf: str) -> DataFrame:
    """fib(16) as a recursion of submissions: every subproblem runs once, when what it needs is known."""
    t = memo.Task("fib", 1, fib_body, ("n", "inputs"), memo.T._parse_datatype_string("fib long"), ("n",))
    needs = lambda f: f.where("n >= 2").select("n", F.explode(F.array(F.col("n") - 1, F.col("n") - 2)).alias("need"))
    out = recursion.evaluate(t, spark.range(16, 17).select(F.col("id").cast("int").alias("n")), needs, memo.Store(spark, new_path(spark, "store")))
    return out.select("n", "value.fib")


@query("SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN n = 16 THEN 0 ELSE ceil((16 - n) / 2.0) END AS INTEGER) AS level FROM range(17) t(n)")
def recursion_subproblems(spark: SparkSession, sf: str) -> DataFrame:
    """Every subproblem of fib(16), found once each."""
    return recursion.solve(spark.range(16, 17).toDF("n"), lambda f: f.where("n >= 2").select(F.explode(F.array(F.col("n") - 1, F.col("n") - 2)).alias("n")))


@query(
    "WITH RECURSIVE up(child, parent, depth) AS (SELECT o_orderkey, o_orderkey // 2, 1 FROM orders WHERE o_orderkey > 1 "
    "UNION ALL SELECT child, parent // 2, depth + 1 FROM up WHERE parent > 1 AND parent IN (SELECT o_orderkey FROM orders)) SELECT child, parent, depth FROM up"
)
def lineage_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "orders").where("o_orderkey > 1").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent"))
    return recursion.closure(edges)


@query("SELECT launcher, array_to_string(list(payload ORDER BY rank), ',') AS peers FROM (SELECT DISTINCT user_id AS launcher, event_id % 4 AS rank, concat('host-', CAST(event_id % 4 AS VARCHAR), ':1000') AS payload FROM events) GROUP BY launcher HAVING count(*) = 4")
def rendezvous_peers(spark: SparkSession, sf: str) -> DataFrame:
    joins = table(spark, sf, "events").select(
        F.col("user_id").alias("group"), (F.col("event_id") % 4).alias("rank"), F.lit(4).alias("world_size"), F.concat(F.lit("host-"), (F.col("event_id") % 4).cast("string"), F.lit(":1000")).alias("payload")
    )
    return barrier.gathered(joins).select(F.col("group").alias("launcher"), joined("peers").alias("peers"))


@query(
    "WITH j AS (SELECT user_id AS g, event_id % 5 AS rank, CASE WHEN user_id % 3 = 0 THEN 5 WHEN user_id % 3 = 1 THEN 4 ELSE 4 + event_id % 2 END AS w, CASE WHEN user_id % 6 = 0 THEN event_type ELSE 'p' END AS payload FROM events), "
    "c AS (SELECT g, min(w) AS low, max(w) AS high, max(rank) AS last FROM j GROUP BY g), "
    "t AS (SELECT g, min(rank) AS rank FROM (SELECT g, rank FROM j GROUP BY g, rank HAVING count(DISTINCT payload) > 1) GROUP BY g) "
    "SELECT g AS \"group\", CASE WHEN low <> high THEN 'worldSize mismatch' WHEN last >= low THEN 'rank out of range' ELSE concat('duplicate rank ', CAST(t.rank AS VARCHAR), ' in group ', CAST(g AS VARCHAR)) END AS reason "
    "FROM c LEFT JOIN t USING (g) WHERE low <> high OR last >= low OR t.rank IS NOT NULL"
)
def rendezvous_invalid(spark: SparkSession, sf: str) -> DataFrame:
    g, e = F.col("user_id"), F.col("event_id")
    size = F.when(g % 3 == 0, 5).when(g % 3 == 1, 4).otherwise((4 + e % 2).cast("int"))
    joins = table(spark, sf, "events").select(g.alias("group"), (e % 5).alias("rank"), size.alias("world_size"), F.when(g % 6 == 0, F.col("event_type")).otherwise("p").alias("payload"))
    return barrier.invalid(joins)


@query("SELECT CAST(r AS INTEGER) AS rank, 'host-0:1000,host-1:1000,host-2:1000,host-3:1000' AS peers FROM range(4) t(r)")
def rendezvous_barrier(spark: SparkSession, sf: str) -> DataFrame:
    """A barrier stage of four ranks, which need a slot each."""
    n = 4
    peers = barrier.all_gather(spark, [f"host-{r}:1000" for r in range(n)])
    return spark.createDataFrame([(r, ",".join(p)) for r, p in enumerate(peers)], "rank int, peers string")


def plus_body(rows):
    import pandas as pd

    return pd.DataFrame({"q": rows["q"] + rows["by"]})


def _plus(rows: DataFrame, by: int, store: memo.Store) -> DataFrame:
    """``rows`` with q larger by ``by``: a submission of each different q."""
    t = memo.Task("plus", 1, plus_body, ("q", "by"), memo.T._parse_datatype_string("q long"))
    out = memo.submit(t, rows.withColumn("by", F.lit(by)), store)
    return out.select(*(c for c in rows.columns if c != "q"), "value.q")


@query("SELECT l_orderkey, CAST(sum(q) + count(*) * 2 AS BIGINT) AS total FROM (SELECT l_orderkey, CAST(floor(l_quantity) AS BIGINT) + 1 AS q FROM lineitem) GROUP BY l_orderkey")
def chain(spark: SparkSession, sf: str) -> DataFrame:
    """The results of one submission are the inputs of the next."""
    store = memo.Store(spark, new_path(spark, "store"))
    one = _plus(table(spark, sf, "lineitem").select("l_orderkey", F.floor("l_quantity").cast("long").alias("q")), 1, store)
    return _plus(one, 2, store).groupBy("l_orderkey").agg(F.sum("q").alias("total"))


@query("SELECT (SELECT CAST(sum(o_custkey + 7) AS BIGINT) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT CAST(sum(l_linenumber + 5) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R') AS b")
def fork_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two branches of submissions that are independent of each other, and both their results."""
    store = memo.Store(spark, new_path(spark, "store"))
    a = _plus(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("long").alias("q")), 7, store)
    b = _plus(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_linenumber").cast("long").alias("q")), 5, store)
    both = a.select(F.col("q").alias("a"), F.lit(None).cast("long").alias("b")).union(b.select(F.lit(None).cast("long"), "q"))
    return both.agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@query(f"SELECT doc_id, concat_ws('/', 'run', sha256(concat({text('CAST(doc_id AS VARCHAR)')}, {text('source')})), lang) AS path FROM documents")
def scoped_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of its own for each input."""
    from larkspur.sources.blobs import scoped_path

    return table(spark, sf, "documents").select("doc_id", scoped_path(("run",), keys.data_hash("doc_id", "source"), "lang").alias("path"))


@query("SELECT key, array_to_string([key // 4, key // 2, key], ',') AS lineage FROM submissions", "submissions")
def lineage_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    submissions = relation(spark, sf, "submissions").select("key", F.expr("array(key div 4, key div 2)").alias("lineage"))
    return submissions.select("key", F.array_join(memo.inherit("lineage", "key").cast("array<string>"), ",").alias("lineage"))


@query("SELECT key, CASE WHEN gpu > 0 THEN 1 ELSE 0 END + CASE WHEN image IS NOT NULL THEN 1 ELSE 0 END AS n_logs FROM submissions", "submissions")
def audit_logs(spark: SparkSession, sf: str) -> DataFrame:
    rows = memo.audited(relation(spark, sf, "submissions"), F.when(F.col("gpu") > 0, "takes a gpu"), F.col("image"))
    return rows.select("key", F.size("logs").alias("n_logs"))


# --- predicates and scalars -----------------------------------------------------------------------------------------

_MIX = And((Has("spot"), Not(Has("gpu:a100"))))


@query("SELECT node, list_contains(labels, 'gpu:a100') AS has, NOT list_contains(labels, 'spot') AS has_not, list_contains(labels, 'spot') AND NOT list_contains(labels, 'gpu:a100') AS both, list_contains(labels, 'on-demand') OR list_contains(labels, 'gpu:a100') AS either, true AS empty_and, false AS empty_or, true AS nothing FROM nodes", "nodes")
def selectors(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "nodes").select(
        "node",
        matches(Has("gpu:a100")).alias("has"),
        matches(Not(Has("spot"))).alias("has_not"),
        matches(_MIX).alias("both"),
        matches(Or((Has("on-demand"), Has("gpu:a100")))).alias("either"),
        matches(And()).alias("empty_and"),
        matches(Or()).alias("empty_or"),
        matches(None).alias("nothing"),
    )


_FIT = "n.cpu >= t.min_cpu AND n.memory >= t.memory AND n.scratch >= t.scratch AND len(n.gpu) >= t.gpu AND (t.image IS NULL OR coalesce(t.image = n.image, false))"


@query(f"SELECT t.min_cpu, t.memory, t.scratch, t.gpu, t.image, t.n_tasks, n.node FROM (SELECT min_cpu, memory, scratch, gpu, image, count(*) AS n_tasks FROM submissions GROUP BY ALL) t JOIN nodes n ON {_FIT} AND list_contains(n.labels, 'spot')", "submissions", "nodes")
def can_fulfill_request(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.fits(relation(spark, sf, "submissions"), relation(spark, sf, "nodes"), matches(Has("spot"), "node_labels"))


@query("SELECT node, cpu >= 6 AND memory >= 3000 AND scratch >= 1000 AND list_contains(gpu, 0) AS holds FROM nodes", "nodes")
def can_fulfill_allocated(spark: SparkSession, sf: str) -> DataFrame:
    grant = Supply(F.lit(6), F.lit(3000), F.lit(1000), F.array(F.lit(0)), F.lit(None).cast("string"))
    return relation(spark, sf, "nodes").select("node", resources.can_hold(Supply.of(), grant).alias("holds"))


@query(f"SELECT t.code_version, n.node, count(*) AS n FROM submissions t JOIN nodes n ON t.code_version = (CASE WHEN n.node % 2 = 0 THEN 'v0' ELSE 'v1' END) AND t.launcher = n.node AND {_FIT} GROUP BY ALL", "submissions", "nodes")
def same_code_version(spark: SparkSession, sf: str) -> DataFrame:
    """Work goes only to nodes of the same code version."""
    nodes = relation(spark, sf, "nodes").select(F.col("node").alias("launcher"), *(F.col(c).alias(f"n_{c}") for c in ("cpu", "memory", "scratch", "gpu", "image")))
    version = F.when(F.col("launcher") % 2 == 0, "v0").otherwise("v1")
    both = relation(spark, sf, "submissions").join(nodes, "launcher").where((F.col("code_version") == version) & resources.can_fulfill(Supply.of("n_"), Request.of()))
    return both.groupBy("code_version", F.col("launcher").alias("node")).agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    nodes = relation(spark, sf, "nodes").select(F.col("node").alias("launcher"), *(F.col(c).alias(f"n_{c}") for c in ("cpu", "memory", "scratch", "gpu", "image")))
    return relation(spark, sf, "submissions").join(nodes, "launcher")


def _flat(s: Supply) -> list[F.Column]:
    return [s.cpu.cast("long").alias("cpu"), s.memory.cast("long").alias("memory"), s.scratch.cast("long").alias("scratch"), F.array_join(s.gpu.cast("array<string>"), ",").alias("gpu"), s.image.alias("image")]


_PAIRS = "FROM submissions t JOIN nodes n ON t.launcher = n.node"


def _gpu(list_sql: str) -> str:
    return f"coalesce(array_to_string({list_sql}, ','), '') AS gpu"


@query(f"SELECT t.key, CAST(greatest(n.cpu - t.max_cpu, 0) AS BIGINT) AS cpu, CAST(n.memory - t.memory AS BIGINT) AS memory, CAST(n.scratch - t.scratch AS BIGINT) AS scratch, {_gpu('n.gpu[t.gpu + 1:]')}, n.image {_PAIRS}", "submissions", "nodes")
def subtract_request(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("key", *_flat(resources.subtract_request(Supply.of("n_"), Request.of())))


@query(f"SELECT t.key, CAST(n.cpu - t.min_cpu AS BIGINT) AS cpu, CAST(n.memory - t.memory AS BIGINT) AS memory, CAST(n.scratch - t.scratch AS BIGINT) AS scratch, {_gpu('list_filter(n.gpu, lambda x: x <> 0)')}, n.image {_PAIRS}", "submissions", "nodes")
def subtract_allocated(spark: SparkSession, sf: str) -> DataFrame:
    grant = Supply(F.col("min_cpu"), F.col("memory"), F.col("scratch"), F.array(F.lit(0)), F.lit(None).cast("string"))
    return _pairs(spark, sf).select("key", *_flat(resources.subtract(Supply.of("n_"), grant)))


@query(f"SELECT t.key, CAST(n.cpu + t.min_cpu AS BIGINT) AS cpu, CAST(n.memory + t.memory AS BIGINT) AS memory, CAST(n.scratch + t.scratch AS BIGINT) AS scratch, {_gpu('list_sort(list_concat(n.gpu, [7, 9]))')}, n.image {_PAIRS}", "submissions", "nodes")
def add_back(spark: SparkSession, sf: str) -> DataFrame:
    grant = Supply(F.col("min_cpu"), F.col("memory"), F.col("scratch"), F.array(F.lit(7), F.lit(9)), F.lit(None).cast("string"))
    return _pairs(spark, sf).select("key", *_flat(resources.add_back(Supply.of("n_"), grant)))


@query(f"SELECT t.key, CAST(least(n.cpu, t.max_cpu) AS BIGINT) AS cpu, CAST(t.memory AS BIGINT) AS memory, CAST(t.scratch AS BIGINT) AS scratch, {_gpu('n.gpu[1:t.gpu]')}, CASE WHEN t.image = n.image THEN t.image END AS image {_PAIRS}", "submissions", "nodes")
def maximum_grant(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("key", *_flat(resources.maximum_grant(Supply.of("n_"), Request.of())))


@query(f"SELECT t.key, CAST(t.min_cpu AS BIGINT) AS cpu, CAST(t.memory AS BIGINT) AS memory, CAST(t.scratch AS BIGINT) AS scratch, {_gpu('n.gpu[1:t.gpu]')}, t.image {_PAIRS}", "submissions", "nodes")
def minimum_grant(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("key", *_flat(resources.minimum_grant(Supply.of("n_"), Request.of())))


@query("SELECT node, CAST(0 AS BIGINT) AS cpu, CAST(0 AS BIGINT) AS memory, CAST(0 AS BIGINT) AS scratch, '' AS gpu, image FROM nodes", "nodes")
def subtract_all(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "nodes").select("node", *_flat(resources.subtract_all(Supply.of())))


@query("SELECT key, CAST(greatest(min_cpu, 4) AS BIGINT) AS min_cpu, CAST(greatest(max_cpu, min_cpu, 4) AS BIGINT) AS max_cpu, CAST(greatest(memory, 2000) AS BIGINT) AS memory FROM submissions", "submissions")
def clamp_to_minimums(spark: SparkSession, sf: str) -> DataFrame:
    r = resources.clamp(Request.of(), 4, 2000)
    return relation(spark, sf, "submissions").select("key", r.min_cpu.cast("long").alias("min_cpu"), r.max_cpu.cast("long").alias("max_cpu"), r.memory.cast("long").alias("memory"))


@query("SELECT node, list_sort(list_distinct(gpu)) = gpu AS valid, false AS reversed_valid FROM nodes WHERE len(gpu) > 1", "nodes")
def valid_gpus(spark: SparkSession, sf: str) -> DataFrame:
    nodes = relation(spark, sf, "nodes").where("size(gpu) > 1")
    return nodes.select("node", resources.valid_gpus("gpu").alias("valid"), resources.valid_gpus(F.reverse("gpu")).alias("reversed_valid"))


@query(
    "SELECT doc_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash, sha256(text) AS full_hash FROM "
    "(SELECT doc_id, text, CAST(concat('0x', substr(md5(text), 1, 8)) AS BIGINT) AS h FROM documents)"
)
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", scalars.content_hash("text").alias("hash"), scalars.full_content_hash("text").alias("full_hash"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN concat('s', CAST(page_id AS VARCHAR)) ELSE NULL END AS session FROM pages")
def session_of(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    proxy = F.when(p % 3 == 0, F.concat(F.lit("Launcher-"), p.cast("string"))).when(p % 3 == 1, F.concat(F.lit("s"), p.cast("string"), F.lit("~a~b"))).otherwise(F.concat(F.lit("~"), p.cast("string")))
    return table(spark, sf, "pages").select("page_id", scalars.session_of(proxy).alias("session"))


@query(
    "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, "
    "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1] AS name, 'file' AS no_scheme FROM pages"
)
def uri_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = scalars.uri_path("url")
    return table(spark, sf, "pages").select(
        "page_id", scalars.uri_scheme("url").alias("scheme"), scalars.uri_authority("url").alias("authority"), path.alias("path"), scalars.file_name(path).alias("name"), scalars.uri_scheme(path).alias("no_scheme")
    )


@query("SELECT page_id, concat_ws('-', sha256(CAST(page_id AS VARCHAR)), substr(regexp_replace(url, '[^\\p{L}\\p{Nd}._-]', '_', 'g'), 1, 80)) AS name FROM pages")
def cache_file_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", scalars.cache_file_name(F.col("page_id").cast("string"), "url").alias("name"))


@query(
    "SELECT page_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT page_id, "
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5(url), ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 31 + x) & 4294967295) AS h FROM pages)"
)
def etag_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", scalars.etag_hash(F.md5("url")).alias("hash"))


@query("SELECT part, CAST(least(5242880.0 * pow(2, least((part - 1) // 800, 40)), 1900000000.0) AS BIGINT) AS size FROM (SELECT DISTINCT CAST(1 + o_orderkey % 10000 AS BIGINT) AS part FROM orders)")
def upload_part_size(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "orders").select((1 + F.col("o_orderkey") % 10000).cast("long").alias("part")).distinct()
    return parts.select("part", scalars.part_size("part", 5 << 20).alias("size"))


@query("SELECT node, concat_ws(',', concat('a=', CAST(cpu - memory AS VARCHAR)), concat('b=', CAST(cpu AS VARCHAR)), concat('c=', CAST(memory AS VARCHAR))) AS merged FROM nodes", "nodes")
def merge_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Values of keys in both maps are combined, those of one are kept."""
    left = F.create_map(F.lit("a"), F.col("cpu"), F.lit("b"), F.col("cpu"))
    right = F.create_map(F.lit("a"), F.col("memory"), F.lit("c"), F.col("memory"))
    m = scalars.merge_maps(left, right, lambda a, b: a - b)
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return relation(spark, sf, "nodes").select("node", F.array_join(entries, ",").alias("merged"))


@query("SELECT node, array_to_string(list_sort(list_distinct(list_concat(labels, ['zone:a', 'spot']))), ',') AS labels, array_to_string(list_sort(list_distinct(list_concat(gpu, [3, 1]))), ',') AS gpu FROM nodes", "nodes")
def configured_sets(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "nodes").select(
        "node", F.array_join(F.array_sort(scalars.label_set("labels", F.lit(" zone:a, spot,,"))), ",").alias("labels"), F.array_join(scalars.gpu_ids("gpu", F.lit("3, 1,3")).cast("array<string>"), ",").alias("gpu")
    )


@query("SELECT doc_id, CAST(4 + octet_length(encode(text)) + 28 * ceil(octet_length(encode(text)) / 100.0) AS BIGINT) AS coded_bytes, md5(text) AS fingerprint FROM documents")
def encrypted_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """AES-256-GCM in chunks, as in the files of an encrypted store, and back; only equal texts have the fingerprint of the original."""
    from larkspur.sources.blobs import decrypted, encrypted

    key = "00112233445566778899aabbccddeeff" * 2
    coded = F.aggregate(encrypted("text", key, 100), F.lit(b""), lambda a, x: F.concat(a, x))
    rows = table(spark, sf, "documents").select("doc_id", coded.alias("coded"))
    return rows.select("doc_id", F.octet_length("coded").cast("long").alias("coded_bytes"), F.md5(decrypted("coded", key)).alias("fingerprint"))


@query("SELECT page_id, to_base64(encode(url)) AS coded, url AS decoded FROM pages")
def base64_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    coded = scalars.base64("url")
    return table(spark, sf, "pages").select("page_id", coded.alias("coded"), F.unbase64(coded).cast("string").alias("decoded"))


# --- joins and scheduling -------------------------------------------------------------------------------------------


@query("SELECT node, CAST(cpu - coalesce(used_cpu, 0) AS BIGINT) AS free_cpu, CAST(memory - coalesce(used_memory, 0) AS BIGINT) AS free_memory FROM nodes LEFT JOIN (SELECT launcher % 40 AS node, sum(min_cpu) AS used_cpu, sum(memory) AS used_memory FROM submissions WHERE state = 'scheduled' AND launcher < 40 GROUP BY launcher % 40) USING (node)", "submissions", "nodes")
def free_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Launchers from 40 on have no node; their submissions deduct nothing."""
    submissions = relation(spark, sf, "submissions").where("state = 'scheduled'").select("launcher", F.col("min_cpu").alias("cpu"), "memory")
    launchers = spark.range(50).select(F.col("id").alias("launcher"), F.when(F.col("id") < 40, F.col("id")).alias("node"))
    free = schedule.free_capacity(relation(spark, sf, "nodes"), launchers, submissions)
    return free.select("node", F.col("free_cpu").cast("long").alias("free_cpu"), F.col("free_memory").cast("long").alias("free_memory"))


@query("SELECT key FROM submissions WHERE state = 'queued' AND key NOT IN (SELECT key // 2 FROM submissions WHERE state IN ('queued', 'scheduled') UNION ALL SELECT key // 4 FROM submissions WHERE state IN ('queued', 'scheduled'))", "submissions")
def blocked_by_descendant(spark: SparkSession, sf: str) -> DataFrame:
    """Queued submissions without a queued or scheduled descendant."""
    submissions = relation(spark, sf, "submissions").select("key", "state", F.expr("array(key div 2, key div 4)").alias("lineage"))
    return schedule.not_blocked(submissions.where("state = 'queued'"), submissions.where("state = 'scheduled'")).select("key")


@query("SELECT node, arg_min(member, position) AS owner FROM (SELECT node, unnest(range(3)) AS position FROM nodes) JOIN (SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) m(member, position)) USING (position) WHERE (node + position) % 3 < 2 GROUP BY node", "nodes")
def owner_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first member of a composite that claims a node."""
    member = F.explode(F.array(*(F.struct(F.lit(m).alias("owner"), F.lit(i).alias("position")) for i, m in enumerate("abc"))))
    claims = relation(spark, sf, "nodes").select("node", member.alias("m")).select("node", "m.*").where("(node + position) % 3 < 2")
    return schedule.first_match(claims, "node", "position").select("node", "owner")


@query("SELECT key FROM submissions WHERE state = 'queued' AND min_cpu <= 6 AND memory <= 3000 AND scratch <= 300 AND gpu <= 1 AND coalesce(image = 'img-a', true) AND code_version = 'v1' ORDER BY priority DESC, depth DESC, key LIMIT 1", "submissions")
def ask_for_work(spark: SparkSession, sf: str) -> DataFrame:
    supply = Supply(F.lit(6), F.lit(3000), F.lit(300), F.array(F.lit(0)), F.lit("img-a"))
    return schedule.ask_for_work(relation(spark, sf, "submissions").where("state = 'queued'"), supply, "v1").select("key")


_SHAPE = ["min_cpu", "memory", "gpu"]


@query("SELECT w.min_cpu, w.memory, w.gpu, w.n - coalesce(g.n, 0) AS n FROM (SELECT min_cpu, memory, gpu, count(*) AS n FROM submissions WHERE state = 'queued' GROUP BY ALL) w LEFT JOIN (SELECT min_cpu, memory, gpu, count(*) AS n FROM submissions WHERE state = 'scheduled' GROUP BY ALL) g USING (min_cpu, memory, gpu) WHERE w.n > coalesce(g.n, 0)", "submissions")
def unmet_demand(spark: SparkSession, sf: str) -> DataFrame:
    submissions = relation(spark, sf, "submissions")
    return schedule.unmet_demand(submissions.where("state = 'queued'"), submissions.where("state = 'scheduled'"), _SHAPE)


@query("SELECT pool, allowed FROM (VALUES (0, 3), (1, 0), (2, 2), (3, 0)) t(pool, allowed)")
def scale_out_caps(spark: SparkSession, sf: str) -> DataFrame:
    """(max nodes, cumulative, pending; active, pending, cumulative) of four pools and what they may request."""
    cases = [(5, 10, 5, 2, 1, 4), (5, 10, 1, 2, 1, 4), (9, 10, 9, 2, 1, 8), (2, 10, 5, 4, 0, 4)]
    return spark.createDataFrame([(i, schedule.allowed_nodes(*c)) for i, c in enumerate(cases)], "pool int, allowed int")


@query("SELECT min_cpu, memory, gpu, 1::BIGINT AS n FROM submissions WHERE state = 'queued' ORDER BY priority DESC, key LIMIT 1", "submissions")
def cold_start(spark: SparkSession, sf: str) -> DataFrame:
    """Work is queued, nothing is planned and no worker is known."""
    queued = relation(spark, sf, "submissions").where("state = 'queued'")
    plan = schedule.unmet_demand(queued, queued, _SHAPE)
    return schedule.cold_start(queued, plan, relation(spark, sf, "nodes").where("state = 'gone'"))


@query(
    "WITH u AS (SELECT launcher AS node, sum(min_cpu) AS c, sum(memory) AS m, sum(scratch) AS s, max(gpu) AS g FROM submissions WHERE state = 'scheduled' AND launcher < 40 GROUP BY launcher) "
    "SELECT node, CAST(cpu - coalesce(c, 0) AS BIGINT) AS cpu, CAST(memory - coalesce(m, 0) AS BIGINT) AS memory, CAST(scratch - coalesce(s, 0) AS BIGINT) AS scratch, "
    "coalesce(array_to_string(list_filter(gpu, lambda x: x >= coalesce(g, 0)), ','), '') AS gpu FROM nodes LEFT JOIN u USING (node)",
    "submissions",
    "nodes",
)
def free_supply(spark: SparkSession, sf: str) -> DataFrame:
    """What nodes have left of all resources; a submission with n gpus holds the first n."""
    gpu = F.when(F.col("gpu") > 0, F.sequence(F.lit(0), F.col("gpu") - 1)).otherwise(F.array().cast("array<int>"))
    held = relation(spark, sf, "submissions").where("state = 'scheduled'").select("launcher", F.col("min_cpu").alias("cpu"), "memory", "scratch", gpu.alias("gpu"))
    launchers = spark.range(50).select(F.col("id").alias("launcher"), F.when(F.col("id") < 40, F.col("id")).alias("node"))
    return schedule.free_supply(relation(spark, sf, "nodes"), launchers, held).withColumn("gpu", joined("gpu"))


@query("SELECT node, CASE WHEN node % 4 >= 3 THEN 0 ELSE greatest(0, least(cpu - node % 7, 6 - memory // 1000)) END::BIGINT AS allowed FROM nodes", "nodes")
def scale_out_gate(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes may be requested, for caps and counts that differ by row."""
    allowed = schedule.may_request("cpu", F.lit(6), F.lit(3), F.col("node") % 7, F.col("node") % 4, F.expr("memory div 1000"))
    return relation(spark, sf, "nodes").select("node", allowed.cast("long").alias("allowed"))


@query("WITH p AS (SELECT min_cpu, memory, gpu, count(*) AS n FROM submissions WHERE state = 'queued' GROUP BY ALL), g AS (SELECT min_cpu, memory, gpu, count(*) AS k FROM submissions WHERE state <> 'queued' AND priority < 7 GROUP BY ALL) SELECT min_cpu, memory, gpu, n - coalesce(k, 0) AS n FROM p LEFT JOIN g USING (min_cpu, memory, gpu) WHERE n > coalesce(k, 0)", "submissions")
def needed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A plan by shape, less the requests of each shape that are under way."""
    rows = relation(spark, sf, "submissions")
    plan = rows.where("state = 'queued'").groupBy(*_SHAPE).agg(F.count("*").alias("n"))
    return schedule.still_needed(plan, rows.where("state <> 'queued' and priority < 7"), _SHAPE)


@query(
    "WITH a AS (SELECT node AS ask, m AS member, i AS position, (node + i) % 4 < 2 AS accepts, CASE WHEN (node // 2 + i) % 3 > 0 THEN concat('no room for ', CAST(node AS VARCHAR)) END AS error FROM nodes, (VALUES ('x', 0), ('y', 1), ('z', 2)) t(m, i)), "
    "g AS (SELECT ask, arg_min(member, position) FILTER (WHERE accepts AND error IS NULL) AS member, string_agg(concat(member, ': ', error), '; ' ORDER BY position) FILTER (WHERE accepts) AS tried FROM a GROUP BY ask) "
    "SELECT ask, member, CASE WHEN member IS NULL THEN coalesce(tried, 'no member accepts the request') END AS error FROM g",
    "nodes",
)
def composite_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a composite asked in order; the errors of all where none makes a node."""
    member = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.lit(i).alias("position")) for i, m in enumerate("xyz"))))
    rows = relation(spark, sf, "nodes").select(F.col("node").alias("ask"), member.alias("m")).select("ask", "m.*")
    error = F.when(F.expr("(ask div 2 + position) % 3 > 0"), F.concat(F.lit("no room for "), F.col("ask").cast("string")))
    return schedule.first_success(rows.select("*", F.expr("(ask + position) % 4 < 2").alias("accepts"), error.alias("error")))


#: The placement as a recursion over the requests of each pool, in the order that {order} gives.
_PACKING = """
WITH RECURSIVE t AS (SELECT launcher % 5 AS pool, key AS task, min_cpu, max_cpu, memory, scratch, gpu,
    row_number() OVER (PARTITION BY launcher % 5 ORDER BY gpu DESC, min_cpu DESC, memory DESC, scratch DESC, {order}) AS r FROM submissions WHERE state = 'queued'),
f(pool, r, task, node, free) AS (
  SELECT node % 5, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, list({{'gpu': CAST(len(gpu) AS BIGINT), 'cpu': CAST(cpu AS BIGINT), 'memory': CAST(memory AS BIGINT), 'scratch': CAST(scratch AS BIGINT), 'node': CAST(node AS BIGINT)}}) FROM nodes GROUP BY node % 5
  UNION ALL
  SELECT pool, r, task, best.node, list_transform(free, lambda x: CASE WHEN x.node = best.node THEN
      {{'gpu': CAST(x.gpu - gpu AS BIGINT), 'cpu': CAST(greatest(0, x.cpu - max_cpu) AS BIGINT), 'memory': CAST(x.memory - memory AS BIGINT), 'scratch': CAST(x.scratch - scratch AS BIGINT), 'node': x.node}} ELSE x END)
  FROM (SELECT t.*, f.free, list_sort(list_filter(f.free, lambda x: x.gpu >= t.gpu AND x.cpu >= t.min_cpu AND x.memory >= t.memory AND x.scratch >= t.scratch))[1] AS best
    FROM f JOIN t ON t.pool = f.pool AND t.r = f.r + 1))
"""


@query(_PACKING.format(order="key") + "SELECT pool, task, CAST(node AS VARCHAR) AS node FROM f WHERE r > 0", "submissions", "nodes")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Queued submissions of each launcher over the nodes of its pool."""
    submissions = relation(spark, sf, "submissions").where("state = 'queued'").select((F.col("launcher") % 5).alias("pool"), F.col("key").alias("task"), "min_cpu", "max_cpu", "memory", "scratch", "gpu")
    nodes = relation(spark, sf, "nodes").select((F.col("node") % 5).alias("pool"), "node", "cpu", "memory", "scratch", F.size("gpu").alias("gpu"))
    return schedule.pack(submissions, nodes, "pool").withColumn("node", F.col("node").cast("string"))


@query(
    _PACKING.format(order="max_cpu, key") + "SELECT f.pool, gpu, min_cpu, max_cpu, memory, scratch, count(*) AS n FROM f JOIN t ON t.pool = f.pool AND t.task = f.task WHERE f.node IS NULL GROUP BY ALL",
    "submissions",
    "nodes",
)
def scale_out_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What the nodes of each pool cannot take, by shape."""
    submissions = relation(spark, sf, "submissions").where("state = 'queued'").withColumn("pool", F.col("launcher") % 5)
    nodes = relation(spark, sf, "nodes").select((F.col("node") % 5).alias("pool"), "node", "cpu", "memory", "scratch", F.size("gpu").alias("gpu"))
    return schedule.scale_out_plan(submissions, nodes, "pool")


@query(
    "WITH RECURSIVE t AS (SELECT launcher AS pool, key AS task, min_cpu AS cpu, memory, row_number() OVER (PARTITION BY launcher ORDER BY key) AS r FROM submissions WHERE state = 'queued'), "
    "f(pool, r, task, host, hosts) AS (SELECT DISTINCT pool, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, [{'name': 'h1', 'cpu': 64::BIGINT, 'memory': 64000::BIGINT}, {'name': 'h2', 'cpu': 128::BIGINT, 'memory': 32000::BIGINT}, {'name': 'h3', 'cpu': 32::BIGINT, 'memory': 128000::BIGINT}] FROM t "
    "UNION ALL SELECT pool, r, task, best.name, CASE WHEN best IS NULL THEN hosts ELSE list_append(list_filter(hosts, lambda x: x.name <> best.name), {'name': best.name, 'cpu': CAST(best.cpu - cpu AS BIGINT), 'memory': CAST(best.memory - memory AS BIGINT)}) END "
    "FROM (SELECT t.*, f.hosts, list_filter(f.hosts, lambda x: x.cpu >= t.cpu AND x.memory >= t.memory)[1] AS best FROM f JOIN t ON t.pool = f.pool AND t.r = f.r + 1)) "
    "SELECT pool, task, host FROM f WHERE r > 0",
    "submissions",
)
def round_robin_hosts(spark: SparkSession, sf: str) -> DataFrame:
    submissions = relation(spark, sf, "submissions").where("state = 'queued'").select(F.col("launcher").alias("pool"), F.col("key").alias("task"), F.col("min_cpu").alias("cpu"), "memory")
    return schedule.round_robin(submissions, [("h1", 64, 64000), ("h2", 128, 32000), ("h3", 32, 128000)])


_QUEUES = [("od-small", False, 400, 100), ("od-big", False, 600, 300), ("spot", True, 1000, 0), ("unknown", True, 100, 0)]
_TYPES = [("od-small", 4, 2000, 0), ("od-big", 8, 4000, 0), ("od-big", 16, 8000, 1), ("spot", 8, 8000, 2)]


@query(
    "WITH q(queue, spot, most, used) AS (VALUES ('od-small', false, 400, 100), ('od-big', false, 600, 300), ('spot', true, 1000, 0), ('unknown', true, 100, 0)), "
    "i(queue, vcpus, memory, gpus) AS (VALUES ('od-small', 4, 2000, 0), ('od-big', 8, 4000, 0), ('od-big', 16, 8000, 1), ('spot', 8, 8000, 2)), "
    "a AS (SELECT key AS ask, max_cpu * 60 AS cpu, max_cpu, memory, gpu FROM submissions WHERE state = 'queued'), "
    "z AS (SELECT q.queue, q.spot, coalesce(max(vcpus), 2147483647) AS size FROM q LEFT JOIN i USING (queue) GROUP BY ALL), "
    "f AS (SELECT a.ask, z.*, a.gpu, row_number() OVER (PARTITION BY a.ask ORDER BY CASE WHEN a.gpu > 0 OR z.spot <> (400 + max_cpu <= 1000) THEN 0 ELSE 1 END, size, z.queue) AS r FROM a JOIN z ON "
    "z.queue = 'unknown' OR EXISTS (SELECT 1 FROM i WHERE i.queue = z.queue AND i.vcpus >= a.max_cpu AND i.memory >= a.memory AND i.gpus >= a.gpu)) "
    "SELECT ask, queue FROM f WHERE r = 1",
    "submissions",
)
def batch_queue_route(spark: SparkSession, sf: str) -> DataFrame:
    asks = relation(spark, sf, "submissions").where("state = 'queued'").select(F.col("key").alias("ask"), F.col("max_cpu").alias("cpu"), "memory", "gpu")
    queues = spark.createDataFrame(_QUEUES, "queue string, spot boolean, most int, used int")
    return schedule.route_queue(asks, queues, spark.createDataFrame(_TYPES, "queue string, vcpus int, memory int, gpus int"))


@query(
    "WITH t(target, external, position, max_cpu, max_memory, room) AS (VALUES ('ext', true, 3, 4, 2000, 1), ('p0', false, 0, 8, 2500, 0), ('p1', false, 1, 6, 8000, 5), ('p2', false, 2, 99, 9999, 9)) "
    "SELECT key AS ask, arg_min(target, (CASE WHEN external THEN 0 ELSE 10 END) + position) AS target FROM submissions JOIN t ON t.max_cpu >= submissions.max_cpu AND max_memory >= memory AND room > 0 GROUP BY key",
    "submissions",
)
def capacity_screen(spark: SparkSession, sf: str) -> DataFrame:
    asks = relation(spark, sf, "submissions").select(F.col("key").alias("ask"), F.col("max_cpu").alias("cpu"), "memory")
    rows = [("ext", True, 3, 4, 2000, 1), ("p0", False, 0, 8, 2500, 0), ("p1", False, 1, 6, 8000, 5), ("p2", False, 2, 99, 9999, 9)]
    targets = spark.createDataFrame(rows, "target string, external boolean, position int, max_cpu int, max_memory int, room int")
    return schedule.screen_targets(asks, targets)


@query("SELECT s_nationkey AS queue, max(cpu) AS cpu, max(memory) AS memory, max(len(gpu))::INTEGER AS gpu FROM nodes JOIN supplier ON node = s_suppkey GROUP BY s_nationkey", "nodes")
def largest_instance(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("queue"))
    return schedule.largest_instance(relation(spark, sf, "nodes").join(nations, "node").select("queue", "cpu", "memory", F.size("gpu").alias("gpu")))


# --- metrics --------------------------------------------------------------------------------------------------------


@query("SELECT task, version, count(*) AS n FROM submissions WHERE state = 'queued' GROUP BY ALL", "submissions")
def queued_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.count_by_task(relation(spark, sf, "submissions").where("state = 'queued'"))


@query("SELECT task, version, count(*) AS n FROM submissions WHERE state = 'scheduled' GROUP BY ALL", "submissions")
def running_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.count_by_task(relation(spark, sf, "submissions").where("state = 'scheduled'"))


@query("SELECT CAST(sum(cpu) AS BIGINT) AS cpu, CAST(sum(memory) AS BIGINT) AS memory FROM allocations", "allocations")
def allocated_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.totals(relation(spark, sf, "allocations"), ["cpu", "memory"])


@query("SELECT state, count(*) AS n, CAST(sum(cpu) AS BIGINT) AS cpu, CAST(sum(memory) AS BIGINT) AS memory, CAST(sum(scratch) AS BIGINT) AS scratch, CAST(sum(len(gpu)) AS BIGINT) AS gpu FROM nodes GROUP BY state", "nodes")
def node_state_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.node_totals(relation(spark, sf, "nodes"))


@query("SELECT CAST((SELECT sum(cpu) FROM nodes WHERE state = 'running') - sum(min_cpu) AS BIGINT) AS cpu, CAST((SELECT sum(memory) FROM nodes WHERE state = 'running') - sum(memory) AS BIGINT) AS memory, CAST((SELECT sum(scratch) FROM nodes WHERE state = 'running') - sum(scratch) AS BIGINT) AS scratch, CAST((SELECT sum(len(gpu)) FROM nodes WHERE state = 'running') - sum(gpu) AS BIGINT) AS gpu FROM submissions WHERE state = 'scheduled'", "submissions", "nodes")
def available_totals(spark: SparkSession, sf: str) -> DataFrame:
    running = relation(spark, sf, "nodes").where("state = 'running'").withColumn("gpu", F.size("gpu"))
    return metrics.available(running, relation(spark, sf, "submissions").where("state = 'scheduled'").withColumn("cpu", F.col("min_cpu")), ["cpu", "memory", "scratch", "gpu"])


@query("SELECT task, version, CAST(sum(max_cpu) AS BIGINT) AS max_cpu, CAST(sum(memory) AS BIGINT) AS memory, CAST(sum(scratch) AS BIGINT) AS scratch, CAST(sum(gpu) AS BIGINT) AS gpu FROM submissions WHERE state = 'queued' GROUP BY ALL", "submissions")
def queued_resources(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.totals(relation(spark, sf, "submissions").where("state = 'queued'"), ["max_cpu", "memory", "scratch", "gpu"], ["task", "version"])


@query("SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM nodes WHERE state = 'running') GROUP BY label", "nodes")
def count_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.count_by_label(relation(spark, sf, "nodes").where("state = 'running'"))


@query("SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'prod' AS label, count(*) AS n FROM submissions WHERE version < 3 UNION ALL SELECT 'eu', count(*) FROM submissions WHERE version = 2) GROUP BY label", "submissions")
def affinity_label_count(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that queued work asks for; what stands under a Not is no affinity."""
    asked = {1: And((Has("prod"), Not(Has("spot")))), 2: Or((Has("prod"), Has("eu"), Has("prod"))), 3: None}
    labels = F.lit(None).cast("array<string>")
    for v, s in asked.items():
        labels = F.when(F.col("version") == v, F.array(*map(F.lit, affinity_labels(s))).cast("array<string>")).otherwise(labels)
    return metrics.count_by_label(relation(spark, sf, "submissions").select(labels.alias("labels")))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (WHERE version = 2) AS BIGINT) AS n_spot FROM submissions WHERE state = 'queued' AND version < 3", "submissions")
def with_selector_count(spark: SparkSession, sf: str) -> DataFrame:
    """Queued requests that carry a selector, and those whose selector a spot node fulfils."""
    asked = {1: Not(Has("spot")), 2: And((Has("spot"), Or((Has("eu"), Not(Has("us")))))), 3: None}
    carried, fits = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for version, selector in asked.items():
        here = F.col("version") == version
        carried = F.when(here, F.lit(to_json(selector))).otherwise(carried)
        fits = F.when(here, matches(selector, F.array(F.lit("spot")))).otherwise(fits)
    rows = relation(spark, sf, "submissions").where("state = 'queued'").select(carried.alias("selector"), fits.alias("fits")).where("selector is not null")
    return rows.agg(F.count("*").alias("n"), F.count_if("fits").alias("n_spot"))


@query(
    "WITH c AS (SELECT CAST(key AS VARCHAR) AS name, min(seq) AS first, count(*) AS n FROM queue_events GROUP BY key), "
    "r AS (SELECT *, row_number() OVER (ORDER BY first, name) AS r FROM c) SELECT CASE WHEN r <= 10 THEN name ELSE '_other' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "queue_events",
)
def cardinality_cap(spark: SparkSession, sf: str) -> DataFrame:
    counts = relation(spark, sf, "queue_events").groupBy(F.col("key").cast("string").alias("name")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    return metrics.capped(counts, "name", "first", 10)


@query(
    "WITH c AS (SELECT CAST(key AS VARCHAR) AS name, min(seq) AS first, count(*) AS n FROM queue_events GROUP BY key), "
    "a AS (SELECT name FROM c WHERE CAST(name AS BIGINT) % 20 = 0 UNION ALL (SELECT name FROM c WHERE CAST(name AS BIGINT) % 20 <> 0 ORDER BY first, name LIMIT 5)) "
    "SELECT CASE WHEN a.name IS NULL THEN '_other' ELSE c.name END AS name, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN a USING (name) GROUP BY 1",
    "queue_events",
)
def admitted_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series that were admitted before stay, and new ones join them while there is room (ten in all)."""
    seen = relation(spark, sf, "queue_events").select(F.col("key").cast("string").alias("name"), "seq")
    before = seen.where(F.col("name").cast("long") % 20 == 0).select("name")
    names = metrics.admitted(before, seen, "name", "seq", 10)
    return metrics.relabelled(seen.groupBy("name").agg(F.count("*").alias("n")), names, "name")


@query("SELECT DISTINCT o_orderkey AS max_series, CAST(greatest(1, floor((o_orderkey - 6) / 21.0) - 1) AS BIGINT) AS pairs, CAST(greatest(1, floor(o_orderkey / 50.0)) AS BIGINT) AS labels FROM orders")
def series_caps(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs and labels fit budgets of series."""
    pairs, labels = metrics.series_caps("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("max_series"), pairs.cast("long").alias("pairs"), labels.cast("long").alias("labels")).distinct()


@query("SELECT task, version, state, count(*) AS n FROM submissions GROUP BY ALL", "submissions")
def task_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions by what became of them, by name and version."""
    return relation(spark, sf, "submissions").groupBy("task", "version", "state").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n FROM queue_events GROUP BY kind", "queue_events")
def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "queue_events").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT kind, CASE WHEN moment <= 1 THEN '1' WHEN moment <= 10 THEN '10' WHEN moment <= 60 THEN '60' WHEN moment <= 600 THEN '600' WHEN moment <= 3600 THEN '3600' ELSE 'inf' END AS le, count(*) AS n, CAST(sum(moment) AS BIGINT) AS total FROM queue_events GROUP BY ALL", "queue_events")
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(relation(spark, sf, "queue_events"), "moment", metrics.DURATION_BOUNDS, ["kind"])


@query(
    "WITH w AS (SELECT key, seq, kind, seq - max(CASE WHEN kind = 'Enqueued' THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wait FROM queue_events) "
    "SELECT CASE WHEN wait <= 0.1 THEN '0.1' WHEN wait <= 1 THEN '1' WHEN wait <= 10 THEN '10' WHEN wait <= 60 THEN '60' WHEN wait <= 600 THEN '600' ELSE 'inf' END AS le, count(*) AS n, CAST(sum(wait) AS BIGINT) AS total FROM w WHERE kind = 'TaskScheduled' AND wait IS NOT NULL GROUP BY 1",
    "queue_events",
)
def wait_time_histogram(spark: SparkSession, sf: str) -> DataFrame:
    waits = metrics.queue_waits(relation(spark, sf, "queue_events").withColumn("moment", F.col("seq")))
    return metrics.histogram(waits, "wait", metrics.WAIT_BOUNDS)


@query("SELECT max_series, pairs, labels FROM (VALUES (47, 1, 1), (50, 1, 1), (5000, 236, 100)) t(max_series, pairs, labels)")
def series_budget(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(m, *metrics.caps(m)) for m in (47, 50, 5000)], "max_series int, pairs int, labels int")


@query("SELECT task, node AS made_by, file FROM (SELECT l_orderkey AS task, l_partkey AS file FROM lineitem) JOIN (SELECT p_partkey AS file, p_size AS node FROM part) USING (file)")
def history_of_inputs(spark: SparkSession, sf: str) -> DataFrame:
    from larkspur.sources.blobs import histories

    inputs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.collect_list("l_partkey").alias("files"))
    return histories(inputs, table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("made_by")))


# --- sets -----------------------------------------------------------------------------------------------------------


@query("SELECT node, array_to_string(list_filter(labels, lambda x: x <> 'spot'), ',') AS immutable FROM nodes", "nodes")
def immutable_files(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "nodes").select("node", F.array_join(sets.immutable_only("labels", F.array(F.lit("spot"))), ",").alias("immutable"))


@query("SELECT min_cpu, memory FROM submissions WHERE state = 'queued' EXCEPT ALL SELECT DISTINCT min_cpu, memory FROM submissions WHERE state = 'queued' AND gpu > 0", "submissions")
def remove_first(spark: SparkSession, sf: str) -> DataFrame:
    queued = relation(spark, sf, "submissions").where("state = 'queued'")
    return sets.remove_first(queued.select("min_cpu", "memory"), queued.where("gpu > 0").select("min_cpu", "memory").distinct())


@query("SELECT key, launcher FROM submissions WHERE state = 'queued' UNION SELECT key, launcher FROM queue_events WHERE kind = 'Enqueued'", "submissions", "queue_events")
def union_of_waiters(spark: SparkSession, sf: str) -> DataFrame:
    """The waiters that a key had and those that came since, each once."""
    had = relation(spark, sf, "submissions").where("state = 'queued'").select("key", "launcher")
    return had.union(relation(spark, sf, "queue_events").where("kind = 'Enqueued'").select("key", "launcher")).distinct()


@query("SELECT doc_id, concat_ws(',', source, lang, concat(source, '/x')) AS files FROM documents")
def file_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """All file handles in nested values, each once."""
    handle = lambda path: F.struct(path.alias("path"), F.lit(0).alias("hash"))
    source, lang = F.col("source"), F.col("lang")
    nested = table(spark, sf, "documents").select(
        "doc_id", handle(source).alias("one"), F.struct(F.array(handle(lang), handle(source)).alias("more")).alias("deep"), F.create_map(F.lit("k"), handle(F.concat(source, F.lit("/x")))).alias("named")
    )
    found = sets.file_handles(nested)
    return nested.select("doc_id", F.array_join(F.transform(found, lambda h: h["path"]), ",").alias("files"))


# --- state and time -------------------------------------------------------------------------------------------------


@query("SELECT launcher, count(*) AS n FROM queue_events WHERE kind = 'LauncherJoined' GROUP BY launcher", "queue_events")
def launcher_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = relation(spark, sf, "queue_events").where("kind = 'LauncherJoined'").select(F.col("launcher").alias("entity"), F.lit("Incremented").alias("kind"))
    return state.launcher_counters(events)


@query("WITH s AS (SELECT launcher, seq AS moment, seq // 100 AS counter FROM queue_events), l AS (SELECT *, lag(counter) OVER (PARTITION BY launcher ORDER BY moment) AS b FROM s) SELECT launcher, min(moment) AS moment FROM l WHERE counter = b GROUP BY launcher", "queue_events")
def dead_launchers(spark: SparkSession, sf: str) -> DataFrame:
    return state.dead_launchers(relation(spark, sf, "queue_events").select("launcher", F.col("seq").alias("moment"), F.expr("seq div 100").alias("counter")))


@query("WITH s AS (SELECT launcher, seq AS moment, seq // 100 AS counter FROM queue_events), g AS (SELECT launcher, counter, min(moment) AS since FROM s GROUP BY ALL) SELECT launcher, min(moment) AS moment FROM s JOIN g USING (launcher, counter) WHERE moment - since >= 40 GROUP BY launcher", "queue_events")
def silent_launchers(spark: SparkSession, sf: str) -> DataFrame:
    """Launchers whose counter stood still for two intervals of 20."""
    return state.silent_launchers(relation(spark, sf, "queue_events").select("launcher", F.col("seq").alias("moment"), F.expr("seq div 100").alias("counter")), 20)


@query("SELECT key FROM submissions WHERE state = 'scheduled' AND launcher % 7 = 0", "submissions")
def requeue_on_crash(spark: SparkSession, sf: str) -> DataFrame:
    submissions = relation(spark, sf, "submissions")
    return state.requeued(submissions.where("state = 'scheduled'"), submissions.where("launcher % 7 = 0")).select("key")


@query("SELECT launcher AS entity, arg_max(kind, seq) AS kind FROM queue_events GROUP BY launcher", "queue_events")
def node_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return state.last_event(relation(spark, sf, "queue_events").withColumnRenamed("launcher", "entity"))


@query(
    "WITH w AS (SELECT key, seq, kind, last_value(CASE WHEN kind IN ('Enqueued', 'TaskScheduled') THEN kind END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM queue_events) SELECT key AS entity, seq FROM w WHERE kind = 'TaskDone' AND b = 'Enqueued'",
    "queue_events",
)
def late_completion(spark: SparkSession, sf: str) -> DataFrame:
    return state.late_completions(relation(spark, sf, "queue_events").withColumnRenamed("key", "entity"))


@query("SELECT node FROM nodes WHERE state = 'pending' AND 1000 - node * 7 > 900", "nodes")
def pending_timeout(spark: SparkSession, sf: str) -> DataFrame:
    return state.pending_timeouts(relation(spark, sf, "nodes").where("state = 'pending'").select("node", (F.col("node") * 7).alias("since")), 1000, 900)


@query("SELECT launcher AS session FROM queue_events WHERE kind IN ('Enqueued', 'TaskDone') GROUP BY launcher HAVING arg_max(kind, seq) = 'Enqueued'", "queue_events")
def main_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that joined (Enqueued) and did not leave (TaskDone) since."""
    kind = F.when(F.col("kind") == "Enqueued", "MainJoined").when(F.col("kind") == "TaskDone", "MainLeft")
    events = relation(spark, sf, "queue_events").select(F.col("launcher").alias("session"), "seq", kind.alias("kind")).where("kind is not null")
    return state.sessions_left(events)


@query("SELECT key, launcher FROM queue_events WHERE launcher % 5 <> 0", "queue_events")
def session_gc(spark: SparkSession, sf: str) -> DataFrame:
    proxy = F.concat(F.lit("s"), (F.col("launcher") % 5).cast("string"), F.lit("~"), F.col("launcher").cast("string"))
    return state.drop_session(relation(spark, sf, "queue_events").withColumn("proxy", proxy), "s0").select("key", "launcher")


def _fold_events(spark: SparkSession, sf: str) -> DataFrame:
    e = relation(spark, sf, "queue_events").where("kind <> 'LauncherJoined'")
    return e.select(F.col("key").cast("string").alias("entity"), "seq", "kind", F.col("launcher").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))


#: The state machine as a recursion over the events of each key, in order.
_FOLD = """
WITH RECURSIVE e AS (SELECT CAST(key AS VARCHAR) AS entity, row_number() OVER (PARTITION BY key ORDER BY seq) AS r, kind, CAST(launcher AS VARCHAR) AS a FROM queue_events WHERE kind <> 'LauncherJoined'),
f(entity, r, status, launcher, ended, proxies, waits) AS (
  SELECT entity, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], false FROM e WHERE r = 1
  UNION ALL
  SELECT f.entity, e.r,
    CASE WHEN kind = 'Enqueued' THEN CASE WHEN status = 'scheduled' THEN 'scheduled' ELSE 'queued' END
      WHEN kind = 'TaskScheduled' AND status = 'queued' THEN 'scheduled' WHEN kind IN ('TaskDone', 'TaskFailed') THEN NULL ELSE status END,
    CASE WHEN kind = 'TaskScheduled' AND status = 'queued' THEN a WHEN kind IN ('TaskDone', 'TaskFailed') AND status IS NOT NULL THEN NULL ELSE launcher END,
    CASE WHEN kind IN ('TaskDone', 'TaskFailed') AND status IS NOT NULL THEN kind ELSE ended END,
    CASE WHEN kind = 'Enqueued' THEN list_sort(list_distinct(list_append(proxies, a))) WHEN kind IN ('TaskDone', 'TaskFailed') AND status IS NOT NULL THEN [] ELSE proxies END,
    CASE WHEN kind = 'Enqueued' THEN true WHEN kind IN ('TaskDone', 'TaskFailed') AND status IS NOT NULL THEN false ELSE waits END
  FROM f JOIN e ON e.entity = f.entity AND e.r = f.r + 1)
SELECT entity, max(r) AS n_events, arg_max(concat('{', array_to_string(list_filter([
  CASE WHEN launcher IS NOT NULL THEN '"allocated":null' END, CASE WHEN ended IS NOT NULL THEN concat('"ended":"', ended, '"') END,
  CASE WHEN launcher IS NOT NULL THEN concat('"launcher":"', launcher, '"') END,
  CASE WHEN waits THEN concat('"proxies":["', array_to_string(proxies, '","'), '"]') END,
  CASE WHEN status IS NOT NULL THEN concat('"status":"', status, '"') END, CASE WHEN waits THEN '"task":null' END], lambda x: x IS NOT NULL), ','), '}'), r) AS state
FROM f GROUP BY entity
"""


@query(_FOLD, "queue_events")
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The queue's state machine over all events of each key."""
    return state.fold(_fold_events(spark, sf))


@query(_FOLD, "queue_events")
def event_fold_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream that reads the events and runs until it has seen them all; its updates are tables, one for each micro-batch."""
    events = _fold_events(spark, sf)
    folder, check, out = (new_path(spark, f"stream-{x}") for x in ("in", "check", "out"))
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    run = state.fold_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.schema(f"{state.STATE}, batch long").parquet(out)
    return seen.groupBy("entity").agg(F.max_by(F.struct("state", "n_events"), "batch").alias("x")).select("entity", "x.*")


_NODE_EVENTS = "['NodeRequested', 'NodeRequested', 'NodeRequested', 'NodeRequested', 'NodeIsPending', 'NodeIsPending', 'NodeIsPending', 'NodeIsUp', 'NodeIsUp', 'NodeIsDown', 'InitFailed', 'NodeRequestFailed', 'NodeRequested']"


@query(
    f"WITH e AS (SELECT launcher, seq, CASE WHEN seq % 101 = 0 THEN 'AllStop' ELSE {_NODE_EVENTS}[CAST(seq % 13 AS INTEGER) + 1] END AS kind, CAST(seq // 13 % 2 AS VARCHAR) AS a, CAST(seq // 26 % 3 AS VARCHAR) AS b FROM queue_events), "
    "r AS (SELECT launcher, count(*) FILTER (WHERE kind = 'NodeRequested') AS requested, coalesce(max(seq) FILTER (WHERE kind = 'AllStop'), -1) AS stop FROM e GROUP BY launcher), "
    "l AS (SELECT e.* FROM e JOIN r USING (launcher) WHERE seq > stop), "
    "w AS (SELECT launcher, a, seq, sum(CASE WHEN kind = 'NodeRequested' THEN 1 ELSE -1 END) OVER (PARTITION BY launcher, a ORDER BY seq) AS s FROM l WHERE kind IN ('NodeRequested', 'NodeRequestFailed', 'NodeIsPending')), "
    "f AS (SELECT launcher, CAST(sum(n) AS INTEGER) AS in_flight FROM (SELECT launcher, a, arg_max(s, seq) - least(0, min(s)) AS n FROM w GROUP BY launcher, a) GROUP BY launcher), "
    "p AS (SELECT launcher, string_agg(b, ',' ORDER BY b) AS pending FROM (SELECT launcher, b FROM l WHERE kind IN ('NodeIsPending', 'NodeIsUp', 'InitFailed') GROUP BY launcher, b HAVING arg_max(kind, seq) = 'NodeIsPending') GROUP BY launcher), "
    "u AS (SELECT launcher, string_agg(b, ',' ORDER BY b) AS running FROM (SELECT launcher, b FROM l WHERE kind IN ('NodeIsUp', 'NodeIsDown') GROUP BY launcher, b HAVING arg_max(kind, seq) = 'NodeIsUp') GROUP BY launcher) "
    "SELECT launcher, CAST(requested AS INTEGER) AS requested, coalesce(in_flight, 0) AS in_flight, coalesce(pending, '') AS pending, coalesce(running, '') AS running "
    "FROM r LEFT JOIN f USING (launcher) LEFT JOIN p USING (launcher) LEFT JOIN u USING (launcher)",
    "queue_events",
)
def node_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of all events of nodes: requested, in flight, pending and running ones of each launcher."""
    seq = F.col("seq")
    kinds = F.array(*map(F.lit, _NODE_EVENTS.strip("[']").split("', '")))
    kind = F.when(seq % 101 == 0, "AllStop").otherwise(F.get(kinds, (seq % 13).cast("int")))
    events = relation(spark, sf, "queue_events").select(
        F.col("launcher").cast("string").alias("entity"), "seq", kind.alias("kind"), F.expr("cast(seq div 13 % 2 as string)").alias("a"), F.expr("cast(seq div 26 % 3 as string)").alias("b")
    )
    folded = state.fold(events).select(F.col("entity").cast("long").alias("launcher"), F.from_json("state", "requested int, in_flight array<string>, pending array<string>, running array<string>").alias("s"))
    return folded.select(
        "launcher",
        F.coalesce("s.requested", F.lit(0)).alias("requested"),
        F.coalesce(F.size("s.in_flight"), F.lit(0)).alias("in_flight"),
        F.coalesce(F.array_join("s.pending", ","), F.lit("")).alias("pending"),
        F.coalesce(F.array_join("s.running", ","), F.lit("")).alias("running"),
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
