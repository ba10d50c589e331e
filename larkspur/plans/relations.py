"""Relations of an engine's state, derived from the input tables so that queries over them can be checked.

Each is given twice, as a DataFrame and as SQL over the same tables: ``submissions`` from orders, ``nodes`` from supplier,
``allocations`` from lineitem, ``queue_events`` from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.shared import table

SUBMISSIONS = """
SELECT o_orderpriority AS task, CAST(1 + o_custkey % 3 AS INT) AS version, o_orderkey AS key, CAST(o_custkey % 10 AS INT) AS priority,
  CAST(1 + o_orderkey % 8 AS INT) AS min_cpu, CAST(1 + o_orderkey % 8 + o_custkey % 4 AS INT) AS max_cpu,
  CAST(500 * (1 + o_custkey % 8) AS INT) AS memory, CAST(100 * (o_orderkey % 5) AS INT) AS scratch, CAST(o_orderkey % 3 AS INT) AS gpu,
  CASE WHEN o_orderkey % 7 = 0 THEN 'img-a' END AS image, CASE WHEN o_custkey % 2 = 0 THEN 'v0' ELSE 'v1' END AS code_version,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'scheduled' ELSE 'done' END AS state,
  CAST(o_orderkey % 4 AS INT) AS depth, o_custkey % 50 AS launcher
FROM orders
"""
NODES = """
SELECT s_suppkey AS node, CAST(4 + s_suppkey % 13 AS INT) AS cpu, CAST(1000 * (1 + s_suppkey % 8) AS INT) AS memory,
  CAST(1000 * (s_suppkey % 4) AS INT) AS scratch, {gpus} AS gpu,
  CASE WHEN s_suppkey % 5 = 0 THEN 'img-a' END AS image, {labels} AS labels,
  CASE s_suppkey % 4 WHEN 2 THEN 'pending' WHEN 3 THEN 'inflight' ELSE 'running' END AS state
FROM supplier
"""
_GPUS = "CASE s_suppkey % 4 WHEN 0 THEN {a}{c} WHEN 1 THEN {a}0{c} WHEN 2 THEN {a}0, 1{c} ELSE {a}0, 1, 2{c} END"
_LABELS = (
    "CASE WHEN s_suppkey % 3 = 0 THEN {a}concat('nation:', CAST(s_nationkey AS {s})), 'spot', 'gpu:a100'{c} "
    "WHEN s_suppkey % 3 = 1 THEN {a}concat('nation:', CAST(s_nationkey AS {s})), 'spot'{c} "
    "ELSE {a}concat('nation:', CAST(s_nationkey AS {s})), 'on-demand'{c} END"
)
ALLOCATIONS = """
SELECT l_orderkey * 10 + l_linenumber AS task, l_suppkey AS node, CAST(1 + l_linenumber % 3 AS INT) AS cpu,
  CAST(100 * (1 + l_linenumber % 4) AS INT) AS memory, l_partkey AS file
FROM lineitem
"""
EVENTS = """
SELECT user_id AS launcher, event_id % 97 AS key, event_id AS seq, CAST(event_id * 3 % 1000 AS BIGINT) AS moment,
  CASE event_type WHEN 'signup' THEN 'LauncherJoined' WHEN 'view' THEN 'Enqueued' WHEN 'click' THEN 'TaskScheduled'
    WHEN 'purchase' THEN 'TaskDone' ELSE 'TaskFailed' END AS kind
FROM events
"""
SQL = {
    "submissions": SUBMISSIONS,
    "nodes": NODES.format(gpus="CAST(" + _GPUS.format(a="[", c="]") + " AS INT[])", labels=_LABELS.format(a="[", c="]", s="VARCHAR")),
    "allocations": ALLOCATIONS,
    "queue_events": EVENTS,
}
SPARK = SQL | {"nodes": NODES.format(gpus="CAST(" + _GPUS.format(a="array(", c=")") + " AS ARRAY<INT>)", labels=_LABELS.format(a="array(", c=")", s="STRING"))}
SOURCES = {"submissions": "orders", "nodes": "supplier", "allocations": "lineitem", "queue_events": "events"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES[name]
    return spark.sql(SPARK[name].replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def with_relations(sql: str, *names: str) -> str:
    """SQL with the named relations in front; a ``sql`` that begins with WITH [RECURSIVE] keeps its own tables."""
    ctes = ", ".join(f"{n} AS ({SQL[n].strip()})" for n in names)
    sql = sql.strip()
    if not ctes:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{ctes}, {sql.removeprefix(start)}"
    return f"WITH {ctes} {sql}"
