"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Settings of the engine, from a session's ``spark.larkspur.<name>`` where given."""

    cache_enabled: bool = True
    verify_files: bool = True
    check_content: bool = True
    resubmit_attempts: int = 1
    max_nodes: int = 1
    max_nodes_cumulative: int = 10
    max_pending: int = 1
    heartbeat_seconds: int = 30
    pending_node_seconds: int = 900
    max_series: int = 5000
    code_version: str = "undefined"
    allow_deletion: bool = False
    allow_overwrite: bool = False
    write_histories: bool = False

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        found = {}
        for f in fields(Settings):
            text = spark.conf.get(f"spark.larkspur.{f.name}", None)
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() == "true" if kind is bool else kind(text)
        return Settings(**found)
