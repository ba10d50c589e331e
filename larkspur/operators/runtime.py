"""What surrounds a submission: resource requests, orchestrating functions, cancellation, retries, settings."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark import TaskContext
from pyspark.sql import SparkSession

from larkspur.operators.memo import SubmissionError
from larkspur.operators.settings import Settings

__all__ = ["ResourceRequest", "Settings", "cancellable", "parent", "retry"]

R = TypeVar("R")


@dataclass(frozen=True)
class ResourceRequest:
    """What a task needs. ``cpu`` may be a number (exactly that many) or a range (least, most)."""

    cpu: int | tuple[int, int]
    memory: int
    scratch: int = 0
    gpu: int = 0
    image: str | None = None

    def __post_init__(self) -> None:
        if self.min_cpu > self.max_cpu or min(self.min_cpu, self.memory, self.scratch, self.gpu) < 0:
            raise ValueError(f"not a valid request: {self}")

    @property
    def min_cpu(self) -> int:
        return self.cpu if isinstance(self.cpu, int) else self.cpu[0]

    @property
    def max_cpu(self) -> int:
        return self.cpu if isinstance(self.cpu, int) else self.cpu[1]

    def row(self) -> tuple:
        """min_cpu, max_cpu, memory, scratch, gpu, image."""
        return self.min_cpu, self.max_cpu, self.memory, self.scratch, self.gpu, self.image

    def profile(self) -> Any:
        """The request as a Spark resource profile, for stages on clusters that support them (not in local mode)."""
        from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

        executor = ExecutorResourceRequests().cores(self.max_cpu).memory(f"{self.memory}m")
        task = TaskResourceRequests().cpus(self.min_cpu)
        if self.gpu:
            executor, task = executor.resource("gpu", self.gpu), task.resource("gpu", self.gpu)
        return ResourceProfileBuilder().require(executor).require(task).build


def parent(body: Callable[..., R]) -> Callable[..., R]:
    """An orchestrating function: it may submit, so it runs on the driver only."""

    @functools.wraps(body)
    def run(*args: Any, **kwargs: Any) -> R:
        if TaskContext.get() is not None:
            raise SubmissionError(f"{body.__name__} submits and cannot run inside a submission")
        return body(*args, **kwargs)

    return run


class cancellable:  # noqa: N801
    """Tags the jobs started inside it; ``cancel`` from another thread stops them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def __enter__(self) -> cancellable:
        self.spark.sparkContext.addJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(True)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(False)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def retry(body: Callable[[], R], times: int, wait: float = 2.0) -> R:
    """The result of ``body``, tried again after a failure up to ``times`` times."""
    while True:
        try:
            return body()
        except Exception:
            if times <= 0:
                raise
            times -= 1
            time.sleep(wait)
