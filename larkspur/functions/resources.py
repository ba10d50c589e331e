"""Arithmetic of resources as columns.

A request has min_cpu, max_cpu, memory, scratch, gpu (a number) and image; a supply has cpu, memory, scratch, gpu (sorted
ids) and image. All are structs; fields may be any columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    """What a task asks for; fields are columns."""

    min_cpu: Column
    max_cpu: Column
    memory: Column
    scratch: Column
    gpu: Column
    image: Column

    @staticmethod
    def of(prefix: str = "") -> Request:
        return Request(*(F.col(prefix + c) for c in ("min_cpu", "max_cpu", "memory", "scratch", "gpu", "image")))


@dataclass(frozen=True)
class Supply:
    """What a node has, or what a task was given; fields are columns."""

    cpu: Column
    memory: Column
    scratch: Column
    gpu: Column
    image: Column

    @staticmethod
    def of(prefix: str = "") -> Supply:
        return Supply(*(F.col(prefix + c) for c in ("cpu", "memory", "scratch", "gpu", "image")))

    def struct(self) -> Column:
        return F.struct(*(getattr(self, c).alias(c) for c in ("cpu", "memory", "scratch", "gpu", "image")))


def valid_gpus(gpu: str | Column) -> Column:
    """Whether ids are sorted and distinct."""
    gpu = F.col(gpu) if isinstance(gpu, str) else gpu
    return gpu == F.array_sort(F.array_distinct(gpu))


def can_fulfill(supply: Supply, request: Request) -> Column:
    """Whether a supply covers the least a request asks for, with its image if it names one."""
    image = request.image.isNull() | F.coalesce(request.image == supply.image, F.lit(False))
    return (supply.cpu >= request.min_cpu) & (supply.memory >= request.memory) & (supply.scratch >= request.scratch) & (F.size(supply.gpu) >= request.gpu) & image


def can_hold(supply: Supply, grant: Supply) -> Column:
    """Whether a supply covers a grant, its very gpu ids included."""
    image = grant.image.isNull() | F.coalesce(grant.image == supply.image, F.lit(False))
    ids = F.size(F.array_except(grant.gpu, supply.gpu)) == 0
    return (supply.cpu >= grant.cpu) & (supply.memory >= grant.memory) & (supply.scratch >= grant.scratch) & ids & image


def subtract_request(supply: Supply, request: Request) -> Supply:
    """What is left after the most a request may take; cpu does not fall below 0, the first gpus go."""
    left = F.greatest(F.size(supply.gpu) - request.gpu, F.lit(0))
    return Supply(
        F.greatest(supply.cpu - request.max_cpu, F.lit(0)),
        supply.memory - request.memory,
        supply.scratch - request.scratch,
        F.slice(supply.gpu, (request.gpu + 1).cast("int"), F.greatest(left, F.lit(0)).cast("int")),
        supply.image,
    )


def subtract(supply: Supply, grant: Supply) -> Supply:
    return Supply(supply.cpu - grant.cpu, supply.memory - grant.memory, supply.scratch - grant.scratch, F.array_except(supply.gpu, grant.gpu), supply.image)


def subtract_all(supply: Supply) -> Supply:
    zero = F.lit(0)
    return Supply(zero, zero, zero, F.array().cast("array<int>"), supply.image)


def add_back(supply: Supply, grant: Supply) -> Supply:
    """The supply with a grant returned; an error where an id is in both."""
    gpu = F.when(F.arrays_overlap(supply.gpu, grant.gpu), F.raise_error(F.lit("a gpu is returned twice")).cast("array<int>")).otherwise(F.array_sort(F.concat(supply.gpu, grant.gpu)))
    return Supply(supply.cpu + grant.cpu, supply.memory + grant.memory, supply.scratch + grant.scratch, gpu, supply.image)


def maximum_grant(supply: Supply, request: Request) -> Supply:
    """The most a supply can give a request; the image only if it is the one asked for."""
    image = F.when(request.image == supply.image, request.image)
    return Supply(F.least(supply.cpu, request.max_cpu), request.memory, request.scratch, F.slice(supply.gpu, 1, F.greatest(request.gpu, F.lit(0)).cast("int")), image)


def minimum_grant(supply: Supply, request: Request) -> Supply:
    """The least that fulfils a request."""
    return Supply(request.min_cpu, request.memory, request.scratch, F.slice(supply.gpu, 1, F.greatest(request.gpu, F.lit(0)).cast("int")), request.image)


def clamp(request: Request, cpu: int, memory: int) -> Request:
    """A request raised to configured minimums."""
    low = F.greatest(request.min_cpu, F.lit(cpu))
    return Request(low, F.greatest(request.max_cpu, low), F.greatest(request.memory, F.lit(memory)), request.scratch, request.gpu, request.image)
