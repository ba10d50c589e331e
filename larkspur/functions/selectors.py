"""Label predicates: a small tree over a node's labels, compiled to a boolean column."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NESTED = 64


@dataclass(frozen=True)
class Always:
    """Every node."""


@dataclass(frozen=True)
class Has:
    label: str


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


Selector = Always | Has | Not | And | Or


def matches(selector: Selector | None, labels: str | Column = "labels") -> Column:
    """Whether labels (an array) fulfil the selector; none means every node. An empty And holds, an empty Or does not."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    if selector is None or isinstance(selector, Always):
        return F.lit(True)
    if isinstance(selector, Has):
        return F.coalesce(F.array_contains(labels, selector.label), F.lit(False))
    if isinstance(selector, Not):
        return ~matches(selector.inner, labels)
    parts = [matches(p, labels) for p in selector.parts]
    if isinstance(selector, And):
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def affinity_labels(selector: Selector | None) -> list[str]:
    """Labels asked for positively, each once, in order; what stands under a Not is left out."""
    if isinstance(selector, Has):
        return [selector.label]
    if isinstance(selector, And | Or):
        return list(dict.fromkeys(x for p in selector.parts for x in affinity_labels(p)))
    return []


def to_json(selector: Selector | None) -> str | None:
    def plain(s: Selector) -> Any:
        if isinstance(s, Has):
            return {"has": s.label}
        if isinstance(s, Not):
            return {"not": plain(s.inner)}
        if isinstance(s, And | Or):
            return {type(s).__name__.lower(): [plain(p) for p in s.parts]}
        return {"always": True}

    return None if selector is None else json.dumps(plain(selector), separators=(",", ":"))


def from_json(text: str | None) -> Selector | None:
    def tree(x: Any, depth: int) -> Selector:
        if depth > MOST_NESTED:
            raise ValueError(f"a selector nests more than {MOST_NESTED} deep")
        ((kind, value),) = x.items()
        if kind == "has":
            return Has(value)
        if kind == "not":
            return Not(tree(value, depth + 1))
        if kind in ("and", "or"):
            return {"and": And, "or": Or}[kind](tuple(tree(p, depth + 1) for p in value))
        return Always()

    return None if text is None else tree(json.loads(text), 0)
