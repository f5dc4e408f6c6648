"""Orderings of pending work items as bucket columns.

A bucket column says which class of the pending set runs next; the lowest class is
drained before the next one.  Orderings change the amount of work, never the answer
of a monotone kernel.  A constant column means that everything pending runs at once.
Orderings at the level of a machine's nodes, memory banks or threads have no visible
effect on data and are accepted as names of the global ordering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Ordering = Callable[[], Column | None]


def chaotic() -> Ordering:
    return lambda: None


def dijkstra(field: str = "cand") -> Ordering:
    return lambda: F.col(field).cast("bigint")


def delta(width: int = 10, field: str = "cand") -> Ordering:
    if width <= 0:
        raise ValueError("width must be positive")
    return lambda: F.floor(F.col(field) / width).cast("bigint")


class ByVertex:
    """An ordering whose bucket column is made of id alone: a vertex is always in the same class.

    Where the loop runs it in parts (`plans/blocks.py`), the order holds inside each part.
    """

    def __init__(self, bucket: Ordering) -> None:
        self.bucket = bucket

    def __call__(self) -> Column | None:
        return self.bucket()


def vertex_delta(width: int = 10) -> Ordering:
    return ByVertex(delta(width, "id"))


def level() -> Ordering:
    return lambda: F.col("level").cast("bigint")


def klevel(k: int = 2) -> Ordering:
    return delta(k, "level")


#: By name, with their parameter where they have one.
REGISTRY: dict[str, Callable[..., Ordering]] = {
    "chaotic": chaotic,
    "dijkstra": dijkstra,
    "delta": delta,
    "vertex_delta": vertex_delta,
    "level": level,
    "klevel": klevel,
}


def named(name: str, *args: int) -> Ordering:
    """An ordering by name; a prefix node_, numa_ or thread_ is accepted and has no effect."""
    for prefix in ("node_", "numa_", "thread_"):
        name = name.removeprefix(prefix)
    return REGISTRY[name](*args)
