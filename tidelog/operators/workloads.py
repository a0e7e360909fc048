"""Generated workloads: Zipf-distributed keys by the closed-form inverse, and the YCSB mixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the YCSB core workloads: percent of read, update, insert, scan, read-modify-write.
MIXES = {
    "a": (50, 50, 0, 0, 0),
    "b": (95, 5, 0, 0, 0),
    "c": (100, 0, 0, 0, 0),
    "d": (95, 0, 5, 0, 0),
    "e": (0, 0, 5, 95, 0),
    "f": (50, 0, 0, 0, 50),
}
OPERATIONS = ("read", "update", "insert", "scan", "rmw")
ZETA_TERMS = 10_000


def zeta(n: int, theta: float) -> float:
    """Sum of i ** -theta for i up to n, the tail beyond ``ZETA_TERMS`` by its integral."""
    head = sum(i**-theta for i in range(1, min(n, ZETA_TERMS) + 1))
    return head if n <= ZETA_TERMS else head + (n ** (1 - theta) - ZETA_TERMS ** (1 - theta)) / (1 - theta)


def zipf(u: Column, n: int, theta: float = 0.99) -> Column:
    """A rank from 0 to n - 1 for a uniform ``u`` in [0, 1): the quick method of Gray and others for skewed keys."""
    whole = zeta(n, theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / whole)
    tail = F.floor(F.lit(n) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(1 / (1 - theta))))
    return F.when(u * whole < 1, 0).when(u * whole < 1 + 0.5**theta, 1).otherwise(F.least(tail, F.lit(n - 1))).cast("long")


def ycsb_operation(percent: Column, mix: str) -> Column:
    """The operation of a workload for a uniform whole ``percent`` from 0 to 99."""
    upto, kind = 0, F.lit(None).cast("string")
    choices = []
    for name, share in zip(OPERATIONS, MIXES[mix], strict=True):
        upto += share
        choices.append((upto, name))
    for limit, name in reversed(choices):
        kind = F.when(percent < limit, name).otherwise(kind)
    return kind
