"""Merge operators: ordered folds of a key's operands over its base value.

A built-in operator is three column expressions, so a fold stays in the JVM:

* ``load`` turns a stored value into the type that is folded,
* ``fold(values)`` aggregates operands (with their sequence numbers) of a group,
* ``join(base, operands)`` joins a base with folded operands,

and ``store`` turns the result back. A :class:`CustomMerge` is two Python functions and runs as a grouped
Arrow fold. ``ordered`` says whether the order of operands matters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merge:
    """A built-in merge operator. Folded operands of two runs of operations join by ``join`` too, the older first."""

    name: str
    fold: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]
    load: Callable[[Column], Column] = lambda v: v
    store: Callable[[Column], Column] = lambda v: v
    ordered: bool = False
    fits: Callable[[Column], Column] = lambda v: F.lit(True)  # whether ``load`` takes a stored value


@dataclass(frozen=True)
class CustomMerge:
    """User functions: ``full(key, base or None, operands oldest first)`` and ``partial(key, older, newer)``; None is a failure.

    Reads call ``full``, and fail if it does. Compaction calls ``full`` for a chain with its base and else ``partial`` for neighbours, and keeps
    what fails as it is.
    """

    name: str
    full: Callable[[bytes, bytes | None, list[bytes]], bytes | None]
    partial: Callable[[bytes, bytes, bytes], bytes | None] = lambda key, older, newer: None


def ordered_list(seq: Column, value: Column) -> Column:
    """Values of a group in the order of their sequence numbers."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def _both(pick: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(pick(a, b))


def _halves(high: Column, low: Column) -> Column:
    """``high * 2^32 + low`` modulo 2^64, as a signed 64-bit integer."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrapped_sum(number: Column) -> Column:
    """A sum of 64-bit integers modulo 2^64, of fewer than 2^31 of them; the halves are summed, as a sum of the whole fails at an overflow."""
    return _halves(F.sum(F.shiftright(number, 32)), F.sum(number.bitwiseAND(F.lit(0xFFFFFFFF))))


def _wrapped_plus(a: Column, b: Column) -> Column:
    low = F.lit(0xFFFFFFFF)
    return _halves(F.shiftright(a, 32) + F.shiftright(b, 32), a.bitwiseAND(low) + b.bitwiseAND(low))


def is_i64(value: Column) -> Column:
    return F.octet_length(value) == 8


def load_i64(value: Column) -> Column:
    """8 bytes, big-endian, as a signed integer; another length fails."""
    number = F.conv(F.hex(value), 16, -10).cast("long")
    return F.when(value.isNotNull(), F.when(is_i64(value), number).otherwise(F.raise_error(F.lit("counter operand is not 8 bytes")).cast("long")))


def store_i64(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _concat(values: Column) -> Column:
    return F.array_join(values, "")


#: Sums of plain integers; an overflow fails, as in any Spark sum.
COUNTER = Merge("counter", lambda s, v: F.sum(v), _both(lambda a, b: a + b))
#: Wrapping sums of 8-byte big-endian integers.
COUNTER_I64 = Merge("counter_i64", lambda s, v: wrapped_sum(v), _both(_wrapped_plus), load_i64, store_i64, fits=is_i64)
#: Text after text, oldest first.
APPEND = Merge("append", lambda s, v: F.when(F.count(v) > 0, _concat(ordered_list(s, v))), _both(F.concat), ordered=True)
#: Bytes after bytes, oldest first (hexadecimal while folding, as only strings have array_join).
APPEND_BYTES = Merge("append_bytes", lambda s, v: F.when(F.count(v) > 0, _concat(ordered_list(s, v))), _both(F.concat), F.hex, F.unhex, ordered=True)
MAX = Merge("max", lambda s, v: F.max(v), _both(F.greatest))
MIN = Merge("min", lambda s, v: F.min(v), _both(F.least))
LAST = Merge("last", lambda s, v: F.max_by(v, F.when(v.isNotNull(), s)), lambda a, b: F.coalesce(b, a), ordered=True)
#: Comma-separated sets, sorted.
SET_UNION = Merge(
    "set_union",
    lambda s, v: F.when(F.count(v) > 0, F.array_sort(F.array_distinct(F.flatten(F.collect_list(v))))),
    _both(lambda a, b: F.array_sort(F.array_union(a, b))),
    lambda v: F.split(v, ","),
    lambda v: F.array_join(v, ","),
)
BUILT_IN = {m.name: m for m in (COUNTER, COUNTER_I64, APPEND, APPEND_BYTES, MAX, MIN, LAST, SET_UNION)}
