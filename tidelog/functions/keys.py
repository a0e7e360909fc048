"""Key helpers: order is unsigned by byte, a proper prefix sorts first; any byte string, the empty one too, is a key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_successor(prefix):
    """The shortest key above every key that starts with ``prefix``, bytes or text; None if there is no bound (empty, or all the greatest)."""
    if isinstance(prefix, str):
        kept = prefix.rstrip(chr(0x10FFFF))
        following = ord(kept[-1]) + 1 if kept else 0
        return kept[:-1] + chr(following if not 0xD800 <= following < 0xE000 else 0xE000) if kept else None
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def in_range(key: Column, start=None, end=None) -> Column:
    """``start <= key < end``; None is unbounded. Plain comparisons with literals, so that they reach the Parquet scan."""
    test = F.lit(True)
    if start is not None:
        test = key >= F.lit(start)
    if end is not None:
        test = test & (key < F.lit(end)) if start is not None else key < F.lit(end)
    return test


def has_prefix(key: Column, prefix: bytes) -> Column:
    return in_range(key, prefix or None, prefix_successor(prefix))


@dataclass(frozen=True)
class PrefixExtractor:
    """What runs index keys by for scans by prefix.

    ``extract`` gives a key's prefix, null if it has none; ``query`` the prefix that every key which starts with the asked bytes has, None if
    there is no such one: then runs can't be passed over.
    """

    name: str
    extract: Callable[[Column], Column]
    query: Callable[[bytes], bytes | None]


def fixed_length_prefix(n: int) -> PrefixExtractor:
    """The first ``n`` bytes of a key; shorter keys have none."""
    return PrefixExtractor(f"fixed_length_prefix({n})", lambda key: F.when(F.octet_length(key) >= n, F.substring(key, 1, n)), lambda asked: asked[:n] if len(asked) >= n else None)


def padded(number: Column, width: int = 12) -> Column:
    """A number as a string key whose order is the number's."""
    return F.lpad(number.cast("string"), width, "0")
