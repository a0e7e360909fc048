"""Failures of the engine, each a class of its own."""

from __future__ import annotations


class Error(Exception):
    """Any failure of the engine."""


class InvalidArgument(Error, ValueError):
    """A parameter that the contract forbids."""


class Corruption(Error):
    """Stored data that contradicts the manifest."""


class ReadOnly(Error):
    """A change through a read-only handle."""


class Closed(Error):
    """Use of a closed handle."""


class InvalidColumnFamily(Error):
    """A column family that is unknown, dropped or may not be changed."""


class Busy(Error):
    """Another writer, lock or snapshot is in the way."""


class MergeFailed(Error):
    """A merge operator gave no value, or there is none."""


class Conflict(Error):
    """A transaction lost: ``key`` changed at ``latest`` after it was observed at ``observed``."""

    def __init__(self, key: bytes, observed: int, latest: int):
        super().__init__(f"{key!r} changed at {latest}, observed at {observed}")
        self.key, self.observed, self.latest = key, observed, latest


class NoSavepoint(Error):
    """A rollback without a savepoint."""


class UnsupportedRangeDelete(Error):
    """A range delete inside a transaction."""
