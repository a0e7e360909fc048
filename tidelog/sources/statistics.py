"""Counters and summaries of a database handle."""

from __future__ import annotations

import threading
import time
from collections import Counter
from contextlib import contextmanager

from tidelog.errors import InvalidArgument

#: What is counted. A run is a flush, a manifest edit stands for the log; there is no block cache, and Parquet doesn't tell of its filters: those stay 0.
TICKERS = (
    "bytes_written", "bytes_read", "keys_written", "keys_read", "keys_deleted", "range_deletes_written", "merges_written", "block_cache_hit", "block_cache_miss",
    "block_cache_add", "bloom_filter_useful", "bloom_filter_full_positive", "compaction_bytes_read", "compaction_bytes_written", "compaction_count", "flush_bytes_written",
    "flush_count", "wal_bytes_written", "wal_sync_count", "iter_seek_count", "iter_next_count", "write_stall_micros", "snapshots_registered", "snapshots_released", "wal_tail_discarded",
)
#: What is summarised: microseconds, or bytes.
HISTOGRAMS = (
    "db_get", "db_write", "db_iter_seek", "db_iter_next", "compaction_time", "flush_time", "block_read_time", "bytes_per_read", "bytes_per_write", "wal_write_time",
)


class Statistics:
    def __init__(self):
        self.lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self.lock:
            self.tickers: Counter = Counter()
            self.summaries: dict[str, tuple[int, int, int, int]] = {}  # count, sum, least, most

    def count(self, **more: int) -> None:
        if unknown := set(more).difference(TICKERS):
            raise InvalidArgument(f"ticker {unknown}")
        with self.lock:
            self.tickers.update(more)

    def record(self, name: str, value: int) -> None:
        if name not in HISTOGRAMS:
            raise InvalidArgument(f"histogram {name}")
        with self.lock:
            n, total, least, most = self.summaries.get(name, (0, 0, value, value))
            self.summaries[name] = (n + 1, total + value, min(least, value), max(most, value))

    def get_ticker(self, name: str) -> int:
        if name not in TICKERS:
            raise InvalidArgument(f"ticker {name}")
        return self.tickers[name]

    def get_histogram_snapshot(self, name: str) -> dict[str, int]:
        if name not in HISTOGRAMS:
            raise InvalidArgument(f"histogram {name}")
        n, total, least, most = self.summaries.get(name, (0, 0, 0, 0))
        return {"count": n, "sum": total, "min": least, "max": most, "average": total // n if n else 0}

    def dump(self) -> dict:
        return {"tickers": {k: self.tickers[k] for k in TICKERS}, "histograms": {k: self.get_histogram_snapshot(k) for k in HISTOGRAMS}}

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        yield
        self.record(name, int((time.perf_counter() - began) * 1e6))
