"""Backups as relations: files of backups (backup_id, file_id, hash, size) and the shared store of distinct contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_files(files: DataFrame) -> DataFrame:
    """One row per content: what the shared store holds."""
    return files.groupBy("hash").agg(F.min("size").alias("size"), F.min("backup_id").alias("first_backup"), F.count("*").alias("uses"))


def to_copy(files: DataFrame, shared: DataFrame) -> DataFrame:
    """Contents of a new backup that the shared store lacks."""
    return files.dropDuplicates(["hash"]).join(shared.select("hash"), "hash", "left_anti")


def listed(files: DataFrame) -> DataFrame:
    return files.groupBy("backup_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def purged(files: DataFrame, keep: int) -> DataFrame:
    """Files of the newest ``keep`` backups."""
    newest = files.select("backup_id").distinct().orderBy(F.desc("backup_id")).limit(keep)
    return files.join(F.broadcast(newest), "backup_id", "left_semi")  # at most ``keep`` rows


def unreferenced(shared: DataFrame, files: DataFrame) -> DataFrame:
    """Contents (hash) of the shared store that no remaining backup refers to."""
    return shared.join(files.select("hash"), "hash", "left_anti")
