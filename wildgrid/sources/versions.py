"""Stores whose tables change together, or not at all.

A version is a folder of Parquet tables that nobody has seen until its entry is published:
one line in a file of its own under ``versions``, which the committer of a write job puts in
place as its last step. A build that dies on the way leaves files without an entry; the
version before stays as it was. Readers look the folder up once and keep it, so a build may
read the version it replaces, and a reader is not disturbed by a newer one. Folders of old
versions are never touched; remove those that no reader needs with the tools of the storage.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wildgrid.sources.tables import write_table

ENTRY = "version bigint, folder string, tables array<string>"


def versions(spark: SparkSession, store: str) -> DataFrame:
    """Published versions: version, folder (relative to the store), tables."""
    try:
        return spark.read.schema(ENTRY).json(f"{store.rstrip('/')}/versions/*").filter("folder is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def latest(spark: SparkSession, store: str) -> int | None:
    """Number of the newest version; None for a store without any."""
    return versions(spark, store).agg({"version": "max"}).first()[0]


def read_version(spark: SparkSession, store: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the newest."""
    version = latest(spark, store) if version is None else version
    entries = [] if version is None else versions(spark, store).filter(f"version = {int(version)}").collect()
    if not entries:
        raise ValueError(f"no version {'' if version is None else f'{version} '}in {store}")
    if len(entries) > 1:
        raise ValueError(f"version {version} of {store} was published by {len(entries)} builds")
    folder = f"{store.rstrip('/')}/{entries[0].folder}"
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in entries[0].tables}


class Draft:
    """A version in the making: tables that are written but that no reader sees yet.

    ``after`` is the version it follows, by default the newest when the draft is begun.
    """

    def __init__(self, spark: SparkSession, store: str, after: int | None = None):
        self.spark, self.store = spark, store.rstrip("/")
        self.after = latest(spark, store) if after is None else after
        self.number = 0 if self.after is None else self.after + 1
        self.folder = f"data/{self.number:08d}-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def add(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> DataFrame:
        """Write a table; what was written, for tables that are made from it."""
        path = f"{self.store}/{self.folder}/{name}.parquet"
        write_table(df, path, sort_by=sort_by)
        self.tables.append(name)
        return self.spark.read.parquet(path)

    def publish(self) -> int:
        """Make the version the newest; its number.

        Where another build has published a version since, this one fails and stays unseen:
        its tables would lack what the other has added.
        """
        if latest(self.spark, self.store) != self.after:
            raise ValueError(f"{self.store} has a newer version than {self.after}")
        entry = self.spark.createDataFrame([(self.number, self.folder, self.tables)], ENTRY).coalesce(1)
        # An entry of that number is an error, not replaced.
        entry.write.mode("error").json(f"{self.store}/versions/{self.number:08d}")
        read_version(self.spark, self.store, self.number)
        return self.number


def publish(
    spark: SparkSession, store: str, tables: dict[str, DataFrame], sorting: dict[str, list[str]] | None = None
) -> int:
    """Write the tables as the next version; its number."""
    draft = Draft(spark, store)
    for name, df in tables.items():
        draft.add(name, df, (sorting or {}).get(name))
    return draft.publish()
