"""The keys of an ingested table in buckets, so that a batch finds its duplicates without moving the table.

A table of keys lies beside the target, cut into buckets by a hash of the key. Each batch
appends its own keys. What arrives is shuffled to the same buckets and joined there: the
side of the target is read, a few columns wide, but never exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywright.dialects import column_type
from ferrywright.functions.predicates import all_present
from ferrywright.spec import TableSpec, spark_type

BATCH = "_batch"


@dataclass(frozen=True)
class KeyIndex:
    """The index of one key of a table. `buckets` is fixed with the first batch.

    Take at least as many buckets as a shuffle has partitions; with fewer, Spark may rather
    shuffle both sides.
    """

    path: str
    table: TableSpec
    key: tuple[str, ...]
    buckets: int = 200

    @property
    def name(self) -> str:
        """Its name in the catalog, which forgets it with the session; the files stay."""
        return f"ferrywright_keys_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"

    def register(self, spark: SparkSession) -> None:
        types = [(k, spark_type(column_type(self.table, self.table.column(k))).simpleString()) for k in self.key]
        columns = ", ".join([*(f"{_tick(k)} {kind}" for k, kind in types), f"{BATCH} bigint"])
        keys = ", ".join(_tick(k) for k in self.key)
        place = self.path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def held(self, spark: SparkSession, batch: int) -> DataFrame:
        """The keys of all batches but this one, which may be a repetition."""
        self.register(spark)
        # Batches run in a session of their own; this one may remember an older list of files.
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name).filter(F.col(BATCH) != batch).select(*self.key)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the keys of a batch's rows; NULL keys collide with nothing and are left out.

        A repeated batch adds its keys again, which tells later batches nothing new.
        """
        self.register(rows.sparkSession)
        keys = rows.filter(all_present(self.key)).select(*self.key, F.lit(batch).cast("long").alias(BATCH))
        # A file per bucket and batch.
        keys.repartition(self.buckets, *self.key).write.insertInto(self.name)


def indexes(folder: str, table: TableSpec, buckets: int = 200) -> list[KeyIndex]:
    """An index for the primary key and one for each unique key of a table, below a folder."""
    keys = [k for k in (table.primary_key, *table.unique_keys) if k]
    return [KeyIndex(f"{folder.rstrip('/')}/{'-'.join(k).lower()}", table, tuple(k), buckets) for k in keys]


def held_keys(spark: SparkSession, found: Sequence[KeyIndex], batch: int) -> dict[tuple[str, ...], DataFrame]:
    """What `plans.load.check_table` takes for `held`."""
    return {tuple(k.lower() for k in index.key): index.held(spark, batch) for index in found}


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
