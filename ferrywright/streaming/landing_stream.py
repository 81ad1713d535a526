"""Incremental ingest of landing files: every file is loaded exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions import values as V
from ferrywright.operators import checks
from ferrywright.plans.load import Transforms, check_table
from ferrywright.session import run_scratch, stage
from ferrywright.sources.landing import CORRUPT, CsvLayout
from ferrywright.spec import TableSpec
from ferrywright.streaming.key_index import KeyIndex, held_keys

BATCH = "batch_id"


def stream_landing(
    spark: SparkSession, path: str, columns: Iterable[str], layout: CsvLayout = CsvLayout(), max_files: int | None = None
) -> DataFrame:
    """Unbounded frame of landing rows, every column text, plus `_corrupt`."""
    names = list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = spark.readStream.schema(schema).options(**layout.read_options())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    good = F.col(CORRUPT).isNull()
    text = [
        F.when(good, V.marker_to_null(F.coalesce(F.col(n), F.lit("")), layout.marker_of(n))).alias(n) for n in names
    ]
    return reader.csv(path).select(*text, CORRUPT)


def ingest_new_files(
    spark: SparkSession,
    path: str,
    table: TableSpec,
    target: str,
    rejects: str,
    checkpoint: str,
    steps: Transforms = Transforms(),
    layout: CsvLayout = CsvLayout(),
    max_files: int | None = None,
    key: tuple[str, ...] = (),
    parents: Mapping[str, DataFrame] | None = None,
    check_parents: bool = True,
    index: Sequence[KeyIndex] = (),
) -> None:
    """Load the files that arrived since the last call, then return.

    The checkpoint remembers which files were taken. A batch writes its own
    `batch_id=...` partition and replaces it when it is repeated after a failure, so a
    row arrives once even if the job dies between writing and committing. Keys and
    references are checked within the batch and against what other batches have written.
    A new checkpoint would count batches from zero again, so it needs an empty target.

    With an `index`, one for the primary key and for each unique key as `key_index.indexes`
    makes them, keys are looked up in their buckets instead of in the target. It has to be
    kept from the first batch on.
    """
    if not _holds(spark, f"{checkpoint.rstrip('/')}/metadata") and _holds(spark, f"{target.rstrip('/')}/{BATCH}=*"):
        raise ValueError(f"{target} holds rows of an earlier checkpoint; go on with that one or take an empty target")
    for one in index:
        if _holds(spark, f"{target.rstrip('/')}/{BATCH}=*") and not _holds(spark, one.path):
            raise ValueError(f"{target} holds rows that the index {one.path} does not know")
    names = [c.name for c in table.ordered()]
    row_key = key or table.primary_key or tuple(names)

    def load(batch: DataFrame, batch_id: int) -> None:
        held = None
        known = held_keys(spark, index, batch_id) if index else None
        if not index and _holds(spark, f"{target.rstrip('/')}/{BATCH}=*"):
            held = spark.read.parquet(target).filter(F.col(BATCH) != batch_id).drop(BATCH)
        with run_scratch(spark):
            # Staged, so both outputs come from one parse of the new files.
            checked = stage(check_table(batch, table, steps, parents, existing=held, check_parents=check_parents, held=known), "ingest")
            _replace_batch(checks.accepted(checked).select(*names), target, batch_id)
            _replace_batch(checks.rejects(checked, row_key, table), rejects, batch_id)
            # Last, so that a batch that dies before is repeated with its keys still unknown.
            for one in index:
                one.append(checks.accepted(checked), batch_id)

    _run(stream_landing(spark, path, names, layout, max_files), load, checkpoint)


def _holds(spark: SparkSession, pattern: str) -> bool:
    """Whether something lies under the path, through the file system that holds it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(place))


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def _run(stream: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """Everything ingested so far, without the batch tag."""
    return spark.read.parquet(path).drop(BATCH)
