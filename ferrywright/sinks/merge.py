"""Parquet targets that are merged by copying only the files that change.

The files of such a target hold disjoint ranges of the key. A manifest lists them with
their ranges; it is the table's only truth: a reader takes the files of the newest one. A
merge looks up which file's range each changed key falls into, writes those files anew
beside the old ones, and publishes a manifest that names the new files in place of the
old. It takes effect with the creation of one small file, which either happens or not; a
merge that dies before leaves the table as it was, and some files that nobody names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions.predicates import all_present
from ferrywright.operators.checks import duplicate_keys
from ferrywright.session import discard, stage

FILE_ROWS = 1_000_000
# The driver holds a name per file, the tasks the ranges; larger directories are refused.
MOST_FILES = 1_000_000
_HOME = "_home"


class MergeConflict(RuntimeError):
    """Another merge was published first; nothing was changed."""


def create_files(df: DataFrame, path: str, keys: Sequence[str], file_rows: int = FILE_ROWS) -> None:
    """Write a new target, in files of key order. Keys must be unique and not NULL."""
    if _markers(df.sparkSession, path):
        raise ValueError(f"{path} holds a table already")
    _require_keys(df, keys)
    df.limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_schema")
    _publish(_write(df.withColumn(_HOME, F.lit(0)), path, keys, file_rows), path, 1)


def directory(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, rows, low, high) of every file of the newest or a given version; low and high are structs of the key."""
    published = {v: name for v, name in _markers(spark, path).items() if name}
    if not published:
        raise ValueError(f"{path} holds no table")
    return spark.read.parquet(f"{path.rstrip('/')}/_manifests/{published[version or max(published)]}")


def read_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest or a given version."""
    return _of_files(spark, path, [r.file for r in directory(spark, path, version).select("file").collect()])


def merge_files(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    deleted: DataFrame | None = None,
    file_rows: int = FILE_ROWS,
) -> list[str]:
    """Put `changes` in place of the rows with their keys, add those that are new, and take the `deleted` keys out.

    Returns the files that were replaced. `changes` has the columns of the table and each
    key once; a key both changed and deleted is an error. Files whose range holds no such
    key keep their names and are not read.
    """
    spark = changes.sparkSession
    markers = _markers(spark, path)
    if markers and not markers[max(markers)]:
        raise MergeConflict(f"version {max(markers)} of {path} is being published")
    listed = directory(spark, path)
    # A name per file, at most MOST_FILES; a file's place in this order is its home number.
    files = [r.file for r in listed.orderBy("low").select("file").collect()]
    schema = _of_files(spark, path, files[:1]).schema
    changes = stage(changes.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), "changes")
    _require_keys(changes, keys)
    touched = changes.select(*keys)
    if deleted is not None:
        gone = deleted.select(*[F.col(k).cast(schema[k].dataType) for k in keys]).distinct()
        if not changes.join(gone, list(keys), "left_semi").isEmpty():
            raise ValueError("keys are both changed and deleted")
        touched = touched.unionByName(gone)
    homes = stage(_with_home(touched, listed, len(files), keys), "homes")
    places = sorted(r[0] for r in homes.select(_HOME).distinct().collect())
    replaced = [files[p] for p in places if files]
    if not places:
        discard(changes, homes)
        return []
    merged = changes.join(homes, list(keys))
    if replaced:
        numbers = spark.createDataFrame(list(zip(replaced, places)), f"_file string, {_HOME} int")
        held = _of_files(spark, path, replaced).select("*", _file_name().alias("_file"))
        # A row per replaced file, at most MOST_FILES.
        held = held.join(F.broadcast(numbers), "_file").drop("_file").join(homes.select(*keys), list(keys), "left_anti")
        merged = merged.unionByName(held)
        listed = listed.join(F.broadcast(numbers.select(F.col("_file").alias("file"))), "file", "left_anti")
    entries = _write(merged.select(*schema.names, _HOME), path, keys, file_rows)
    _publish(listed.unionByName(entries), path, max(markers) + 1)
    discard(changes, homes)
    return sorted(replaced)


def unnamed_files(spark: SparkSession, path: str) -> list[str]:
    """Data files that no version names: left behind by merges that died or lost."""
    versions = [v for v, name in _markers(spark, path).items() if name]
    named = {r.file for v in versions for r in directory(spark, path, v).select("file").collect()}
    fs, at = _place(spark, f"{path.rstrip('/')}/data")
    there, found = [], fs.listFiles(at, True) if fs.exists(at) else None
    while found is not None and found.hasNext():
        there.append(found.next().getPath().toString().partition("/data/")[2])
    return sorted(f for f in there if f.endswith(".parquet") and f not in named)


def _require_keys(df: DataFrame, keys: Sequence[str]) -> None:
    if not df.filter(~all_present(keys)).isEmpty():
        raise ValueError(f"a key of {list(keys)} is NULL")
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"a key of {list(keys)} occurs twice")


def _with_home(rows: DataFrame, listed: DataFrame, files: int, keys: Sequence[str]) -> DataFrame:
    """Keys with the number of their home: the last file that begins at or before them, or the first of all.

    The starts of the files are searched in two steps, blocks first and then the files of
    one block, so that a key is compared with about twice the root of their number.
    """
    key = F.struct(*keys)
    if files < 2:
        return rows.select(*keys, F.lit(0).alias(_HOME))
    size = math.isqrt(files - 1) + 1
    # Starts in order, `size` to a block; there is one row, then one per block.
    starts = listed.agg(F.array_sort(F.collect_list("low")).alias("lows")).select(
        F.posexplode(F.expr(f"transform(sequence(1, size(lows), {size}), i -> slice(lows, i, {size}))")).alias("_block", "_lows")
    )
    heads = starts.agg(F.array_sort(F.collect_list(F.col("_lows")[0]))).scalar()
    placed = rows.select(*keys, heads.alias("_heads"))
    placed = placed.select(*keys, F.greatest(F.lit(0), _at_or_before(F.col("_heads"), key) - 1).alias("_block"))
    return placed.join(F.broadcast(starts), "_block").select(
        *keys, (F.col("_block") * size + F.greatest(F.lit(0), _at_or_before(F.col("_lows"), key) - 1)).alias(_HOME)
    )


def _at_or_before(lows: Column, key: Column) -> Column:
    return F.size(F.filter(lows, lambda low: low <= key))


def _file_name() -> Column:
    return F.regexp_extract("_metadata.file_path", "/data/(.*)$", 1)


def _write(rows: DataFrame, path: str, keys: Sequence[str], file_rows: int) -> DataFrame:
    """Write rows in files that do not leave the range of their home, and return their directory entries."""
    spark, folder = rows.sparkSession, f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(_HOME, *keys).sortWithinPartitions(_HOME, *keys)
    # A folder per home keeps two homes out of one file.
    ordered.write.option("maxRecordsPerFile", file_rows).partitionBy(_HOME).parquet(folder)
    key, schema = F.struct(*keys), rows.drop(_HOME).schema
    written = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return written.groupBy(_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def _of_files(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    root = path.rstrip("/")
    schema = spark.read.parquet(f"{root}/_schema").schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{f}" for f in files])


def _publish(entries: DataFrame, path: str, version: int) -> None:
    """Write the manifest, then name it in a file that must not exist yet."""
    spark, root = entries.sparkSession, path.rstrip("/")
    manifest = f"{version:012d}-{uuid.uuid4().hex}"
    entries.write.parquet(f"{root}/_manifests/{manifest}")
    files = spark.read.parquet(f"{root}/_manifests/{manifest}").count()
    if files > MOST_FILES:
        raise ValueError(f"{files} files are too many for one directory; write larger ones")
    fs, at = _place(spark, f"{root}/_versions/{version:012d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise MergeConflict(f"version {version} of {path} is there already") from e
    # Readers pass over a marker that is still empty, writers wait for it.
    out.write(bytearray(manifest.encode()))
    out.close()


def _markers(spark: SparkSession, path: str) -> dict[int, str]:
    """The manifest of each version; empty while it is being published."""
    fs, at = _place(spark, f"{path.rstrip('/')}/_versions")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    texts = spark.read.option("wholetext", "true").text(f"{path.rstrip('/')}/_versions")
    named = {r.name: r.value for r in texts.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value").collect()}
    return {int(n): named.get(n, "") for n in names if n.isdigit()}


def _place(spark: SparkSession, path: str):
    """The file system that holds a path, and the path for it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place
