"""Column profiles that are kept per file and merged for any set of files.

Each file of a table is read once, when it arrives; what is kept of a column is its rows
and NULLs, and three sketches of bounded size: of its different values, of its quantiles
and of its frequent values. The profile of the table, of some files or of several tables
together is made from these rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions import values as V
from ferrywright.operators.report import union_all
from ferrywright.session import discard, stage

# Different values: 2^12 registers, a standard error of 1.6 %.
LG_REGISTERS = 12
DISTINCT_ERROR = 0.05
# Quantiles: the rank of an estimate is off by at most this share of the rows, in 99 of 100 cases.
QUANTILE_K = 200
RANK_ERROR = 0.0265
# Frequent values: so many counters; a value on more than 1 / (0.75 * TRACKED) of the rows of the whole is never missed.
TRACKED = 1024
# Longer texts are no candidates for frequent values.
LONGEST = 128
# Paths are written with one slash behind the scheme or with three.
_SLASHES = "^([A-Za-z0-9+.-]+):/+"


def file_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(file, column, type, rows, nulls, different, quantiles, frequent), a row per file and column of a scan.

    `quantiles` is that of numbers, dates as days and timestamps as seconds, and without
    values for other types. One pass; a group per file, whatever its size.
    """
    parts, values = [], [F.col("_metadata.file_path").alias("file")]
    for i, f in enumerate(df.schema.fields):
        if columns is not None and f.name not in columns:
            continue
        # Made ahead of the aggregate, once for all sketches that take them.
        null, text, number = (F.col(f"{kind}{i}") for kind in ("null", "text", "number"))
        own = F.col(f.name)
        values += [own.isNull().alias(f"null{i}"), V.value_text(own, f.dataType).alias(f"text{i}"), _number(own, f.dataType).alias(f"number{i}")]
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(null).alias("nulls"),
                F.hll_sketch_agg(text, LG_REGISTERS).alias("different"),
                F.kll_sketch_agg_double(number, QUANTILE_K).alias("quantiles"),
                F.call_function("approx_top_k_accumulate", F.when(F.char_length(text) <= LONGEST, text), F.lit(TRACKED)).alias("frequent"),
            )
        )
    per_file = df.select(*values).groupBy("file").agg(F.array(*parts).alias("columns"))
    return per_file.select(F.regexp_replace("file", _SLASHES, "$1:/").alias("file"), F.inline("columns"))


def _number(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        # NaN has no rank.
        return F.nullif(c.cast("double"), F.lit(float("nan")))
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return F.lit(None).cast("double")


def sketch_new_files(spark: SparkSession, path: str, store: str) -> int:
    """Add the files of a Parquet table that `store` does not know yet; returns how many there were.

    Files are told by their paths: they must not be written anew under the same name. The
    rows are written by one job, so a call that dies leaves nothing of itself to be read.
    """
    table = spark.read.parquet(path)
    there = {re.sub(_SLASHES, r"\1:/", f): f for f in table.inputFiles()}
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    known = set()
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        known = {r.file for r in spark.read.parquet(store).select("file").distinct().collect()}
    new = sorted(set(there) - known)
    if new:
        found = file_sketches(spark.read.schema(table.schema).parquet(*[there[f] for f in new]))
        # A file without rows is known, too.
        seen = stage(found, "sketches")
        empty = set(new) - {r.file for r in seen.select("file").distinct().collect()}
        rows = [seen]
        if empty:
            none = spark.createDataFrame([(f,) for f in sorted(empty)], "file string")
            rows.append(none.select(*[F.col("file") if f.name == "file" else F.lit(None).cast(f.dataType).alias(f.name) for f in seen.schema]))
        union_all(rows).write.mode("append").parquet(store)
        discard(seen)
    return len(new)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column, or per column and `by`, from the sketches of any files."""
    known = sketches.filter(F.col("column").isNotNull())
    return known.groupBy(*by, "column").agg(
        F.max("type").alias("type"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def profile_of(merged: DataFrame, quantiles: Sequence[float] = (0.05, 0.5, 0.95), top: int = 5) -> DataFrame:
    """The numbers behind merged sketches: rows, nulls, distinct, quantiles (null without numbers) and frequent values.

    distinct is within DISTINCT_ERROR of the truth, a quantile has a rank within RANK_ERROR
    of the one asked for, and a count in `frequent` is an estimate.
    """
    numbers = F.kll_sketch_get_n_double("quantiles") > 0
    asked = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))) for q in quantiles])
    return merged.select(
        *[c for c in merged.columns if c not in ("different", "quantiles", "frequent")],
        F.hll_sketch_estimate("different").alias("distinct"),
        F.when(numbers, asked).alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top)).alias("frequent"),
    )
