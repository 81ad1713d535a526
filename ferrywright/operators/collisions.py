"""Duplicate keys found by bitmaps, so that keys which are unique need not be shuffled.

Keys are given places, and a bitmap of 32,768 places is filled by the rows that fall into
it. A bitmap with fewer bits than rows has a place that was taken twice; all others are
free of duplicates. Only the rows of crowded bitmaps go on: to a second pass with other
places, which parts them from the rows that merely lay in the same bitmap, and then to a
grouping by the key itself.

Whole-number keys are their own places. Keys of one task that lie close together, as in a
table written in key order, fill few bitmaps, and a bit per key is moved instead of a key.
Other keys are placed by a hash: every task then fills bitmaps all over, and
`checks.duplicate_keys` is cheaper unless most rows can be ruled out at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions.predicates import all_present
from ferrywright.operators.checks import duplicate_keys
from ferrywright.session import stage

# Places per row for hashed keys: so many rows meet another one by chance as one in this number.
SPARSENESS = 32
_BITS = 32_768


def crowded_bitmaps(df: DataFrame, place: Column) -> DataFrame:
    """(bitmap) numbers of the bitmaps in which a place is taken more than once."""
    placed = df.select(F.bitmap_bucket_number(place).alias("bitmap"), F.bitmap_bit_position(place).alias("bit"))
    filled = placed.groupBy("bitmap").agg(
        F.count("bit").alias("rows"), F.bitmap_count(F.bitmap_construct_agg("bit")).alias("bits")
    )
    return filled.filter("rows > bits").select("bitmap")


def duplicates_by_bitmap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`checks.duplicate_keys`: keys that occur more than once and how often.

    Two passes over the key columns and, if they find anything, a third over the rows that
    are left. NULL keys group as equal; with whole-number keys they skip the bitmaps.
    """
    whole = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType)
    narrow = df.select(*keys)
    slots = None if whole else _slots(narrow.count())
    first = F.col(keys[0]).cast("long") if whole else _hashed(keys, "first", slots)
    rest, any_left = _survivors(narrow, first)
    if any_left:
        # The places of the second pass have nothing to do with those of the first.
        rest, any_left = _survivors(rest, _hashed(keys, "second", slots or _slots(rest.count())))
    left = [rest] if any_left else []
    if whole:
        left.append(narrow.filter(~all_present(keys)))
    found = [duplicate_keys(part, keys) for part in left]
    if not found:
        return df.sparkSession.createDataFrame([], T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType())]))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _slots(rows: int) -> int:
    return max(1, -(-rows * SPARSENESS // _BITS)) * _BITS


def _hashed(keys: Sequence[str], salt: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(slots)) + 1


def _survivors(rows: DataFrame, place: Column) -> tuple[DataFrame, bool]:
    """Rows in crowded bitmaps, and whether there are any."""
    crowded = stage(crowded_bitmaps(rows, place), "crowded")
    if crowded.isEmpty():
        return rows, False
    # A row per bitmap: broadcast where it is measured small.
    on = F.bitmap_bucket_number(place) == F.col("bitmap")
    return rows.join(crowded, on, "left_semi"), True
