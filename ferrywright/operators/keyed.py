"""Attach per-key facts to rows when some keys are very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.functions.predicates import all_present, conjunction
from ferrywright.session import stage

# A key with this many rows is spread over tasks instead of meeting in one.
HOT_ROWS = 100_000
# Most hot keys that are broadcast: the size bound of that broadcast, not a cap on results.
MAX_HOT_KEYS = 10_000
_SALTS = 4096


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    fact: Column,
    name: str,
    weight: str,
    hot_rows: int = HOT_ROWS,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Left join of `rows` with one fact per key; `name` is NULL where there is none.

    `facts` has one row per key and says in `weight` how many rows share it. They are
    staged first, so the planner knows their real size: without any the rows pass through,
    and few enough are broadcast, so that the rows do not move either. Otherwise both sides are shuffled by key, and then a frequent
    key must not end up in one task: the most frequent keys are looked up in a broadcast
    map of at most `MAX_HOT_KEYS` entries, and their rows, like rows without a key, take a
    salt no fact has. The result does not depend on which way a key took.

    `spread_by` names columns that tell rows apart; without it the salt is made of the
    whole row, so all of it has to be read.
    """
    # The salt of the facts is stored with them: a literal would be folded out of the join key.
    fact_keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    stored = stage(facts.select(*fact_keys, fact.alias("_fact"), weight, F.lit(0).alias("_zero")), "facts")
    heaviest = stored.agg(F.max(weight)).first()[0]
    nothing = F.lit(None).cast(stored.schema["_fact"].dataType)
    if heaviest is None:
        return rows.withColumn(name, nothing)
    if heaviest < hot_rows:
        looked_up = rows.withColumn("_hot", F.when(F.lit(False), F.struct(nothing.alias("_fact"))))
    else:
        top = stored.filter(F.col(weight) >= hot_rows).orderBy(F.desc(weight)).limit(MAX_HOT_KEYS)
        top = top.select(*[F.col(f"_k{i}").alias(f"_h{i}") for i in range(len(keys))], F.struct("_fact").alias("_hot"))
        same = conjunction([F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)])
        looked_up = rows.join(F.broadcast(top), same, "left")

    spread = F.lit(1) + F.pmod(_row_hash(rows, spread_by), F.lit(_SALTS)).cast("int")
    settled = F.col("_hot").isNotNull() | ~all_present(keys)
    salted = looked_up.withColumn("_salt", F.when(settled, spread).otherwise(0))
    cold = stored.drop(weight)
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_zero")]
    joined = salted.join(cold, conjunction(on), "left")
    value = F.when(F.col("_hot").isNotNull(), F.col("_hot._fact")).otherwise(F.col("_fact"))
    return joined.select(*[F.col(c) for c in rows.columns], value.alias(name))


def _row_hash(rows: DataFrame, spread_by: Sequence[str]) -> Column:
    """A hash that differs between rows and is the same when a task is repeated."""
    if spread_by:
        return F.xxhash64(*spread_by)
    # The number of its input partition separates exact copies, whatever their order.
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.spark_partition_id(), *hashable)
