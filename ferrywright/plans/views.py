"""Views and materialised views over migrated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A named query; Spark plans it anew for every reader."""
    df = spark.sql(query)
    df.createOrReplaceTempView(name)
    return spark.table(name)


def refresh_materialized(spark: SparkSession, query: str, path: str) -> DataFrame:
    """COMPLETE refresh: run the query, replace the stored result, return it."""
    df = spark.sql(query)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def well_paid(emp: DataFrame, dept: DataFrame, above: float = 1000) -> DataFrame:
    """Employees with their department's name, salary above a limit."""
    return (
        emp.filter(F.col("sal") > above)
        .join(dept.select("deptno", "dname"), "deptno")
        .select("empno", "ename", "job", "sal", "dname")
    )
