"""Table migration and conformance jobs on Spark: DataFrame in, DataFrame out."""

from ferrywright.session import build_session, configure, scratch_path
from ferrywright.spec import ColumnSpec, ForeignKey, LogicalType, TableSpec

__all__ = [
    "ColumnSpec",
    "ForeignKey",
    "LogicalType",
    "TableSpec",
    "build_session",
    "configure",
    "scratch_path",
]
