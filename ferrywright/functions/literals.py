"""Values as CSV fields and as SQL literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywright.dialects import family
from ferrywright.functions import values as V


def csv_field(c: Column, sep: str = ",", quote: str = '"', marker: str = V.NULL_MARKER) -> Column:
    """One CSV field: marker for NULL, quoted with doubled quotes where needed."""
    doubled = F.replace(c, F.lit(quote), F.lit(quote * 2))
    quoted = F.concat(F.lit(quote), doubled, F.lit(quote))
    return F.when(c.isNull(), F.lit(marker)).when(V.needs_quote(c, sep, quote), quoted).otherwise(c)


def sql_literal(c: Column, dialect: str = "postgres", marker: str = V.NULL_MARKER) -> Column:
    """Literal of untyped text: marker and NULL as NULL, numeric text bare, the rest quoted."""
    return (
        F.when(c.isNull() | V.is_marker(c, marker), F.lit("NULL"))
        .when(V.is_numeric_text(c), c)
        .otherwise(_quoted(c, dialect))
    )


def typed_literal(c: Column, dtype: T.DataType, dialect: str = "postgres") -> Column:
    """Literal of a typed column: the type decides about quotes, so '007' keeps its zeros."""
    null = F.lit("NULL")
    if isinstance(dtype, T.NumericType):
        text = V.value_text(c, dtype)
        # NaN and the infinities have no bare spelling.
        special = F.coalesce(text.rlike("[A-Z]"), F.lit(False))
        return F.when(c.isNull(), null).when(special, _quoted(text, dialect)).otherwise(text)
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), null).when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    if isinstance(dtype, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        fraction = F.date_format(c, ".SSSSSS")
        text = F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
    else:
        text = V.value_text(c, dtype)
    return F.when(c.isNull(), null).otherwise(_quoted(text, dialect))


def _quoted(c: Column, dialect: str) -> Column:
    body = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    if family(dialect) == "oracle":
        # An empty text is NULL there.
        return F.when(c == "", F.lit("NULL")).otherwise(body)
    return body
