"""Results in a form two engines can agree on: rounded numbers and text dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def present(df: DataFrame, **digits: int) -> DataFrame:
    """Round doubles (6 digits, or as named), write dates as text, widen integers."""
    def shown(field: T.StructField) -> Column:
        col, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DoubleType):
            col = F.round(col, digits.get(field.name, DIGITS)) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.IntegerType, T.BooleanType)):
            col = col.cast("bigint")
        return col.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
