"""Types at the outer edge: whole numbers as bigint, money as double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edge(df: DataFrame, **rounded: int) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        if f.name in rounded:
            c = F.round(c, rounded[f.name])
        cols.append(c.alias(f.name))
    return df.select(*cols)
