"""Result boundary for checked queries.

``finalize`` renders a result in an engine-neutral form so that a Spark
result and an equivalent SQL result can be compared value by value: doubles
rounded to 4 decimals, dates as ``yyyy-MM-dd`` text, arrays as comma text,
flags as ``'True'/'False'/''`` (the export format of the reports).
It is a projection only (no row is added, dropped or reordered).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, FloatType

from shelfsight.functions.columns import flag_text, round4


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (DoubleType, FloatType)):
            c = round4(c.cast("double"))
        elif isinstance(t, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, BooleanType):
            c = flag_text(c)
        elif isinstance(t, ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)
