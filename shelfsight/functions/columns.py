"""Column-expression helpers.

All helpers return native Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen and never block predicate pushdown. Helpers that
parse text are null-safe and never raise under ANSI mode: invalid input
becomes NULL (``try_cast``, ``try_to_timestamp``, ``try_divide``, ``get``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def as_double(df: DataFrame, name: str) -> Column:
    """Measure column as DOUBLE.

    Text input may carry thousands separators (``1,333.50``); they are
    removed with a native ``regexp_replace`` before a ``try_cast``, so a bad
    cell becomes NULL instead of failing the job. Numeric input is cast.
    """
    c = F.col(f"`{name}`")
    if _is_string(df, name):
        return F.regexp_replace(c, ",", "").try_cast("double")
    return c.cast("double")


def as_int(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if _is_string(df, name):
        return F.regexp_replace(c, ",", "").try_cast("int")
    return c.cast("int")


def day_of(df: DataFrame, name: str, fmt: str) -> Column:
    """Calendar day of a column: text parsed with ``fmt`` (NULL when it does
    not parse), timestamps truncated to their date, dates unchanged."""
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if isinstance(dt, StringType):
        return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dt, DateType):
        return c
    return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit(fmt)))


def id_of(c: Column, sep: str = "-") -> Column:
    """Token 0 of an ``id-name`` string."""
    return F.get(F.split(c, sep), 0)


def name_of(c: Column, sep: str = "-") -> Column:
    """Token 1 of an ``id-name`` string (NULL when there is no separator).

    A name that itself contains the separator is truncated at it, as in the
    reference's cleaning."""
    return F.get(F.split(c, sep), 1)


def mat_id(c: Column) -> Column:
    """Material id from item text such as ``NZDF12345-Name``: token 0 with the
    store-prefix letters removed, as INT (NULL when not numeric)."""
    return F.regexp_replace(id_of(c), "[ZNDF]", "").try_cast("int")


def iso_week(c: Column) -> Column:
    """ISO week key ``yyyyWww`` of a date (2018-12-31 -> ``2019W01``)."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), c).cast("string"),
        F.lit("W"),
        F.lpad(F.extract(F.lit("WEEK"), c).cast("string"), 2, "0"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(a, b)


def snap_to_zero(c: Column) -> Column:
    """Values strictly between -1 and 1 become 0 (opt-in cleaning step)."""
    return F.when(F.abs(c) < 1, F.lit(0.0)).otherwise(c)


def flag_text(c: Column) -> Column:
    """BOOLEAN flag rendered for export: 'True' / 'False' / '' for NULL."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit(""))


def round4(c: Column) -> Column:
    """Round to 4 decimals as ``round(x * 1e4 + 1e-3) / 1e4``.

    Used only at the result boundary of the checked queries so that the
    Spark result and the SQL oracle apply the identical double arithmetic.
    The small shift moves the rounding boundary off exact decimal halves
    (common with cent-valued data), where last-bit differences from
    summation order would otherwise flip the rounded digit. The final
    ``+ 0.0`` turns a negative zero into zero."""
    return F.round(c * F.lit(10000.0) + F.lit(0.001), 0) / F.lit(10000.0) + F.lit(0.0)
