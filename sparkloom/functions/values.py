"""Column expressions for values as charts read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A finite decimal number as a chart may get it in text.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_blank(value: Column) -> Column:
    """Null or the empty text: what charts treat as no value."""
    return value.isNull() | (value.cast("string") == "")


def to_number(value: Column) -> Column:
    """A finite number, or a text that is one; null otherwise. Words like Infinity or 12d are no numbers."""
    text = value.cast("string")
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def key_text(value: Column) -> Column:
    """A group's key as text: whole numbers without a decimal point."""
    number = value.cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, F.format_string("%d", number.cast("long"))).otherwise(value.cast("string"))


def half_even(value: Column, digits: int) -> Column:
    """Rounds ties to the even digit."""
    return F.bround(value, digits)


def round_stored(value: Column, digits: int) -> Column:
    """Rounds a double as it is stored, halves away from zero; round() would take its shortest decimal text instead."""
    scaled = F.abs(value) * 10.0**digits
    whole = F.floor(scaled)
    return F.signum(value) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**digits


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two digits, null when whole is 0."""
    return F.bround(F.try_divide(100.0 * part, whole.cast("double")), 2)


def distinct_counts(df: DataFrame, columns: list[str], skip_blank: bool = False) -> DataFrame:
    """column, distinct: how many values each column has, nulls (and blanks) left out.

    Cells are counted as (column, value) pairs, so a row is sent once for each of its new values, not once for each column."""
    def text(c: str) -> Column:
        v = F.col(f"`{c}`")
        v = v + 0.0 if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else v  # 0 and -0 are one value
        return F.when(~is_blank(v), v.cast("string")) if skip_blank else v.cast("string")

    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns]))).filter("value IS NOT NULL")
    return cells.distinct().groupBy("column").agg(F.count("*").alias("distinct"))


def at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df, if it has that many rows at most; else ValueError. Few rows more are read to know."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return df
