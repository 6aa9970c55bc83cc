"""Column expressions shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def artist_key(artist: Column) -> Column:
    return F.lower(strip(artist))


def track_key(artist: Column, track: Column) -> Column:
    """Lookup key of a track; null when either part is null."""
    return F.concat(artist_key(artist), F.lit("|||"), artist_key(track))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Integer division rounding down, so instants before 1970 fall in the right bucket."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, w), w)


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double, 0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def xlog2x(count: Column) -> Column:
    """c * log2(c) with the limit 0 at c = 0."""
    c = count.cast("double")
    return F.when(count > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def entropy_bits(total: Column, sum_xlog2x: Column, groups: Column) -> Column:
    """Shannon entropy in bits from N and the sum of c*log2(c): log2(N) - sum/N.

    Both inputs are plain sums, so the entropy of any group needs one combinable pass. With
    fewer than two groups it is exactly 0, without a trace of rounding.
    """
    n = total.cast("double")
    return F.when(groups > 1, F.log2(n) - sum_xlog2x / n).otherwise(F.lit(0.0))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def unpivot_numeric(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form (ids, feature, value) with every value as double."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*ids, *doubles).unpivot(ids, columns, "feature", "value")


def few_groups(df: DataFrame, columns: list[str], limit: int = 10_000) -> bool:
    """Whether the columns form at most ``limit`` groups, so that a table with one row per
    group may be broadcast. Runs a small aggregation."""
    return df.select(*columns).distinct().limit(limit + 1).count() <= limit
