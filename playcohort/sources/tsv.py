"""Headerless tab-separated play logs and user profiles.

Lines are read as text and split, so that a stray quote cannot swallow the lines after it
and short lines can be told from long ones: long lines are skipped, short ones padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playcohort.functions.columns import strip
from playcohort.schemas import PLAYS, PROFILES

# Raw fields read as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Accepted layouts of the signup date.
SIGNUP_FORMATS = ("MMM d, yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX")


def _fields(
    lines: DataFrame, names: list[str], na_values: tuple[str, ...], skip_header: bool
) -> DataFrame:
    """Split lines into named raw string columns. Lines of blanks are no records; a line of
    tabs is one, with nothing in it."""
    parts = lines.where(F.trim("value") != "").select(
        F.split("value", "\t", -1).alias("f")
    )
    parts = parts.where(F.size("f") <= len(names))

    def field(i: int) -> Column:
        raw = F.get("f", F.lit(i))
        return F.when(~raw.isin(*na_values), raw) if na_values else raw

    out = parts.select(*[field(i).alias(n) for i, n in enumerate(names)])
    if skip_header:
        out = out.where(~F.col(names[0]).eqNullSafe(names[0]))
    return out


def clean_plays(plays: DataFrame) -> DataFrame:
    """Drop plays without user, time or artist, then strip the text columns.

    The order matters: an artist made of spaces is not missing and survives as ''.
    """
    kept = plays.dropna(subset=["userid", "timestamp", "artist_name"])
    texts = ("userid", "artist_name", "track_name")
    return kept.select(*[strip(F.col(c)).alias(c) if c in texts else c for c in PLAYS.names])


def parse_plays(
    lines: DataFrame, na_values: tuple[str, ...] = NA_VALUES, skip_header: bool = False
) -> DataFrame:
    raw = _fields(lines, PLAYS.names, na_values, skip_header)
    return clean_plays(raw.withColumn("timestamp", F.try_to_timestamp("timestamp")))


def read_plays_tsv(
    spark: SparkSession,
    path: str,
    na_values: tuple[str, ...] = NA_VALUES,
    skip_header: bool = False,
) -> DataFrame:
    """Plays of a 6-column log. Unreadable times count as missing."""
    return parse_plays(spark.read.text(path), na_values, skip_header)


def parse_profiles(
    lines: DataFrame,
    na_values: tuple[str, ...] = NA_VALUES,
    skip_header: bool = False,
    signup_formats: tuple[str, ...] = SIGNUP_FORMATS,
) -> DataFrame:
    raw = _fields(lines, PROFILES.names, na_values, skip_header)
    signup = [F.try_to_timestamp("signup", F.lit(f)) for f in signup_formats]
    return raw.select(
        strip(F.col("userid")).alias("userid"),
        "gender",
        F.col("age").try_cast("double").alias("age"),
        "country",
        F.coalesce(*signup).alias("signup"),
    )


def read_profiles_tsv(
    spark: SparkSession,
    path: str,
    na_values: tuple[str, ...] = NA_VALUES,
    skip_header: bool = False,
) -> DataFrame:
    """Profiles of a 5-column file. Every line is kept; unreadable ages and dates are null."""
    return parse_profiles(spark.read.text(path), na_values, skip_header)
