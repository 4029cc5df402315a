"""SRC-1 and PRJ-1/2: delimited raw readings with text dates and null tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsdrift.config import NULL_TOKENS, READING_TS_FORMAT


def read_readings(spark: SparkSession, path: str, sep: str = ";",
                  cols: Sequence[str] = ("Date", "Time", "Global_active_power"),
                  header: bool = True) -> DataFrame:
    """SRC-1: every column read as text (no inference, no date parsing); only
    ``cols`` are kept so the scan prunes the rest."""
    first = spark.read.option("header", header).option("sep", sep).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in first.columns])
    df = spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)
    return df.select(*cols)


def parse_timestamp(date: str | Column, time: str | Column, fmt: str = READING_TS_FORMAT,
                    on_error: str = "raise") -> Column:
    """PRJ-1: join date and time text with a space and parse it as a naive
    timestamp.  ``on_error='raise'`` fails on bad input (ANSI), ``'null'``
    yields null instead."""
    text = F.concat_ws(" ", date, time)
    if on_error == "null":
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(fmt))


def coerce_numeric(col: str | Column, null_tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """PRJ-2: null tokens, unparsable text and any spelling of NaN become null,
    the rest double."""
    c = F.col(col) if isinstance(col, str) else col
    x = c.try_cast("double")
    return F.when(c.isin(list(null_tokens)) | F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def readings_to_series(df: DataFrame, series_id: str | None = None, date: str = "Date",
                       time: str = "Time", value: str = "Global_active_power",
                       on_error: str = "raise") -> DataFrame:
    """Raw text readings -> (series_id, ts, value)."""
    sid = F.col(series_id) if series_id else F.lit("main")
    return df.select(sid.cast("string").alias("series_id"),
                     parse_timestamp(date, time, on_error=on_error).alias("ts"),
                     coerce_numeric(value).alias("value"))
