"""Calendar features of the time of a point; projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.schema import TIME, need

# Weekend days, and the parts of the day by their first hour.
WEEKEND = ("Saturday", "Sunday")
PARTS = ((0, "Late Night"), (5, "Early Morning"), (9, "Morning"), (13, "Noon"), (17, "Evening"), (21, "Night"))


def part_of_day(time: Column) -> Column:
    hour = F.hour(time)
    out = F.when(hour >= PARTS[-1][0], PARTS[-1][1])
    for begin, label in reversed(PARTS[:-1]):
        out = out.when(hour >= begin, label)
    return out


def create_date_column(df: DataFrame) -> DataFrame:
    need(df, TIME)
    return df.withColumn("Date", F.to_date(TIME))


def create_time_column(df: DataFrame) -> DataFrame:
    """``Time`` as text ``HH:mm:ss``, with microseconds where there are any."""
    need(df, TIME)
    micro = F.date_format(TIME, "HH:mm:ss.SSSSSS")
    return df.withColumn("Time", F.when(micro.endswith(".000000"), F.substring(micro, 1, 8)).otherwise(micro))


def create_day_of_week_column(df: DataFrame) -> DataFrame:
    need(df, TIME)
    return df.withColumn("Day_Of_Week", F.date_format(TIME, "EEEE"))


def create_weekend_indicator_column(df: DataFrame) -> DataFrame:
    df = df if "Day_Of_Week" in df.columns else create_day_of_week_column(df)
    return df.withColumn("Weekend", F.col("Day_Of_Week").isin(*WEEKEND))


def create_time_of_day_column(df: DataFrame) -> DataFrame:
    need(df, TIME)
    return df.withColumn("Time_Of_Day", part_of_day(F.col(TIME)))


def generate_temporal_features(df: DataFrame) -> DataFrame:
    return create_time_of_day_column(create_weekend_indicator_column(create_day_of_week_column(create_time_column(create_date_column(df)))))
