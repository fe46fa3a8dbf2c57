"""Totals over trailing periods for each entity and calendar day.

Distinct readings are summed to daily totals (pre-aggregated before the shuffle, so an entity with a third of
all rows shrinks to its days first). Every day between an entity's first and last day is range-joined to the
daily totals within its trailing bounds; coarse buckets of ``bucket_days`` restrict the candidates: a day's
window meets at most ``ceil((max window - 1) / bucket_days) + 1`` buckets, and the join key is (entity, bucket),
so a long-lived entity is spread over many tasks as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_totals(
    df: DataFrame,
    windows: tuple[int, ...] = (7, 30),
    key: str = "traj_id",
    time: str = "DateTime",
    value: str = "Distance",
    bucket_days: int = 30,
) -> DataFrame:
    """``traj_id, day`` (date) and ``total_N, mean_N`` for each window of N days that ends with the day.

    Means are per calendar day, idle days included. Null and NaN values add 0, but their rows make the day part
    of the entity's calendar. Rows equal in key, time and value count once. Rows without key or time do not
    count. An empty table gives no rows.
    """
    v = F.col(value).cast("double")
    good = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(time).alias("t"), F.when(~F.isnan(v), v).alias("v"))
    once = good.distinct()
    daily = once.groupBy("k", F.to_date("t").alias("d")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("x"))
    number = F.datediff("d", F.lit("1970-01-01").cast("date"))
    longest = max(windows)
    bucket = lambda n: F.floor(n / F.lit(bucket_days)).cast("int")
    totals = daily.select("k", number.alias("dn"), "x").withColumn("b", bucket(F.col("dn")))
    span = good.groupBy("k").agg(F.min(F.to_date("t")).alias("a"), F.max(F.to_date("t")).alias("z"))
    calendar = span.select("k", F.explode(F.sequence(F.datediff("a", F.lit("1970-01-01").cast("date")), F.datediff("z", F.lit("1970-01-01").cast("date")))).alias("day"))
    calendar = calendar.select("k", "day", F.explode(F.sequence(bucket(F.col("day") - (longest - 1)), bucket(F.col("day")))).alias("b"))
    inside = (F.col("dn") <= F.col("day")) & (F.col("dn") > F.col("day") - longest)
    sums = [F.sum(F.when(F.col("dn") > F.col("day") - n, F.col("x")).otherwise(0.0)).alias(f"total_{n}") for n in windows]
    c, m = calendar.alias("c"), totals.alias("m")
    met = c.join(m, (F.col("c.k") == F.col("m.k")) & (F.col("c.b") == F.col("m.b")) & inside, "left")
    out = met.groupBy(F.col("c.k").alias("traj_id"), "day").agg(*sums)
    cols = [x for n in windows for x in (F.col(f"total_{n}"), (F.col(f"total_{n}") / n).alias(f"mean_{n}"))]
    return out.select("traj_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), *cols)
