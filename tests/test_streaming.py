"""The stream gives the batch operators' features, however the pings are cut into micro-batches."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import kinematic as K
from pathloom.streaming.tracks import stream_distance_and_speed


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/animal_points.parquet").where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").limit(400).select("traj_id", "DateTime", "lat", "lon").distinct()
    src = src.dropDuplicates(["traj_id", "DateTime"]).toPandas().sort_values("DateTime")
    df = spark.createDataFrame(src).withColumn("DateTime", F.col("DateTime").cast("timestamp_ntz"))
    path = str(tmp_path / "in")
    for i in range(3):  # three files in order of time
        part = src.iloc[i * len(src) // 3 : (i + 1) * len(src) // 3]
        spark.createDataFrame(part).withColumn("DateTime", F.col("DateTime").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream_distance_and_speed(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["traj_id"], r["DateTime"]): (r["Distance"], r["Speed"]) for r in spark.table("tracks").collect()}
    want = {(r["traj_id"], r["DateTime"]): (r["Distance"], r["Speed"]) for r in K.create_speed_column(df).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == (pytest.approx(w[0]), pytest.approx(w[1]))
