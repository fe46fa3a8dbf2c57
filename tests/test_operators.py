"""Trajectory operators on small hand-made tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import schema
from pathloom.functions import geo
from pathloom.operators import aggregates as A
from pathloom.operators import contextual as C
from pathloom.operators import filters as Fi
from pathloom.operators import interpolate as I
from pathloom.operators import kinematic as K
from pathloom.operators import stats as S
from pathloom.operators import temporal as T
from pathloom.operators import views as V
from pathloom.operators.quantiles import exact_quantiles, grouped_quantiles
from pathloom.plans.pipeline import Trajectories, operators
from pathloom.schema import FEATURES
from pathloom.sources import io

T0 = dt.datetime(2024, 1, 5, 4, 59, 59)


def points(spark, rows):
    """Rows of (id, seconds, lat, lon)."""
    data = [(i, k, T0 + dt.timedelta(seconds=s), la, lo) for i, (k, s, la, lo) in enumerate(rows)]
    return spark.createDataFrame(data, "row_id long, traj_id string, DateTime timestamp_ntz, lat double, lon double")


@pytest.fixture(scope="module")
def walk(spark):
    return points(spark, [("a", 0, 0.0, 0.0), ("a", 10, 0.0, 0.001), ("a", 10, 0.001, 0.001), ("a", 30, 0.001, 0.001), ("a", 40, 0.0, 0.0), ("b", 5, 10.0, 10.0), ("c", 1, None, 1.0), ("c", 2, 1.0, 1.0)])


def test_construction(spark):
    lists = [[47.5, 8.25, "2023-06-01 07:15:00", 1], [47.625, 8.5, "2023-06-01 07:15:00", 1]]
    df = schema.from_rows(spark, lists)
    assert dict(df.dtypes) == {"lat": "double", "lon": "double", "DateTime": "timestamp_ntz", "traj_id": "string", "row_id": "bigint"}
    assert schema.from_rows(spark, np.array(lists, dtype=object)).count() == 2
    assert schema.from_rows(spark, []).count() == 0
    named = schema.from_dict(spark, {"x": [1.0, float("nan")], "y": [2.0, 3.0], "when": ["2024-01-01", "2024-01-02"], "who": ["b", "a"], "label": [5, 6]})
    assert named.columns[:4] == ["lat", "lon", "DateTime", "traj_id"] and named.where("lat IS NULL").count() == 1
    with pytest.raises(schema.MissingColumnsException):
        schema.as_trajectories(spark.range(1))
    with pytest.raises(schema.AmbiguousColumnException):
        schema.as_trajectories(df.withColumn("latitude", F.lit(1.0)), latitude="latitude")
    with pytest.raises(schema.NoHeadersException):
        schema.from_rows(spark, [[1, 2, 3]])
    with pytest.raises(schema.MandatoryColumnException):
        schema.drop_columns(df, "lat")
    assert "row_id" not in schema.drop_columns(df, "row_id").columns
    assert schema.to_numpy(df).shape == (2, 5)
    assert [r["traj_id"] for r in schema.sort_by_traj_id_and_datetime(named, ascending=False).collect()] == ["b", "a"]


def test_functions(spark):
    box = geo.bounding_box_by_radius(39, 116, 100000)
    assert box == pytest.approx((38.100678394081264, 114.84275815636957, 39.89932160591873, 117.15724184363044), abs=1e-9)
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(geo.haversine(0, 0, 0, 180)) == pytest.approx(math.pi * 6371000)
    assert get(geo.haversine(90, 0, -90, 0)) == pytest.approx(math.pi * 6371000)
    assert get(geo.haversine(F.lit(None).cast("double"), 0, 1, 1)) is None
    assert get(geo.bearing(0, 0, 0, 1)) == pytest.approx(90) and get(geo.bearing(0, 0, 0, 0)) == 0 and get(geo.bearing(1, 0, 0, 0)) == pytest.approx(180)
    for text, want in (("28.0N", 28.0), ("10.0S", -10.0), ("xN", None)):
        assert get(geo.nsew_to_degrees(F.lit(text), longitude=False)) == want
    for text, want in (("94.8W", -94.8), ("200.0W", 160.0), ("10.0E", 10.0)):
        assert get(geo.nsew_to_degrees(F.lit(text), longitude=True)) == pytest.approx(want)


def test_null_prefix_grows_with_each_derivative(spark):
    df = K.generate_kinematic_features(points(spark, [("a", 10 * i, 0.001 * i * i, 0.002 * i) for i in range(6)]))
    rows = df.orderBy("row_id").collect()
    nulls = {f: sum(r[f] is None for r in rows) for f in FEATURES}
    assert nulls == {"Distance": 1, "Distance_from_start": 1, "Speed": 1, "Acceleration": 2, "Jerk": 3, "Bearing": 1, "Bearing_Rate": 2, "Rate_of_bearing_rate": 3}


def test_kinematics_with_ties_and_gaps(walk):
    rows = {r["row_id"]: r for r in K.generate_kinematic_features(walk).collect()}
    assert rows[1]["Speed"] == pytest.approx(11.12, abs=0.01)
    assert rows[2]["Speed"] is None  # no time passes
    assert rows[3]["Distance"] == 0 and rows[3]["Bearing"] == 0
    assert rows[5]["Distance"] is None and rows[7]["Distance"] is None
    given = K.create_speed_column(walk.withColumn("Distance", F.lit(100.0)))
    assert {r["row_id"]: r["Speed"] for r in given.collect()}[1] == 10.0


def test_one_exchange_for_all_features(walk):
    plan = K.generate_kinematic_features(walk)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("chunk_s", [1, 10, 1000])
def test_chunked_features_are_the_same(walk, chunk_s):
    from pathloom.operators.linked import generate_kinematic_features_chunked

    get = lambda df: {r["row_id"]: tuple(r[f] for f in FEATURES) for r in df.collect()}
    assert get(generate_kinematic_features_chunked(walk, chunk_s)) == get(K.generate_kinematic_features(walk))


@pytest.fixture(scope="module")
def dirty(spark):
    """Nulls, NaN as null, repeats, ties and late rows, one trajectory with a third of the rows; an awkward extra column."""
    df = schema.as_trajectories(spark.read.parquet("/root/testdata/sf0.001/animal_points.parquet"))
    third = F.when(F.col("row_id") % 3 == 0, "giant").otherwise(F.col("traj_id"))
    df = df.withColumn("traj_id", third).withColumns({"value": F.pmod(F.xxhash64("row_id"), F.lit(1000)) / 10.0, "tags": F.create_map(F.lit("a"), F.lit(1))})
    df = df.withColumn("value", F.when(F.col("row_id") % 29 != 0, F.col("value"))).withColumn("DateTime", F.when(F.col("row_id") % 97 != 0, F.col("DateTime")))
    df = df.unionByName(df.where("row_id % 50 = 1").withColumn("row_id", F.col("row_id") + 10_000_000))
    return df.unionByName(df.where("row_id < 9").withColumns({"traj_id": F.lit(None).cast("string"), "row_id": F.col("row_id") + 20_000_000}))


@pytest.mark.parametrize("giant", [300, 40])
def test_giants_in_chunks_have_the_same_features(dirty, giant):
    get = lambda df: {r["row_id"]: tuple(r[f] for f in FEATURES) for r in df.collect()}
    want, got = K.generate_kinematic_features(dirty, giant=None), K.generate_kinematic_features(dirty, giant=giant)
    assert got.columns == want.columns and get(got) == get(want) and got.count() == dirty.count()
    days = dirty.withColumn("Date", F.to_date("DateTime"))
    one = lambda df: {r["row_id"]: (r["Speed"], r["Jerk"]) for r in df.collect()}
    assert one(K.create_jerk_column(days, "Date", giant=20)) == one(K.create_jerk_column(days, "Date", giant=None))
    assert sorted(map(str, A.distance_travelled(dirty, giant=giant).collect())) == sorted(map(str, A.distance_travelled(dirty, giant=None).collect()))


@pytest.mark.parametrize("kind", ["linear", "kinematic", "random-walk"])
def test_giants_in_chunks_are_filled_alike(dirty, kind):
    df = dirty.where("traj_id IS NOT NULL").drop("tags")
    near = lambda df: sorted((r["traj_id"], str(r["DateTime"]), r["lat"] is None or round(r["lat"], 7), r["lon"] is None or round(r["lon"], 7), str(r["Species"])) for r in df.collect())
    a, b = (I.interpolate_position(df, 3600, kind, class_label_col="Species", giant=g) for g in (None, 60))
    assert near(a) == near(b) and a.count() > df.count()


def test_giants_in_chunks_lose_the_same_outliers(dirty):
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    want, got = Fi.hampel_outlier_detection(dirty, "value", giant=None, n=1.5), Fi.hampel_outlier_detection(dirty, "value", giant=40, n=1.5)
    assert ids(want) == ids(got) and 0 < len(ids(want)) < dirty.count() and want.columns == got.columns == dirty.columns


def test_compat_rate(spark):
    df = points(spark, [("a", 10 * i, 0.001 * i * i, 0.002 * (i % 3)) for i in range(6)])
    a = K.create_rate_of_br_column(df, compat=True).orderBy("row_id").collect()
    b = K.create_bearing_rate_column(df).orderBy("row_id").collect()
    assert [r["Rate_of_bearing_rate"] for r in a] == [r["Bearing_Rate"] for r in b]


def test_temporal(walk):
    r = T.generate_temporal_features(walk).where("row_id = 1").first()
    assert (str(r["Date"]), r["Time"], r["Day_Of_Week"], r["Weekend"], r["Time_Of_Day"]) == ("2024-01-05", "05:00:09", "Friday", False, "Early Morning")
    assert T.create_time_of_day_column(walk).where("row_id = 0").first()["Time_Of_Day"] == "Late Night"


def test_aggregates(walk):
    assert A.get_start_location(walk, "a") == (0.0, 0.0) and A.get_end_location(walk, "a") == (0.0, 0.0)
    assert A.get_start_time(walk, "a") == T0 and A.get_end_time(walk, "a") == T0 + dt.timedelta(seconds=40)
    assert A.get_traj_duration(walk, "a") == dt.timedelta(seconds=40)
    assert A.get_number_of_locations(walk, "a") == 3 and A.get_number_of_locations(walk, "c") == 1
    d = A.get_distance_travelled_by_traj_id(walk, "a")
    assert d == pytest.approx(111.19 * 2 + 157.25, abs=0.1) and A.get_distance_travelled_by_traj_id(walk, "b") == 0
    assert A.get_distance_travelled_by_date_and_traj_id(walk, "2024-01-05", "a") == pytest.approx(d)
    for f in (A.get_start_location, A.get_end_time, A.get_traj_duration, A.get_number_of_locations, A.get_distance_travelled_by_traj_id):
        with pytest.raises(schema.MissingTrajIDException):
            f(walk, "nobody")
    assert A.get_bounding_box(walk) == (0.0, 0.0, 10.0, 10.0)
    assert A.dataset_facts(walk).first()["n_points"] == 8


def test_filters(walk):
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    box = (-0.5, -0.5, 0.0005, 0.5)
    assert ids(Fi.filter_by_bounding_box(walk, box)) == [0, 1, 4]
    assert sorted(ids(Fi.filter_by_bounding_box(walk, box)) + ids(Fi.filter_by_bounding_box(walk, box, inside=False))) == list(range(8))
    assert ids(Fi.filter_by_traj_id(walk, "b")) == [5]
    with pytest.raises(schema.MissingTrajIDException):
        Fi.filter_by_traj_id(walk, "z")
    assert ids(Fi.filter_by_date(walk, "2024-01-05")) == list(range(8)) and ids(Fi.filter_by_date(walk, end_date="2024-01-04")) == []
    assert ids(Fi.filter_by_datetime(walk, end_dateTime=T0)) == [0]
    for f in (Fi.filter_by_date, Fi.filter_by_datetime):
        with pytest.raises(ValueError):
            f(walk, "2024-01-06", "2024-01-05")
        with pytest.raises(ValueError):
            f(walk)
    assert ids(Fi.filter_by_max_speed(walk, 5)) == [3] and ids(Fi.filter_by_min_speed(walk, 12)) == [4]
    assert ids(Fi.filter_by_max_consecutive_distance(walk, 1)) == [3] and ids(Fi.filter_by_min_consecutive_distance(walk, 150)) == [4]
    assert ids(Fi.remove_trajectories_with_less_points(walk, 2)) == [0, 1, 2, 3, 4, 6, 7]
    copied = walk.unionByName(walk.withColumn("row_id", F.col("row_id") + 100))
    assert ids(Fi.remove_duplicates(copied)) == list(range(8))
    assert "PushedFilters: [IsNotNull" in walk.sparkSession.read.parquet("/root/testdata/sf0.001/animal_points.parquet").transform(Fi.filter_by_bounding_box, (0, 0, 1, 1))._jdf.queryExecution().executedPlan().toString()


def test_hampel(spark):
    v = [math.sin(i / 5) for i in range(40)]
    v[17] = 9.0
    df = points(spark, [("a", i, 0.0, 0.0) for i in range(40)]).withColumn("v", F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("row_id") + 1).cast("int")))
    assert {r["row_id"] for r in df.collect()} - {r["row_id"] for r in Fi.hampel_outlier_detection(df, "v").collect()} == {17}
    with pytest.raises(schema.MissingColumnsException):
        Fi.hampel_outlier_detection(df, "w")


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=30011)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert exact_quantiles(df, F.col("v"), p) == pytest.approx(list(np.quantile(x, p)))
    assert exact_quantiles(df.where("v > 100"), F.col("v"), p) == [None] * 6


def test_interpolation(spark):
    df = points(spark, [("a", 0, 0.0, 0.0), ("a", 10, 1.0, 2.0), ("a", 20, 2.0, 3.0), ("a", 50, 5.0, 9.0), ("a", 60, 6.0, 9.0), ("b", 0, 0.0, 0.0), ("b", 100, 1.0, 1.0)]).withColumn("label", F.concat(F.lit("l"), F.col("traj_id")))
    new = lambda kind, **m: {(r["traj_id"], (r["DateTime"] - T0).seconds): r for r in I.interpolate_position(df, 10, kind, class_label_col="label", **m).collect()}
    lin = new(" Linear ")
    assert len(lin) == 9 and lin["a", 30]["lat"] == pytest.approx(3.0) and lin["a", 30]["lon"] == pytest.approx(5.0) and lin["b", 10]["lat"] == pytest.approx(0.1) and lin["b", 10]["label"] == "lb"
    cub = new("cubic")
    assert len(cub) == 8 and cub["a", 30]["lat"] == pytest.approx(3.0)
    kin = new("kinematic")
    assert len(kin) == 8 and kin["a", 30]["lat"] == pytest.approx(3.0)  # constant speed
    walk = new("random-walk")
    assert len(walk) == 8 and walk == new("random-walk") and walk != new("random-walk", seed=1)
    with pytest.raises(ValueError):
        I.interpolate_position(df, 10, "magic")


def test_cubic_spline_is_not_a_knot():
    x = np.array([0.0, 1.0, 2.5, 3.0, 4.5, 6.0])
    poly = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    at = np.linspace(0, 6, 25)
    for n in (4, 5, 6):
        assert np.allclose(I.cubic_spline(x[:n], poly(x[:n]), at), poly(at))
    y = np.sin(x)
    eps = 1e-4  # third derivative is continuous at the second knot
    third = lambda s, h: (I.cubic_spline(x, y, np.array([s + 3 * h])) - 3 * I.cubic_spline(x, y, np.array([s + 2 * h])) + 3 * I.cubic_spline(x, y, np.array([s + h])) - I.cubic_spline(x, y, np.array([s])))[0] / h**3
    assert third(0.5, 0.1) == pytest.approx(third(1.5, 0.1), rel=1e-6)
    assert eps and I.cubic_spline(x[:1], y[:1], at)[0] == y[0]


def test_cubic_in_blocks_equals_the_whole(spark, monkeypatch):
    import pathloom.operators.blocks as B

    rng = np.random.default_rng(5)
    t = np.cumsum(rng.integers(5, 40, 600))
    df = points(spark, [("a", int(s), float(a), float(b)) for s, a, b in zip(t, rng.normal(size=600).cumsum(), rng.normal(size=600).cumsum())])
    get = lambda: {r["DateTime"]: (r["lat"], r["lon"]) for r in I.interpolate_position(df, 12, "cubic").collect()}
    whole = get()
    init = B.OrderedBlocks.__init__
    monkeypatch.setattr(B.OrderedBlocks, "__init__", lambda self, *a, **k: init(self, *a, **(k | {"rows_per_block": 90})))
    cut = get()
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_segments_and_stats(spark):
    day = 86400
    df = points(spark, [("a", i * day, 0.001 * i, 0.0) for i in range(8)] + [("b", 0, 0.0, 0.0), ("b", day, 0.0, 0.0)]).withColumn("label", F.col("traj_id"))
    seg = S.segment_traj_by_days(df, 2)
    assert {(r["seg_id"], r["n"]) for r in seg.groupBy("seg_id").agg(F.count("*").alias("n")).collect()} == {(1, 8), (2, 6), (3, 4)}
    assert {(r["traj_id"], r["seg_id"], r["n"]) for r in S.segment_traj_by_days(df, 2, "disjoint").groupBy("traj_id", "seg_id").agg(F.count("*").alias("n")).collect()} == {("a", i, 2) for i in (1, 2, 3, 4)} | {("b", 1, 2)}
    stats = S.generate_kinematic_stats(df, "label")
    assert stats.count() == 16
    r = stats.where("traj_id = 'a' AND Columns = 'Distance'").first()
    assert r["mean"] == pytest.approx(111.19, abs=0.01) and r["50%"] == pytest.approx(r["mean"]) and r["label"] == "a"
    wide = S.pivot_stats_df(stats, "label")
    assert wide.columns[1:4] == ["10%_Distance", "25%_Distance", "50%_Distance"] and len(wide.columns) == 74 and wide.count() == 2
    assert S.pivot_stats_df(S.generate_kinematic_stats(seg, "label", segmented=True), "label", segmented=True).count() == 3
    mi = {r["feature"]: r["mutual_information"] for r in S.feature_importance(df, "label", ("lat", "lon")).collect()}
    assert mi["lat"] > mi["lon"] == pytest.approx(0)


@pytest.mark.parametrize("segmented", [False, True])
def test_giant_trajectories_have_the_same_statistics(spark, segmented):
    from pathloom.plans.catalogue import points as table

    df = table(spark, "/root/testdata/sf0.001").where("CAST(traj_id AS INT) < 5")
    df = S.segment_traj_by_days(df, 10) if segmented else df
    get = lambda giant: {(r["traj_id"], r["seg_id"] if segmented else 0, r["Columns"]): r for r in S.generate_kinematic_stats(df, "event_type", segmented=segmented, giant=giant).collect()}
    usual, giants, mixed = get(10**9), get(0), get(60)
    assert usual.keys() == giants.keys() == mixed.keys() and len(usual) >= 32
    for k, r in usual.items():
        for other in (giants[k], mixed[k]):
            assert other["event_type"] == r["event_type"]
            assert all(other[s] == (pytest.approx(r[s], rel=1e-9) if r[s] is not None else None) for s in S.STATS)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(8)
    g = rng.choice(["a", "b", "c", "d|e"], p=[0.7, 0.2, 0.09, 0.01], size=4000)
    v = rng.normal(size=4000).round(2)
    df = spark.createDataFrame(list(zip(g.tolist(), v.tolist())), "g string, v double")
    for per in (150_000, 37):
        got = {r["g"]: r["q"] for r in grouped_quantiles(df, "g", "v", [0.0, 0.1, 0.5, 0.75, 1.0], rows_per_block=per).collect()}
        for k in set(g):
            assert got[k] == pytest.approx(list(np.quantile(v[g == k], [0.0, 0.1, 0.5, 0.75, 1.0])))


@pytest.mark.parametrize("cell", [None, 0.07])
def test_rings_across_the_180th_meridian(spark, cell):
    far = [1000.0 * i for i in range(20, 61)]
    places = spark.createDataFrame([(0.0, side * 179.99, x) for x in far for side in (1, -1)], "lat double, lon double, far double")
    deg = [math.degrees(x / 6371000) for x in far]
    over = [("e", i, 0.0, 179.99 + d - 360) for i, d in enumerate(deg)] + [("w", i, 0.0, 360 - 179.99 - d) for i, d in enumerate(deg)]
    near = C.visited_poi(points(spark, over), places, "far", 10.0, cell)
    assert near.where("Nearby_POI").count() == near.count() == 2 * len(far)


def test_context(walk, spark):
    layers = spark.createDataFrame([("lake", 0.001, 0.001), ("lake", 0.001, 0.001), ("hut", 5.0, 5.0)], "name string, lat double, lon double")
    assert {r["row_id"]: r["Visited_lake"] for r in C.visited_location(walk, layers, "lake", "name").collect()} == {i: int(i in (2, 3)) for i in range(8)}
    with pytest.raises(KeyError):
        C.visited_location(walk, layers, "sea", "name")
    with pytest.raises(schema.MissingColumnsException):
        C.visited_location(walk, layers, "lake", "kind")
    water = spark.createDataFrame([(0.0, 179.9999, 30.0), (0.0, 0.0, 111.0)], "lat double, lon double, far double")
    near = C.visited_poi(walk.unionByName(points(spark, [("z", 0, 0.0, -179.9999)])), water, "far", 10.0)
    assert sorted((r["row_id"], r["traj_id"]) for r in near.where("Nearby_POI").collect()) == [(0, "z"), (1, "a")] and near.count() == 9
    square = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001)]
    assert C.trajectories_inside_polygon(walk, square).count() == 5  # edges and corners count
    assert C.trajectories_inside_polygon(walk, [(x + 0.0005, y + 0.0005) for x, y in square]).count() == 2
    met = C.traj_intersect_inside_polygon(walk.where("row_id < 3"), walk.where("row_id >= 2"), square)
    assert met.columns == ["traj_id_1", "DateTime_1", "lat", "lon", "traj_id_2", "DateTime_2"] and met.count() == 3
    pois = spark.createDataFrame([(1, 0.0, 0.01, {"amenity": "bar"}), (2, 0.0, -0.01, {"amenity": "pub"}), (3, 0.0, 0.0, {"shop": "x"})], "i int, lat double, lon double, tags map<string,string>")
    ids = lambda *a: sorted(r["i"] for r in C.nearest_poi(pois, *a).collect())
    assert ids((0.0, 0.0), 5000, {"amenity": True}) == [1, 2] and ids((0.0, 0.0), 5000) == [3] and ids((0.0, 0.0), 5000, {"amenity": "pub"}) == [2] and ids((50.0, 0.0), 10) == []
    with pytest.raises(ValueError):
        C.nearest_poi(pois, (0.0, 0.0), 5000, {"amenity": 3})


def test_views(spark):
    square = spark.createDataFrame([("A", i, la, lo) for i, (la, lo) in enumerate([(0.0, 0.0), (0.0, 0.1), (0.1, 0.1), (0.1, 0.0)])], "CowPast string, vertex_no int, lat double, lon double")
    side = math.radians(0.1) * 6378137
    assert V.pasture_areas(square).first()["area"] == pytest.approx(side * side / 1e7, rel=1e-3)
    df = points(spark, [("88D1", 0, 0.05, 0.05), ("88E1", 0, 0.05, 0.05), ("881", 0, 5.0, 5.0), ("88D1", 90000, 0.05, 0.06)])
    assert {(r["Species"], r["n"]) for r in V.animals_by_pasture(df, square).collect()} == {("Deer", 1), ("Elk", 1)}
    habitat = spark.createDataFrame([("WR", 0.0, 0.05, 0.05)], "EcoGener string, DistEWat double, lat double, lon double")
    assert {(r["traj_id"], r["days"]) for r in V.hydration_days(df, habitat, 2000.0).collect()} == {("88D1", 2), ("88E1", 1)}
    assert V.trajectory_distance_treemap(df).where("traj_id = '88D1'").first()["days"] == 1
    assert [r["position"] for r in V.trajectory_lines(df, ["88D1"]).orderBy("position").collect()] == [1, 2]


def test_csv_ids_stay_text_and_times_keep_microseconds(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    df = spark.createDataFrame([(1.5, 2.5, t, "910313E37"), (1.0, None, t, "880109E01")], "lat double, long double, DateTime timestamp_ntz, traj_id string")
    io.write_csv(df, f"{tmp_path}/t.csv")
    got = io.load_starkey(spark, f"{tmp_path}/t.csv").collect()
    assert {r["traj_id"] for r in got} == {"910313E37", "880109E01"} and all(r["DateTime"] == t for r in got)


def test_shared_places_count_what_the_pairs_spell_out(spark):
    rng = np.random.default_rng(3)
    make = lambda n: points(spark, [(str(rng.integers(0, 4)), int(rng.integers(0, 9)), float(rng.integers(0, 3)), float(rng.integers(0, 3))) for _ in range(n)])
    a, b, square = make(40), make(30), [(-1.0, -1.0), (1.5, -1.0), (1.5, 1.5), (-1.0, 1.5)]
    pairs = C.traj_intersect_inside_polygon(a, b, square).collect()
    got = {(r["lat"], r["lon"]): r for r in C.shared_places(a, b, square).collect()}
    assert {(r["lat"], r["lon"]) for r in pairs} == set(got)
    for at, r in got.items():
        mine = [p for p in pairs if (p["lat"], p["lon"]) == at]
        assert len(mine) == r["points_1"] * r["points_2"]
        assert (len({p["traj_id_1"] for p in mine}), len({p["traj_id_2"] for p in mine})) == (r["trajectories_1"], r["trajectories_2"])
    assert C.shared_places(a.limit(0), b, square).count() == 0


def test_wide_and_small_places_together(spark):
    """One ring of 2,000 km among rings of 100 m; results are those of plain loops."""
    rng = np.random.default_rng(7)
    p = points(spark, [(str(i % 3), i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300)))] + [("n", 1, None, 1.0), ("far", 2, 0.0, 17.98)])
    s = spark.createDataFrame([(0.0, 0.0, 2_000_000.0)] + [(float(a), float(o), 100.0) for a, o in rng.uniform(-1, 1, (50, 2))] + [(None, 1.0, 5.0), (1.0, 1.0, None)], "lat double, lon double, d double")
    from pathloom.functions.npgeo import haversine_m

    got = {r["row_id"]: r["Nearby_POI"] for r in C.visited_poi(p, s, "d", 3000.0).collect()}
    places = [r for r in s.collect() if None not in tuple(r)]
    for r in p.collect():
        want = r["lat"] is not None and any(abs(q["d"] - haversine_m(r["lat"], r["lon"], q["lat"], q["lon"])) <= 3000 for q in places)
        assert got[r["row_id"]] == want
    assert got[301] and C.visited_poi(p, s.limit(0), "d", 1.0).where("Nearby_POI").count() == 0


def test_importance_uses_the_same_rows_for_all_features(spark):
    rng = np.random.default_rng(2)
    data = [(float(a), float(b) if i % 5 else None, "x" if a > 0 else "y") for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))] + [(1.0, float("nan"), "x"), (1.0, 1.0, None)]
    df = spark.createDataFrame(data, "a double, b double, label string")
    got = [(r["feature"], r["mutual_information"]) for r in S.feature_importance(df, "label", ("a", "b"), top=2).collect()]
    n = sum(1 for i in range(400) if i % 5)
    kept = [d for i, d in enumerate(data[:400]) if i % 5]
    share = sum(d[2] == "x" for d in kept) / n
    assert [f for f, _ in got] == ["a", "b"] and got[0][1] == pytest.approx(-share * math.log(share) - (1 - share) * math.log(1 - share), abs=0.08) and got[1][1] < 0.1
    assert S.feature_importance(df.where("a IS NULL"), "label", ("a", "b")).count() == 0


def test_accessors(walk):
    t = Trajectories(walk)
    assert (t.latitude.columns, t.longitude.columns, t.datetime.columns, t.traj_id.columns) == (["lat"], ["lon"], ["DateTime"], ["traj_id"])
    assert t.set_default_index().df.columns == ["traj_id", "DateTime", "row_id", "lat", "lon"]


def test_sources_and_chain(spark, tmp_path):
    csv = tmp_path / "ships.csv"
    csv.write_text("Lat,Lon,DateTime,VesselName,x\n1.5,2.5,2024-01-01 10:00:00,Ada,1\n1.6,2.5,2024-01-01 11:00:00,Ada,\n1.7,2.5,2024-01-01 12:00:00,Ada,3\n")
    ships = io.load_ships(spark, str(csv))
    assert ships.count() == 2 and {"lat", "lon", "DateTime", "traj_id", "x"} <= set(ships.columns)
    chain = Trajectories(ships.drop("row_id")).create_distance_column().filter_by_min_consecutive_distance(1)
    assert chain.df.count() == 1 and "points: 1" in str(chain)
    assert Trajectories(ships).get_bounding_box() == (1.5, 2.5, 1.7, 2.5)
    io.write_csv(chain.df, str(tmp_path / "out"))
    io.write_parquet(chain.df, str(tmp_path / "out.parquet"))
    assert io.read_table(spark, str(tmp_path / "out")).count() == io.read_table(spark, str(tmp_path / "out.parquet")).count() == 1
    with pytest.raises(AttributeError):
        chain.nothing_like_this  # noqa: B018
    assert len(operators()) > 60
