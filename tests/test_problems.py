"""The problems against brute force, with blocks and cells so small that everything crosses their edges."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators import regrid, rolling, spatial, spikes, stops, timestamps, tree
from pathloom.plans import problems
from tests import brute

D = "/root/testdata/sf0.001"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize(("capacity", "sample"), [(20_000, 100_000), (40, 100_000), (10, 300)])
def test_near_and_inside(spark, capacity, sample):
    p, h = spark.read.parquet(f"{D}/geolife_points.parquet"), spark.read.parquet(f"{D}/habitat.parquet")
    got = rows(spatial.near_and_inside(p, h, capacity=capacity, sample=sample), "relation", "a_id", "b_id")
    assert len(got) == len(set(got))
    assert set(got) == brute.near_and_inside(p.toPandas(), h.toPandas())


def test_near_on_map_edges_and_in_a_crowd(spark):
    rng = np.random.default_rng(1)
    n = 900
    lat = np.r_[rng.normal(10, 1e-4, 300), rng.normal(0, 1e-4, 300), np.full(150, 89.9999), np.full(150, 45.0)]
    lon = np.r_[rng.normal(20, 1e-4, 300), 180 + rng.normal(0, 2e-4, 300), rng.uniform(-180, 180, 150), np.full(150, -180.0)]
    p = pd.DataFrame({"point_id": np.arange(n), "id": np.r_[np.zeros(250, int), rng.integers(0, 9, n - 250)], "lat": lat, "lon": lon})
    p.loc[p.index % 2 == 1, "lon"] = p.lon + np.where((p.lon < 0) & (p.lon >= -180), 360, 0)
    h = pd.DataFrame({"region_id": [1] * 4 + [1] * 4 + [2] * 4, "ring": [0] * 4 + [1] * 4 + [0] * 4, "vertex_no": [0, 1, 2, 3] * 3, "lat": [-1, -1, 1, 1, -1e-4, -1e-4, 1e-4, 1e-4, 9, 9, 11, 11.0], "lon": [179, -179, -179, 179, 179.9999, -179.9999, -179.9999, 179.9999, 19, 21, 21, 19.0]})
    want = brute.near_and_inside(p, h)
    old = spatial.HEAVY
    spatial.HEAVY = 50
    try:
        for capacity in (20_000, 50, 5):
            got = rows(spatial.near_and_inside(spark.createDataFrame(p), spark.createDataFrame(h), capacity=capacity), "relation", "a_id", "b_id")
            assert len(got) == len(set(got))
            assert set(got) == want
    finally:
        spatial.HEAVY = old
    assert sum(r[0] == "near" for r in want) > 10_000


def test_one_persons_crowd_is_copied_once(spark):
    """A place full of one person's points: shares of their own, none paired with each other; what others have is found."""
    from pathloom.functions.spindex import Quadtree

    n = 4000
    rng = np.random.default_rng(4)
    y, x = 10 + rng.normal(0, 1e-5, n), 20 + rng.normal(0, 1e-5, n)
    who = np.where(np.arange(n) % 100 == 0, "guest", "host")
    tree = Quadtree(x, y, 1.0, 100, 2e-3, who=who)
    assert len(tree.pure) == 1 and tree.mixed.max() == 1
    (cell, person), (first, own) = next(iter(tree.pure.items()))
    assert person == "host" and tree.shares[cell] - own == 1  # the host's points go to one task each
    p = pd.DataFrame({"point_id": np.arange(n), "id": np.where(who == "host", 1, 2 + np.arange(n) % 3), "lat": y, "lon": x})
    got = rows(spatial.near_and_inside(spark.createDataFrame(p), spark.createDataFrame([], "region_id long, ring int, vertex_no int, lat double, lon double"), capacity=100), "relation", "a_id", "b_id")
    h = pd.DataFrame({"region_id": [], "ring": [], "vertex_no": [], "lat": [], "lon": []})
    assert len(got) == len(set(got)) and set(got) == brute.near_and_inside(p, h)


def test_checkpoints_do_not_stay(spark):
    import gc
    import os
    import time

    from pathloom.operators.blocks import shared_folder

    at = shared_folder(spark).removeprefix("file:")
    held = lambda: {f"{d}/{r}" for d, dirs, _ in os.walk(at) for r in dirs if r.startswith("rdd-")}
    before = held()
    assert regrid.regular_grid(spark.read.parquet(f"{D}/storm_readings.parquet")).count() > 0
    for _ in range(40):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
        if not held() - before:
            break
    assert not held() - before


@pytest.mark.parametrize("per_block", [150_000, 60])
def test_implausible(spark, per_block):
    df = spark.read.parquet(f"{D}/car_features.parquet")
    got = rows(spikes.implausible(df, problems.CAR_BOUNDS, rows_per_block=per_block), "row_id", "field")
    assert len(got) == len(set(got))
    assert set(got) == brute.implausible(df.toPandas(), problems.CAR_BOUNDS)


def test_implausible_rules_and_wider_flanks(spark):
    v = [10.0, 10.1, 10.0, 90.0, 10.1, 10.2, None, 10.1, 140.0] + [11.0] * 9 + [11.1]
    rows_ = [(i, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), x, 0.0, 1.0 + i / 1000, "k") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows_, "row_id long, traj_id string, DateTime timestamp_ntz, Speed double, Acceleration double, lat double, k string")
    got = {(r["row_id"], r["rule"]) for r in spikes.implausible(df, {"Speed": (0.0, 100.0)}).collect()}
    assert got == {(3, "spike"), (8, "bounds")} | {(i, "stuck") for i in range(9, 18)}
    wide = {r["row_id"]: r for r in spikes.implausible(df, {"Speed": (0.0, 100.0)}, flank=2).collect()}
    assert wide[3]["rule"] == "spike" and wide[3]["rolling_median"] == pytest.approx(10.05, abs=0.1) and wide[8]["rolling_mad"] >= 0


def test_the_rolling_window_proposes_and_misses_nothing():
    """Candidates come from median and MAD of the window, hold every spike, and change with the window."""
    rng = np.random.default_rng(8)
    differ = 0
    for _ in range(300):
        n = 60
        v = np.cumsum(rng.choice([0.0, 0.0, 20.0, -20.0], n)) + rng.normal(0, 1, n)
        at = rng.integers(1, n - 4, 6)
        v[at] += rng.choice([-60, 60, 17], 6)
        v[at[:2] + 1] += 60
        k = np.repeat(["a", "b"], n // 2)
        u = np.repeat([np.median(np.abs(np.diff(v[: n // 2]))), np.median(np.abs(np.diff(v[n // 2 :])))], n // 2)
        want = np.zeros(n, bool)
        for s in (0, n // 2):
            for w in (1, 2, 3):
                for i in range(s + 1, s + n // 2 - w):
                    p, q, lim = v[i - 1], v[i + w], 15 * u[i]
                    if abs(p - q) <= lim and all(abs(x - p) > lim and abs(x - q) > lim for x in v[i : i + w]):
                        want[i : i + w] = True
        wide, found, med, mad = spikes.spikes(k, v, u, 15.0, 3, 7, 3.0)
        narrow = spikes.spikes(k, v, u, 15.0, 3, 1, 3.0)[0]
        assert (found == want).all() and not (want & ~wide).any()
        differ += (wide != narrow).any()
        i = 20
        x = np.r_[v[13:20], v[21:28]]
        assert med[i] == pytest.approx(np.median(x)) and mad[i] == pytest.approx(np.median(np.abs(x - np.median(x))))
    assert differ > 100
    # quiet series: the filter proposes the spike and few others
    v = np.r_[np.zeros(20), 30.0, np.zeros(20)] + np.tile([0.0, 1.0], 21)[:41]
    wide, found, _, _ = spikes.spikes(np.repeat("a", 41), v, np.ones(41), 15.0, 3, 7, 3.0)
    assert np.flatnonzero(found).tolist() == [20] and wide.sum() <= 3


@pytest.mark.parametrize("per_block", [150_000, 150, 40])
def test_stops_and_trips(spark, per_block):
    df = spark.read.parquet(f"{D}/animal_points.parquet")
    got = rows(stops.stops_and_trips(df, rows_per_block=per_block), "traj_id", "kind", "start_at", "end_at")
    assert len(got) == len(set(got))
    assert set(got) == brute.stops_and_trips(df.toPandas())


def _pings(spark, east_m, every_s=240):
    t0 = dt.datetime(2024, 1, 1)
    deg = np.degrees(np.asarray(east_m, float) / 6371000)
    return spark.createDataFrame([(i, "a", t0 + dt.timedelta(seconds=every_s * i), 0.0, float(x)) for i, x in enumerate(deg)], PING)


@pytest.mark.parametrize("per_block", [1000, 5])
@pytest.mark.parametrize("pings", [10, 5])
def test_a_gradual_excursion_does_not_end_a_stop(spark, per_block, pings):
    x = [0.0] * pings + [50.0, 100.0] + [0.0] * pings
    got = rows(stops.stops_and_trips(_pings(spark, x), rows_per_block=per_block), "kind", "start_at", "duration_s")
    assert got == [("stop", "2024-01-01 00:00:00", 240.0 * (len(x) - 1))]


@pytest.mark.parametrize("per_block", [1000, 60])
def test_an_uneven_stop_is_one_stop_wherever_blocks_are_cut(spark, per_block):
    x = [0.0] * 200 + [50.0] * 5
    got = rows(stops.stops_and_trips(_pings(spark, x), rows_per_block=per_block), "kind", "start_at", "duration_s")
    assert got == [("stop", "2024-01-01 00:00:00", 240.0 * 204)]


@pytest.mark.parametrize("per_block", [1000, 30, 12, 7])
def test_blocks_without_a_part_in_joined_stretches_give_nothing_to_them(spark, per_block):
    """A drift cut by blocks' edges is brought together; most blocks have no part in it. A second one holds no stop."""
    far = 1000 + np.arange(100) * 500.0
    x = np.r_[np.repeat([0.0, 50.0, 100.0], 12), far, far[-1] + 500 + np.arange(40) * 25.0, 1e5 + far]
    got = sorted(rows(stops.stops_and_trips(_pings(spark, x), rows_per_block=per_block), "kind", "start_at", "end_at"))
    want = sorted(rows(stops.stops_and_trips(_pings(spark, x), rows_per_block=10_000), "kind", "start_at", "end_at"))
    assert [r for r in got if r[0] == "stop"] == [("stop", "2024-01-01 00:00:00", "2024-01-01 01:32:00"), ("stop", "2024-01-01 01:36:00", "2024-01-01 02:20:00")]
    assert got == want


def test_stops_do_not_depend_on_where_blocks_are_cut(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.r_[rng.normal(p, 9, rng.integers(3, 30)), p + np.cumsum(rng.uniform(10, 50, rng.integers(0, 6)))] for p in np.cumsum(rng.choice([35.0, 45.0, 70.0, -40.0, 300.0], 60))])
    df = _pings(spark, x)
    cols = ("kind", "start_at", "end_at", "duration_s")
    whole = set(rows(stops.stops_and_trips(df, rows_per_block=10_000), *cols))
    assert len(whole) > 50
    for per_block in (300, 41, 9):
        assert set(rows(stops.stops_and_trips(df, rows_per_block=per_block), *cols)) == whole


def test_smallest_enclosing_circle():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 500):
        x, y = rng.normal(0, 5, n), rng.normal(0, 9, n)
        h = stops._hull(x, y)
        cx, cy, r = stops._circle(x[h], y[h])
        d = np.hypot(x - cx, y - cy)
        assert d.max() == pytest.approx(r, abs=1e-6)
        assert all(np.hypot(x - cx - a, y - cy - b).max() >= r - 1e-6 for a, b in rng.normal(0, 0.5, (200, 2)))


def test_trip_distance_is_the_path(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [(0, 0.0)] * 6 + [(0, 0.01 * i) for i in range(1, 6)] + [(0, 0.06)] * 6
    df = spark.createDataFrame([(i, "a", t0 + dt.timedelta(minutes=6 * i), float(a), float(o)) for i, (a, o) in enumerate(at)], "row_id long, traj_id string, DateTime timestamp_ntz, lat double, lon double")
    for per_block in (100, 3):
        got = {r["kind"]: r for r in stops.stops_and_trips(df, rows_per_block=per_block).orderBy("start_at").collect()}
        assert got["trip"]["distance_m"] == pytest.approx(0.06 * np.pi / 180 * 6371000, rel=1e-9)
        assert got["trip"]["duration_s"] == 6 * 6 * 60


def test_contested_dwells_are_cut_where_they_overlap():
    a = {"t0": 0, "t1": 100, "n": 11, "at": np.arange(0, 101, 10), "odds": np.full(11, 11.0), "out": 2}
    b = {"t0": 85, "t1": 300, "n": 21, "at": np.r_[85, np.arange(105, 301, 10)], "odds": np.full(21, 11.0), "out": 1}
    got = stops.decode([a, b], 0, 300, 40)
    assert [(u["t0"], u["t1"]) for u in got] in ([(0, 100), (105, 295)], [(0, 80), (85, 300)])


MIN = 60_000_000


def _rivals(between_a=0.0, between_b=0.0):
    """Two dwells, one ping every ten minutes, that both claim the pings of minutes 40 to 60."""
    at_a, at_b = np.arange(0, 61, 10) * MIN, np.arange(40, 141, 10) * MIN
    a = {"t0": 0, "t1": 60 * MIN, "n": 7, "at": at_a, "odds": 11.0 - np.where(at_a >= 40 * MIN, between_a, 0.0)}
    b = {"t0": 40 * MIN, "t1": 140 * MIN, "n": 11, "at": at_b, "odds": 11.0 - np.where(at_b <= 60 * MIN, between_b, 0.0)}
    return [a, b]


def test_durations_decide_between_rivals():
    ends = lambda units, d: [(u["t0"] // MIN, u["t1"] // MIN) for u in stops.decode(units, 0, 140 * MIN, 20 * MIN, d)]
    assert ends(_rivals(), stops.Durations(stop_min=65, stop_sigma=0.2)) == [(0, 60), (70, 140)]  # two stops of about an hour
    assert ends(_rivals(), stops.Durations()) == [(0, 30), (40, 140)]  # wide: a short one and a long one
    never = stops.Durations(travel_min=1e-3, travel_sigma=0.1)  # nobody travels for ten minutes: a single stop is left
    assert len(ends(_rivals(), never)) == 1


def test_emissions_decide_between_rivals():
    ends = lambda units: [(u["t0"] // MIN, u["t1"] // MIN) for u in stops.decode(units, 0, 140 * MIN, 20 * MIN)]
    assert ends(_rivals(between_b=2.0)) == [(0, 60), (70, 140)]  # the pings lie nearer to the first place
    assert ends(_rivals(between_a=2.0)) == [(0, 30), (40, 140)]


def test_viterbi_equals_all_choices():
    """No predecessor is left out: the best of all sets of disjoint segments, on chains of many rivals."""
    import itertools

    rng = np.random.default_rng(12)
    d = stops.Durations(stop_min=40, stop_sigma=0.5, travel_min=200, travel_sigma=0.3)
    for _ in range(30):
        units, t = [], 0
        for _ in range(9):
            t += int(rng.integers(5, 40))
            at = np.arange(t, t + int(rng.integers(25, 70)), 5) * MIN
            units.append({"t0": int(at[0]), "t1": int(at[-1]), "n": len(at), "at": at, "odds": rng.normal(0, 1, len(at))})
        end = max(u["t1"] for u in units)
        got = stops.decode(list(units), 0, end, 20 * MIN, d)

        def score(chosen):
            if not chosen:
                return d.travel_at_least(end)
            v = d.travel_at_least(chosen[0][0]) + d.travel_at_least(end - chosen[-1][1])
            for (a, z, s), nxt in zip(chosen, [*chosen[1:], None]):
                v += s + d.stop(z - a) + (d.travel(nxt[0] - z) if nxt else 0.0)
            return v

        def value(u, t0, t1):
            return float(u["odds"][(u["at"] >= t0) & (u["at"] <= t1)].sum())

        kept = []
        for u in sorted(units, key=lambda u: (u["t0"], -u["t1"])):
            if not (kept and u["t1"] <= kept[-1]["t1"]):
                kept.append(u)
        options = []
        for i, u in enumerate(kept):
            los = [u["t0"], *([int(x) for x in u["at"][u["at"] > kept[i - 1]["t1"]][:1]] if i and kept[i - 1]["t1"] >= u["t0"] else [])]
            his = [u["t1"], *([int(x) for x in u["at"][u["at"] < kept[i + 1]["t0"]][-1:]] if i + 1 < len(kept) and kept[i + 1]["t0"] <= u["t1"] else [])]
            options.append([None, *((a, z, value(u, a, z)) for a in los for z in his if z - a >= 20 * MIN)])
        best = max(score([c for c in some if c]) for some in itertools.product(*options) if all(x[1] < y[0] for x, y in itertools.pairwise([c for c in some if c])))
        assert score([(u["t0"], u["t1"], value(u, u["t0"], u["t1"])) for u in got]) == pytest.approx(best)


def test_timestamps(spark):
    about = spark.createDataFrame([(1, "Europe/Berlin", "dmy"), (2, "America/New_York", "mdy"), (3, "UTC", None), (4, None, "dmy"), (5, "Australia/Lord_Howe", "dmy")], "station_id int, time_zone string, date_order string")
    cases = [
        ("03.04.2018 12:00", 1, "2018-04-03 10:10", "2018-04-03 10:00:00"),
        ("3/4/18 1:02:03 PM", 2, "2018-03-04 19:00", "2018-03-04 18:02:03"),
        ("2018-10-28 02:30:00", 1, "2018-10-28 05:00", "2018-10-28 01:30:00"),  # twice: the later
        ("2018-10-28 02:30:00", 1, "2018-10-28 00:45", "2018-10-28 00:30:00"),  # the later is still to come
        ("2018-03-25 02:30:00", 1, "2018-03-26 00:00", "2018-03-25 01:30:00"),  # skipped
        ("2018-04-01T01:45:00[Australia/Lord_Howe]", 1, "2018-04-01 00:00", "2018-03-31 15:15:00"),
        ("1514857768.25", 4, "2018-01-02 02:00", "2018-01-02 01:49:28.250000"),
        ("1514857768250", 4, None, "2018-01-02 01:49:28.250000"),
        ("Tue, 02 Jan 2018 11:31:44 +0545", 4, None, "2018-01-02 05:46:44"),
        ("02-JAN-2018 07:10:53", 4, None, None),  # no zone at all
        (" 2018-01-02t07:38:01z ", 4, None, "2018-01-02 07:38:01"),
        ("2018-06-01 12:00:00 EST", 2, None, "2018-06-01 17:00:00"),
        ("20180102T151628-0500", 1, None, "2018-01-02 20:16:28"),
        (" 2018-01-02 15:16:28,123456 -0500 ", 1, None, "2018-01-02 20:16:28.123456"),
        ("2018-02-30T15:16:28Z", 1, None, None), ("2018-10-28 02:30:00", 1, None, None),  # no such day; twice, arrival unknown
        ("14/01/2018 10:00", 2, "2018-01-14 16:00", None),  # no month 14
        ("2018-02-30 10:00:00", 1, None, None), ("25:61", 1, None, None), ("", 1, None, None), (None, 1, None, None), ("unknown", 9, None, None),
    ]
    many = [("05/06/2018 10:00:00", 3, "2018-06-05 10:09", "2018-06-05 10:00:00")] * 3 + [(f"{d:02d}/06/2018 10:00:00", 3, f"2018-06-{d:02d} 10:04", f"2018-06-{d:02d} 10:00:00") for d in range(13, 29)]
    data = [(i, s, t, dt.datetime.fromisoformat(r) if r else None) for i, (t, s, r, _) in enumerate(cases + many)]
    df = spark.createDataFrame(data, "fix_id long, station_id int, DateTime string, received_at timestamp_ntz").withColumns({"id": F.lit(1), "src": F.lit("x"), "sig": F.lit("y")})
    got = {r["fix_id"]: r for r in timestamps.normalise_timestamps(df, about).collect()}
    assert len(got) == len(data)
    for i, (text, *_, want) in enumerate(cases + many):
        have = None if got[i]["utc_us"] is None else str(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=got[i]["utc_us"]))
        assert have == want, text


def test_undeclared_order_without_evidence_is_ambiguous(spark):
    about = spark.createDataFrame([(1, "UTC", None)], "station_id int, time_zone string, date_order string")
    df = spark.createDataFrame([(1, 1, "05/06/2018 10:00:00", None)], "fix_id long, station_id int, DateTime string, received_at timestamp_ntz")
    r = timestamps.normalise_timestamps(df, about).first()
    assert r["status"] == "ambiguous" and r["utc_us"] is None and r["posterior"] < 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_declared_order_overrides_no_posterior(spark, sf):
    """The exact check changes nothing on the test tables: the posteriors alone choose."""
    d = f"/root/testdata/{sf}"
    r = timestamps.normalise_timestamps(problems.table(spark, d, "seagull_fixes"), problems.table(spark, d, "stations"))
    assert r.where("overridden").count() == 0 and r.where("status = 'resolved'").count() > 400


def test_posteriors_decide_for_sources_that_declare_nothing(spark):
    """Thousands of texts of undeclared sources, each with its own order and unit: learnt from those that are plain."""
    rng = np.random.default_rng(9)
    data, want = [], {}
    for i in range(4000):
        source, t = int(rng.integers(1, 5)), dt.datetime(2018, 1, 1) + dt.timedelta(seconds=int(rng.integers(0, 300 * 86400)))
        late = rng.choice([60, 600, 7200, 86400 * 3, 86400 * 15], p=[0.5, 0.3, 0.1, 0.05, 0.05])
        us = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        text = {1: t.strftime("%d/%m/%Y %H:%M:%S"), 2: t.strftime("%m/%d/%Y %H:%M:%S"), 3: str(us // 1000), 4: str(us // 10**6)}[source]
        arrives = t + dt.timedelta(seconds=int(late)) if i % 10 else None  # a tenth has no arrival time: only the shares tell
        data.append((i, source, text, arrives))
        want[i] = us
    about = spark.createDataFrame([(s, "UTC", None) for s in range(1, 5)], "station_id int, time_zone string, date_order string")
    df = spark.createDataFrame(data, "fix_id long, station_id int, DateTime string, received_at timestamp_ntz")
    got = timestamps.normalise_timestamps(df, about).collect()
    sure = [r for r in got if r["status"] == "resolved"]
    assert len(sure) > 0.98 * len(got) and all(r["utc_us"] == want[r["fix_id"]] for r in sure)
    assert sum(0.9 <= r["posterior"] < 0.9999999 for r in sure) > 100  # these had rivals
    old = timestamps._LOG_DENSITY
    timestamps._LOG_DENSITY = np.zeros_like(old)  # without the likelihood nothing is learnt
    try:
        blind = timestamps._em(pd.DataFrame({"src": "1", "declared": None, "sig": ["dmy:3|mdy:0", "dmy:3"], "n": [5, 1]}))
    finally:
        timestamps._LOG_DENSITY = old
    seeing = timestamps._em(pd.DataFrame({"src": "1", "declared": None, "sig": ["dmy:3|mdy:0", "dmy:3"], "n": [5, 1]}))
    assert seeing["posterior"][0] > blind["posterior"][0]


def test_plain_numbers_of_any_length(spark):
    about = spark.createDataFrame([(1, "UTC", None)], "station_id int, time_zone string, date_order string")
    at = dt.datetime(1970, 1, 2, 0, 5)
    data = [(1, 1, "86400", at), (2, 1, "86400000", at), (3, 1, "7", dt.datetime(1970, 1, 1, 0, 1)), (4, 1, "99999999", dt.datetime(2018, 1, 1)), (5, 1, "9" * 30, None)]
    df = spark.createDataFrame(data, "fix_id long, station_id int, DateTime string, received_at timestamp_ntz")
    got = {r["fix_id"]: (r["status"], r["utc_us"]) for r in timestamps.normalise_timestamps(df, about).collect()}
    assert got[2] == ("resolved", 86_400_000_000)
    assert got[1][1] in (None, 86_400_000_000) and got[4] == ("ambiguous", None) and got[5] == ("none", None)


def test_trailing_totals(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    data = [("a", d("2024-01-01 23:59:59"), 5.0), ("a", d("2024-01-01 23:59:59"), 5.0), ("a", d("2024-01-01 23:59:59"), 7.0), ("a", d("2024-01-08 00:00:00"), float("nan")), ("a", d("2024-02-03 00:00:00"), 1.0), (None, d("2024-01-01 00:00:00"), 1.0), ("b", None, 1.0)]
    df = spark.createDataFrame(data, "traj_id string, DateTime timestamp_ntz, Distance double")
    got = {str(r["day"]): r for r in rolling.trailing_totals(df).collect()}
    assert len(got) == 34
    assert (got["2024-01-07"]["total_7"], got["2024-01-08"]["total_7"], got["2024-01-30"]["total_30"], got["2024-01-31"]["total_30"], got["2024-02-03"]["total_7"]) == (12.0, 0.0, 12.0, 0.0, 1.0)
    assert got["2024-01-30"]["mean_30"] == pytest.approx(0.4)


def test_grid_in_blocks_equals_the_whole(spark):
    df = spark.read.parquet(f"{D}/storm_readings.parquet").withColumn("traj_id", F.lit("one"))
    whole = {r["slot"]: r for r in regrid.regular_grid(df).collect()}
    cut = regrid.regular_grid(df, rows_per_block=70).collect()
    assert len(cut) == len(whole) and len(whole) > 100
    for r in cut:
        w = whole[r["slot"]]
        assert r["missing"] == w["missing"] and r["n_readings"] == w["n_readings"]
        assert r["lat"] == pytest.approx(w["lat"], abs=1e-7) and r["lat_sd"] == pytest.approx(w["lat_sd"], abs=1e-9)


def test_grid_of_a_dense_source_in_blocks_equals_the_whole(spark):
    """Blocks within one period, a reading every few seconds, repeats, and a way over the 180th meridian."""
    rng = np.random.default_rng(3)
    at = np.repeat(np.sort(rng.choice(60_000, 1500, replace=False)), rng.choice([1, 1, 40], 1500))
    t0 = dt.datetime(2024, 1, 1, 1)
    data = [(i, "ab"[int(s > 50_000)], t0 + dt.timedelta(seconds=int(s)), float(20 + s / 30_000 + e), float((179.5 + s / 50_000 + f + 180) % 360 - 180)) for i, (s, e, f) in enumerate(zip(at, *rng.normal(0, 0.02, (2, len(at)))))]
    df = spark.createDataFrame(data, PING)
    whole = {(r["traj_id"], r["slot"]): r for r in regrid.regular_grid(df, rows_per_block=10**6).collect()}
    cut = regrid.regular_grid(df, rows_per_block=1200).collect()
    assert len(cut) == len(whole) and sum(r["n_readings"] for r in cut) == len(data)
    for r in cut:
        w = whole[r["traj_id"], r["slot"]]
        assert r["n_readings"] == w["n_readings"]
        for c in ("lat", "lon", "lat_sd"):
            assert r[c] == pytest.approx(w[c], abs=1e-8)


@pytest.mark.parametrize("steps", [1, 255, 256, 257, 1500])
def test_a_long_source_in_pieces_equals_the_whole(steps):
    rng = np.random.default_rng(steps)
    t = np.sort(np.round(rng.uniform(0, 400, steps), 1))  # ties as well
    y = np.c_[np.sin(t / 30), np.cos(t / 30)] + rng.normal(0, 0.02, (steps, 2))
    y[rng.random(steps) < 0.4] = np.nan
    y[steps // 2] = 0.5
    cov = np.array([[0.02, 0.001], [0.001, 0.003]])
    for before in (None, (np.array([[0.1, 0.01], [0.9, 0.0]]), cov)):
        for after in (None, (np.array([[3.0, 1.0], [2.0, 0.5]]), np.linalg.inv(cov))):
            want, var = regrid.smooth(t[None], y[None], np.ones((1, steps), bool), 1e-3, 4e-4, [(0, *before)] if before else None, [(0, *after)] if after else None)
            got, v = regrid.smooth_long(t, y, 1e-3, 4e-4, before, after)
            assert np.allclose(got, want[0], atol=1e-7) and np.allclose(v, var[0], atol=1e-8)


def test_smoother_against_dense_least_squares():
    """The smoothed mean equals the posterior mean of the same Gaussian model solved densely."""
    t = np.array([0.0, 1.0, 2.5, 3.0, 7.0])
    y = np.array([1.0, np.nan, 2.0, 2.2, 5.0])
    q, r = 0.01, 0.04
    n = len(t)
    mean, prec, rhs = np.zeros(2 * n), np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    prec[0, 0] += 1e-4
    prec[1, 1] += 1e-2
    rhs[0] += 1e-4 * y[0]
    for i in range(1, n):
        d = t[i] - t[i - 1]
        a = np.array([[1, d], [0, 1]])
        w = np.linalg.inv(q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]]))
        j = np.hstack([-a, np.eye(2)])
        prec[2 * i - 2 : 2 * i + 2, 2 * i - 2 : 2 * i + 2] += j.T @ w @ j
    for i in range(n):
        if not np.isnan(y[i]):
            prec[2 * i, 2 * i] += 1 / r
            rhs[2 * i] += y[i] / r
    mean = np.linalg.solve(prec, rhs)
    got, var = regrid.smooth(t[None, :], y[None, :, None], np.ones((1, n), bool), q, r)
    assert np.allclose(got[0, :, 0], mean[::2], atol=1e-6)
    assert np.allclose(var[0], np.diag(np.linalg.inv(prec))[::2], atol=1e-6)


@pytest.mark.parametrize(("per", "fan"), [(150_000, 16), (60, 2), (30, 3)])
def test_tree_profile(spark, per, fan):
    df = spark.read.parquet(f"{D}/animal_points.parquet")
    df = df.unionByName(df.limit(7).withColumn("traj_id", F.lit(None).cast("string")))
    got = {r["traj_id"]: r for r in tree.tree_profile(df, rows_per_partition=per, fan_in=fan).collect()}
    p = df.toPandas().sort_values(["DateTime", "row_id"])
    assert set(got) == set(p.traj_id.where(p.traj_id.notna(), None))
    for k, g in p.dropna(subset=["traj_id"]).groupby("traj_id"):
        q = g[g.lat.notna() & g.lon.notna()]
        path = brute.haversine_m(q.lat.values[:-1], q.lon.values[:-1], q.lat.values[1:], q.lon.values[1:]).sum()
        r = got[k]
        assert (r["n_rows"], r["n_points"]) == (len(g), len(q))
        assert r["distance_m"] == pytest.approx(path, rel=1e-9)
        assert r["duration_s"] == (q.DateTime.max() - q.DateTime.min()).total_seconds()
    assert got[None]["n_rows"] == 7


PING = "row_id long, traj_id string, DateTime timestamp_ntz, lat double, lon double"


@pytest.mark.parametrize("kind", ["empty", "nulls", "one"])
def test_defined_results_on_odd_tables(spark, kind):
    t = dt.datetime(2024, 1, 1)
    data = {"empty": [], "nulls": [(None, None, None, None, None), (1, "a", None, 1.0, 1.0), (2, None, t, 1.0, 1.0), (3, "a", t, float("nan"), 1.0)], "one": [(1, "a", t, 1.0, 1.0)]}[kind]
    extra = {"k": F.lit("x"), "t": F.lit(1), "r": F.lit(2), "v": F.lit(3), "_block": F.lit(4), "slot": F.lit("s"), "x": F.create_map(F.lit("a"), F.lit(1))}
    pings = spark.createDataFrame(data, PING).withColumns(extra)
    assert stops.stops_and_trips(pings).count() == 0
    assert regrid.regular_grid(pings).count() == (kind == "one")
    assert tree.tree_profile(pings).count() == {"empty": 0, "nulls": 2, "one": 1}[kind]
    cars = pings.withColumns({"Speed": F.lit(None).cast("double"), "Acceleration": F.lit(50.0)})
    assert spikes.implausible(cars, problems.CAR_BOUNDS).count() == {"empty": 0, "nulls": 2, "one": 1}[kind]
    assert rolling.trailing_totals(pings.withColumn("Distance", F.lit(1.0))).count() == {"empty": 0, "nulls": 1, "one": 1}[kind]
    about = spark.createDataFrame([], "station_id int, time_zone string, date_order string")
    fixes = pings.select(F.col("row_id").alias("fix_id"), F.lit(None).cast("int").alias("station_id"), F.lit(None).cast("string").alias("DateTime"), F.col("DateTime").alias("received_at"))
    assert timestamps.normalise_timestamps(fixes, about).where("status = 'none'").count() == len(data)
    people = pings.withColumn("point_id", F.col("row_id")).withColumn("id", F.col("traj_id"))
    none = spark.createDataFrame([], "region_id long, ring int, vertex_no int, lat double, lon double")
    assert spatial.near_and_inside(people, none).count() == 0
