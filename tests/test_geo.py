import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.operators import geo
from newsloom.operators.rows import list_events
from newsloom.plans.filters import EventFilter
from tests.conftest import plan

PLACE = "place_id long, lat double, lon double, country_code string, state string, city string"


def _globe(lat, lon):
    phi, lam = math.radians(lat), math.radians(lon)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def _brute(points, places):
    found = {}
    for point in points:
        at = _globe(*point)
        found[point] = min(
            places, key=lambda p: (math.floor(1e12 * sum((a - b) ** 2 for a, b in zip(at, _globe(p[1], p[2])))), p[0])
        )[0]
    return found


def _cases():
    rng = random.Random(5)
    poles = [(90.0, 0.0), (90.0, 170.0), (-90.0, 10.0), (89.9, 180.0), (0.0, 180.0), (0.0, -180.0)]
    points = poles + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)]
    # A third of the points and of the places share one small region.
    points += [(48.8 + rng.random() / 50, 2.3 + rng.random() / 50) for _ in range(60)]
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    spots += [(48.8 + rng.random() / 50, 2.3 + rng.random() / 50) for _ in range(30)] + [(10.0, 10.0)] * 20
    return points, [(i, lat, lon, "C", f"S{i % 5}", f"T{i}") for i, (lat, lon) in enumerate(spots)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_nearest_place_equals_brute_force(spark, threshold):
    points, places = _cases()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        located = geo.nearest_places(
            spark.createDataFrame(points * 3 + [(None, 1.0)], "lat double, lon double"), spark.createDataFrame(places, PLACE)
        )
        found = {(r.lat, r.lon): r.place_id for r in located.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == _brute(points, places)


def test_one_far_place(spark):
    places = spark.createDataFrame([(7, 10.0, 20.0, "C", "S", "T")], PLACE)
    points = spark.createDataFrame([(-10.0, -160.0), (10.0, 20.0)], "lat double, lon double")
    assert [r.place_id for r in geo.nearest_places(points, places).collect()] == [7, 7]
    assert [r.place_id for r in geo.nearest_places(points, places.where("1 = 0")).collect()] == [None, None]


def test_far_points_open_few_cubes(spark):
    rng = random.Random(9)
    near = [(rng.gauss(40, 6), rng.gauss(10, 9)) for _ in range(3000)]
    points = [(rng.uniform(-80, -20), rng.uniform(-180, -100)) for _ in range(60)]
    places = [(i, lat, lon, "C", "S", "T") for i, (lat, lon) in enumerate(near)]
    asked = spark.createDataFrame(points, "lat double, lon double")
    index = geo.place_index(spark.createDataFrame(places, PLACE))
    opened = geo.cubes_to_open(asked.withColumn("place", F.lit(None)), index).join(index.near[geo.DESCENT_SIDES[-1]], "cube")
    assert opened.count() < 0.02 * len(points) * len(near)
    found = {(r.lat, r.lon): r.place_id for r in geo.nearest_places(asked, spark.createDataFrame(places, PLACE)).collect()}
    assert found == _brute(points, places)


def test_stored_index_equals_brute_force(spark, tmp_path):
    points, places = _cases()
    folder, asked = str(tmp_path / "index"), spark.createDataFrame(points, "lat double, lon double")
    geo.write_place_index(spark.createDataFrame(places[:50], PLACE), folder, 8)
    geo.write_place_index(spark.createDataFrame(places + [(999, None, 1.0, "C", "S", "T")], PLACE), folder, 8)
    # A new application knows the files only.
    for table in spark.catalog.listTables():
        if table.name.startswith("place_index"):
            spark.sql(f"DROP TABLE {table.name}")
    stored = geo.read_place_index(spark, folder)

    def found(index):
        return {(r.lat, r.lon): r.place_id for r in geo.nearest_places(asked, index).collect()}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(geo.nearest_places(asked, stored))
        assert found(stored) == _brute(points, places)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and "SelectedBucketsCount: 8 out of 8" in text


def test_stored_index_without_places(spark, tmp_path):
    geo.write_place_index(spark.createDataFrame([], PLACE), str(tmp_path), 2)
    points = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    found = geo.nearest_places(points, geo.read_place_index(spark, str(tmp_path))).collect()
    assert [(r.lat, r.place_id) for r in found] == [(1.0, None)]


def test_unfinished_index_is_not_read(spark, tmp_path):
    points, places = _cases()
    folder = str(tmp_path)
    geo.write_place_index(spark.createDataFrame(places, PLACE), folder, 2)
    # A write that stopped midway leaves a build that no row names.
    spark.createDataFrame([], "cube long").write.parquet(f"{folder}/build=0/near_0")
    asked = spark.createDataFrame(points[:20], "lat double, lon double")
    found = {(r.lat, r.lon): r.place_id for r in geo.nearest_places(asked, geo.read_place_index(spark, folder)).collect()}
    assert found == _brute(points[:20], places)


@pytest.fixture(scope="module")
def towns(spark):
    return spark.createDataFrame(
        [(1, 50.4, 30.5, "UA", "Kyiv City", "Kyiv"), (2, 51.5, -0.1, "GB", "England", "London"),
         (3, 38.9, -77.0, "US", "D.C.", "Washington"), (4, 31.7, 35.2, "IL", "Jerusalem", "Jerusalem"),
         (5, -15.7, -47.9, "BR", "Distrito", "Brasilia")], PLACE
    )


def test_place_filter(events, towns):
    def ids(**names):
        return [r.global_event_id for r in list_events(events, EventFilter(**names), towns).collect()]

    assert ids(geo_state=" kyiv city ") == [102]
    assert ids(geo_city="LONDON") == [103]
    assert ids(geo_state="England", geo_city="Kyiv") == []
    assert ids(geo_state="Nowhere") == []


def test_drill(events, towns, names):
    f = EventFilter(start_date=date(2024, 1, 1), end_date=date(2024, 1, 4))
    rows = geo.drill_countries(events, f, names, 2).collect()
    assert [(r.name, r.code, r.display) for r in rows] == [("BR", "BR", "BR"), ("GB", "GB", "GB")]
    assert [tuple(r) for r in geo.drill_places(events, f, towns, "ua").collect()] == [("Kyiv City", 1)]
    assert [tuple(r) for r in geo.drill_places(events, f, towns, "ua", "Kyiv City").collect()] == [("Kyiv", 1)]
    assert geo.drill_places(events, f, towns, "ua", "England").collect() == []
    assert geo.drill_available(events, f, "ua").first().state_available
    missing = geo.drill_available(events, f, "zz").first()
    assert not missing.state_available and "latitude" in missing.state_reason
