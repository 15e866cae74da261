from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.functions.dates import clamp_window, day_number, number_day, number_day_col
from newsloom.operators.rows import (
    detail_limit, detail_min_mentions, event_by_id, grid_digits, list_events, list_region_events,
    map_details, popular_events, snap_box,
)
from newsloom.plans.filters import (
    EventFilter, category_root_codes, in_box, in_theme_category, parse_root_codes, select_events,
)


def ids(frame, column="global_event_id"):
    return [row[column] for row in frame.collect()]


def test_limit_must_be_in_range():
    with pytest.raises(ValueError):
        EventFilter(limit=0)
    assert EventFilter(limit=None).limit is None and EventFilter(limit=1_000_000).limit == 1_000_000
    assert EventFilter().limit == 1000


def test_two_day_window_has_three_rows(events):
    f = EventFilter(start_date=date(2024, 1, 1), end_date=date(2024, 1, 2), limit=10)
    assert ids(list_events(events, f)) == [103, 102, 101]


def test_default_window_ends_at_newest_day(events):
    assert ids(list_events(events, EventFilter())) == [105, 104, 103, 102, 101]
    old = events.withColumn("SQLDATE", F.when(F.col("GLOBALEVENTID") == 101, 20231227).otherwise(F.col("SQLDATE")))
    assert 101 not in ids(list_events(old, EventFilter()))
    assert 101 in ids(list_events(old, EventFilter(start_date=date(2023, 12, 1))))
    assert ids(list_events(old, EventFilter(end_date=date(2023, 12, 30)))) == [101]


def test_country_is_actor_or_place(events):
    assert ids(list_events(events, EventFilter(country_code="us"))) == [101]
    assert ids(list_events(events, EventFilter(country_code="RU"))) == [102]
    assert ids(list_region_events(events, "ua", EventFilter())) == [102]
    assert ids(list_events(events, EventFilter(geo_country="ru"))) == []


def test_root_codes(events):
    assert parse_root_codes(" 19, ,01,") == ("19", "01")
    assert parse_root_codes(" , ") is None and parse_root_codes(None) is None
    assert category_root_codes("conflict") == ("18", "19", "20")
    assert category_root_codes("ALL") is None
    assert ids(list_events(events, EventFilter(event_root_codes=("19",)))) == [104, 102]


def test_themes(spark, events):
    assert ids(list_events(events, EventFilter(theme_category="security"))) == [104, 102]
    assert ids(list_events(events, EventFilter(theme_category="POPULAR_NEWS", limit=2))) == [105, 104]
    assert len(ids(list_events(events, EventFilter(theme_category="UNKNOWN")))) == 5
    # '_' stands for any one character and the joined list is searched as one text.
    odd = spark.createDataFrame([(["xECON"], 1), (["econ", "x"], 2), (["trade"], 3), ([], 4), (None, 5)],
                                "themes array<string>, id int")
    assert ids(odd.where(in_theme_category("ECONOMY")).orderBy("id"), "id") == [2, 3]


def test_box_over_the_date_line(spark):
    points = spark.createDataFrame(
        [(1, 0.0, 179.0), (2, 0.0, -179.0), (3, 0.0, 0.0), (4, 80.0, 179.0), (5, None, 1.0)],
        "id int, ActionGeo_Lat double, ActionGeo_Long double",
    )
    across = points.where(in_box(10, -10, 190, 170)).orderBy("id")
    assert ids(across, "id") == [1, 2]
    assert ids(points.where(in_box(10, -10, 190, 170, normalize=False)), "id") == [1]
    assert ids(points.where(in_box(90, -90, 180, -180)).orderBy("id"), "id") == [1, 2, 3, 4]
    assert ids(points.where(in_box(10, -10, 10, -10)), "id") == [3]


def test_event_by_id(events):
    found = event_by_id(events, 101).collect()
    assert len(found) == 1 and len(found[0]) == 19 and found[0]["sql_date"] == date(2024, 1, 1)
    assert event_by_id(events, 999).collect() == []


def test_popular_and_map_details(events):
    assert ids(popular_events(events, EventFilter())) == [104, 102, 101, 103, 105]
    box = {"north": 60.0, "south": 30.0, "east": 40.0, "west": -10.0}
    found = map_details(events, box, EventFilter(), min_mentions=100)
    assert len(found.columns) == 23
    assert ids(found) == [104, 102]


def test_zoom_rules():
    assert [grid_digits(z) for z in (0, 1, 3, 5, 7, 8.9, 9)] == [0, 1, 2, 3, 4, 4, None]
    assert detail_limit(9, 10_000) == 3000 and detail_limit(9, 100) == 100
    assert detail_limit(22, 10_000) == 500
    assert [detail_min_mentions(z) for z in (9, 5, 22)] == [1, 3, 1]
    box = {"north": 12.3, "south": -12.3, "east": 7.1, "west": -7.1}
    assert snap_box(box, 2) == {"north": 15, "south": -15, "east": 10, "west": -10}
    assert snap_box(box, 5) == {"north": 13, "south": -13, "east": 8, "west": -8}


def test_dates(spark):
    assert number_day(day_number(date(2024, 2, 29))) == date(2024, 2, 29)
    row = spark.range(1).select(number_day_col(F.lit(20240230)).alias("bad"), number_day_col(F.lit(20240229)).alias("good"))
    assert tuple(row.first()) == (None, date(2024, 2, 29))
    newest = date(2024, 1, 10)
    assert clamp_window(newest, 5, date(2024, 1, 8), date(2023, 1, 1)) == (date(2024, 1, 6), date(2024, 1, 8))
    assert clamp_window(newest, 0, None, None) == (newest, newest)


def test_place_filter_needs_places(events):
    with pytest.raises(ValueError):
        select_events(events, EventFilter(geo_state="Kyiv"))
