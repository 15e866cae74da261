from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom.operators import briefings, entities, quality, risk, trends
from newsloom.plans import nightly, tiers
from newsloom.plans.filters import EventFilter
from newsloom.plans.mapview import map_view
from tests.conftest import event_rows

WHOLE = EventFilter(start_date=date(2024, 1, 1), end_date=date(2024, 1, 5))
WORLD = {"north": 90.0, "south": -90.0, "east": 180.0, "west": -180.0}


def pairs(frame, key="name", value="count"):
    return {row[key]: row[value] for row in frame.collect()}


def test_top_people(events):
    f = EventFilter(start_date=date(2024, 1, 1), end_date=date(2024, 1, 3))
    people = pairs(entities.top_people(events, f, 5))
    assert people == {
        "Vladimir Putin": 500, "Volodymyr Zelenskyy": 500, "Joe Biden": 100, "Xi Jinping": 100, "Rishi Sunak": 50,
    }
    doubled = events.unionByName(events)
    assert pairs(entities.top_people(doubled, f, 1, "events")) == {"Joe Biden": 1}
    assert pairs(entities.top_people(doubled, f, 1, "rows")) == {"Joe Biden": 2}


def test_top_sources(events):
    assert pairs(entities.top_sources(events, WHOLE, 5)) == {"example.com": 3, "bbc.com": 1, "example.org": 1}


def test_region_entities(events):
    rows = entities.region_entities(events, "us", WHOLE).orderBy("kind", "rank").collect()
    assert [(r.kind, r.rank, r.name) for r in rows] == [
        ("organizations", 1, "UN"), ("organizations", 2, "WHO"),
        ("persons", 1, "Joe Biden"), ("persons", 2, "Xi Jinping"),
        ("themes", 1, "LEGISLATION"), ("themes", 2, "POLITICS"),
    ]


def test_daily_counts_and_trend(events):
    first = trends.daily_counts(events, WHOLE).first()
    assert tuple(first) == (date(2024, 1, 1), 2, -5.0, 600, -3.5)
    assert [tuple(r) for r in trends.daily_trend(events, WHOLE).collect()][:3] == [
        ("2024-01-01", 2, 1), ("2024-01-02", 1, 0), ("2024-01-03", 1, 1),
    ]


def test_last_days_are_the_newest_oldest_first(events):
    days = [r.date.day for r in trends.last_days(trends.daily_counts(events, WHOLE), 2).collect()]
    assert days == [3, 4]


def test_map_grid_prefers_the_frequent_country(spark):
    rows = [
        {"GLOBALEVENTID": i, "SQLDATE": 20240101, "ActionGeo_Lat": 10.04, "ActionGeo_Long": 20.04, "ActionGeo_CountryCode": c}
        for i, c in enumerate(["B", "A", "A", None, None, None, "B"])
    ]
    cell = trends.map_grid(event_rows(spark, rows), WORLD, EventFilter(), 1).collect()
    assert [(c.lat, c.lon, c.country_code, c.intensity) for c in cell] == [(10.0, 20.0, "A", 7)]


def test_country_risk(events):
    row = risk.country_risk(events, "ua", WHOLE).first()
    # 100 * 0.4 + 100 * 0.35 + (8.5 + 30) / 60 * 100 * 0.25 = 91.04
    assert (row.total_events, row.conflict_ratio, row.score) == (1, 1.0, 91)
    none = risk.country_risk(events, "XX", WHOLE).first()
    assert (none.total_events, none.conflict_ratio, none.avg_tone, none.total_mentions) == (0, 0.0, None, 0)


def test_pulse(events, names):
    row = risk.global_pulse(events, WHOLE, names, min_tone_events=1).first()
    assert row.total_events == 5 and row.most_active_country == "BR" and row.most_active_count == 1
    assert row.most_active_display == "BR"
    assert row.most_hostile_country == "IL" and row.most_hostile_display == "Israel (IL)"
    assert row.avg_global_tone == pytest.approx(-1.9) and row.global_conflict_ratio == pytest.approx(0.4)
    empty = risk.global_pulse(events.where("1 = 0"), WHOLE, names).first()
    assert empty.total_events == 0 and empty.most_active_country is None and empty.avg_global_tone is None


def test_threats(events, names):
    rows = risk.top_threats(events, WHOLE, names, limit=2).collect()
    assert [r.country_code for r in rows] == ["UA", "IL"]
    assert rows[0].band == "CRITICAL" and rows[0].country_display == "Ukraine (UA)"
    assert risk.median_score(risk.top_threats(events, WHOLE, names)).first()[0] is not None


def _many(spark, per_day):
    rows, at = [], 0
    for (country, day), count in per_day.items():
        for _ in range(count):
            at += 1
            rows.append({"GLOBALEVENTID": at, "SQLDATE": day, "ActionGeo_CountryCode": country, "QuadClass": 4 if at % 2 else 1,
                         "EventRootCode": "19" if at % 3 else "04", "GoldsteinScale": -2.0, "AvgTone": -3.0,
                         "NumMentions": 1, "NumSources": 1})
    return event_rows(spark, rows)


def test_weekly_deltas_keep_the_uneven_windows(spark):
    # Anchor 15: current 8..15, before 1..7.
    events = _many(spark, {("A", 20240115): 1, ("A", 20240108): 3, ("A", 20240107): 2, ("A", 20240101): 2, ("B", 20240103): 5})
    rows = pairs(risk.weekly_deltas(events), "country_code", "event_delta_pct")
    assert rows == {"A": 0.0, "B": -100.0}
    even = pairs(risk.weekly_deltas(events, symmetric=True), "country_code", "event_delta_pct")
    assert even == {"A": -80.0, "B": -100.0}


def test_spikes(spark, names):
    events = _many(
        spark,
        {("US", 20240110): 9, ("US", 20240109): 5, ("US", 20240108): 7, ("US", 20240101): 100,
         ("IL", 20240110): 9, ("IL", 20240105): 1, ("UA", 20240110): 50},
    )
    rows = risk.activity_spikes(events, names).collect()
    assert [(r.country_code, r.events_24h, r.baseline_avg, r.spike_ratio) for r in rows] == [("US", 14, 1.0, 14.0)]
    assert rows[0].top_cameo_root == "19"


def test_alerts_name_each_country_once(spark):
    spikes = spark.createDataFrame([("A", 2.5)], "country_code string, spike_ratio double")
    found = spark.createDataFrame(
        [("A", True, "r"), ("B", True, "s"), ("C", False, None)], "country_code string, is_anomaly boolean, reason string"
    )
    assert pairs(risk.alerts(spikes, found), "country_code", "kind") == {"A": "spike", "B": "anomaly"}
    grid = spark.createDataFrame([(1.0, 2.0, "B"), (3.0, 4.0, "C")], "lat double, lon double, country_code string")
    assert [tuple(r) for r in risk.anomalous_cells(grid, found).collect()] == [(1.0, 2.0, "B", "s")]


def test_theme_counts_take_the_first_category_and_keep_zeros(spark):
    rows = [
        {"GLOBALEVENTID": 1, "SQLDATE": 20240101, "themes": ["econ_trade", "TERROR_OIL", "NOTHING"]},
        {"GLOBALEVENTID": 2, "SQLDATE": 20240101, "themes": ["TERROR"]},
    ]
    counts = pairs(trends.theme_category_counts(event_rows(spark, rows)), "category", "event_count")
    assert len(counts) == 8
    assert {k: v for k, v in counts.items() if v} == {"ECONOMY": 1, "ENERGY": 1, "SECURITY": 1}


def test_ingestion_stats(events):
    assert tuple(trends.ingestion_stats(events).first()) == (5, 4, "2024-01-04T00:00:00")
    assert tuple(trends.ingestion_stats(events.where("1 = 0")).first()) == (0, 0, None)


def test_merged_tiers(spark):
    shape = "date date, count long, avg_goldstein_scale double, total_mentions long, avg_tone double"
    hot = spark.createDataFrame([(date(2024, 1, 2), 100, -1.0, 1000, None)], shape)
    cold = spark.createDataFrame([(date(2024, 1, 2), 10, 10.0, 50, 4.0), (date(2024, 1, 1), 1, None, 1, None)], shape)
    rows = tiers.merge_daily_counts(hot, cold).collect()
    assert [r["count"] for r in rows] == [1, 110]
    assert rows[1].avg_goldstein_scale == 0.0 and rows[1].avg_tone == 4.0 and rows[0].avg_tone is None
    cells = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, intensity double")
    other = spark.createDataFrame([(1.0, 2.0, 4.0, "US")], "lat double, lon double, intensity double, country_code string")
    assert [tuple(r) for r in tiers.merge_grids(cells, other).collect()] == [(1.0, 2.0, 7.0)]


def test_routes():
    cutoff = date(2024, 1, 10)
    assert tiers.route(date(2024, 1, 10), date(2024, 1, 12), cutoff) == "hot"
    assert tiers.route(date(2024, 1, 1), date(2024, 1, 9), cutoff) == "cold"
    assert tiers.route(date(2024, 1, 1), date(2024, 1, 10), cutoff) == "hybrid"


def test_event_from_tiers_prefers_hot(events):
    cold = events.withColumn("NumMentions", F.lit(1).cast("bigint"))
    assert tiers.event_from_tiers(events, cold, 101).first().num_mentions == 100
    assert tiers.event_from_tiers(events.where("GLOBALEVENTID > 101"), cold, 101).first().num_mentions == 1


def test_summary_and_briefings(spark, events):
    rows = briefings.country_summaries(events).where("country_code = 'UA'").collect()
    assert rows[0].summary == (
        "Country UA. Recent events: 1. Avg Goldstein: -10.00. Avg tone: -8.50. Total mentions: 500. "
        "Total sources: 50. Top root codes: 19."
    )
    texts = spark.createDataFrame(
        [("UA", "A sound text."), ("US", "It is UNABLE to Verify this.")], "country_code string, text string"
    )
    sources = pairs(briefings.country_briefings(events, texts), "country_code", "source")
    assert sources == {"UA": "supplied", "US": "template_after_check", "GB": "template", "IL": "template", "BR": "template"}


def test_quality_funnel(spark):
    rows = spark.createDataFrame(
        [("1", "20240101", "01", "5", "9"), ("1", "20240101", "01", "5", "9"), ("2", "20240101", None, "5", "9"),
         ("3", "x", "01", "5", "9"), ("4", "20240101", "01", "5", "2"), ("5", "20240101", "01", "11", "9")],
        "GLOBALEVENTID string, SQLDATE string, EventRootCode string, GoldsteinScale string, NumMentions string",
    )
    assert tuple(quality.quality_funnel(rows).first()) == (6, 5, 4, 3, 2, 1)


def test_map_view_changes_at_zoom_nine(events):
    cells, grid = map_view(events, WORLD, 0.5, EventFilter())
    assert cells and grid.columns == ["lat", "lon", "country_code", "intensity"] and grid.count() == 5
    cells, rows = map_view(events, WORLD, 9, EventFilter())
    assert not cells and len(rows.columns) == 23 and rows.first().num_mentions == 1000


def test_nightly_tables_are_cached(spark, events, names, tmp_path):
    folder = str(tmp_path / "cache")
    assert nightly.cached(spark, folder, "anomalies").count() == 0
    nightly.run_nightly(events, names, folder)
    sizes = {name: nightly.cached(spark, folder, name).count() for name in nightly.CACHES}
    # Two countries had a conflict on one day each: a flat line of 30 days. No country has 14 days.
    assert sizes == {"forecasts": 60, "briefings": 5, "anomalies": 0, "theme_categories": 8}
    assert nightly.cached(spark, folder, "forecasts").first().model_type == "naive_fallback"


def test_storage_metrics(spark, events, tmp_path):
    path = tmp_path / "files"
    events.coalesce(1).write.parquet(str(path))
    events.where("GLOBALEVENTID < 103").coalesce(1).write.mode("append").parquet(str(path))
    sizes = [f.stat().st_size for f in path.glob("*.parquet")]
    row = quality.storage_metrics(spark.read.parquet(str(path))).first()
    assert (row.files, row.total_bytes, row.total_rows) == (2, sum(sizes), 7)
    assert (row.oldest_sqldate, row.newest_sqldate, row.days_of_data, row.rows_per_day) == (20240101, 20240104, 3, 2)
    assert row.bytes_per_row == pytest.approx(round(sum(sizes) / 7, 1))


def test_clean_events_are_those_the_funnel_keeps(spark):
    rows = event_rows(spark, [
        {"GLOBALEVENTID": 1, "SQLDATE": 20240101, "EventRootCode": "01", "GoldsteinScale": 1.0, "NumMentions": n} for n in (1, 5, 2)
    ])
    assert quality.quality_funnel(rows).first().kept == 1
    assert [r.NumMentions for r in quality.clean_events(rows).collect()] == [5]
    assert quality.clean_events(rows).columns == rows.columns


def test_tiers_merge_before_they_cut(spark):
    def cells(*values):
        return spark.createDataFrame(values, "lat double, lon double, country_code string, intensity bigint")

    hot, cold = cells((1.0, 1.0, "A", 3), (2.0, 2.0, "A", 2)), cells((2.0, 2.0, "A", 5), (1.0, 1.0, "B", 4), (3.0, 3.0, "B", 6))
    assert [tuple(r) for r in tiers.merge_grids(hot, cold, 1).collect()] == [(1.0, 1.0, 7.0)]
