import gzip
import re
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from newsloom.functions.text import entity_list
from newsloom.plans import enrichment
from newsloom.schema import (
    ENRICHED_COLUMNS, ENRICHED_SCHEMA, EVENT_POSITIONS, EVENT_POSITIONS_61, RAW_EVENT_COLUMNS,
)
from newsloom.sources import backfill, landed, lookups, store
from newsloom.streaming import feeds
from tests.conftest import event_rows, plan, tree

LINE = {
    0: "1001", 1: "20260318", 2: "202603", 3: "2026", 7: "IND", 17: "PAK", 12: "GOV", 22: "MIL", 26: "190", 27: "19",
    28: "19", 29: "4", 30: "-8.5", 31: "15", 32: "3", 34: "-4.2", 37: "IND", 44: "PAK", 51: "IND", 53: "23.03",
    54: "72.58", 57: "https://example.com",
}


def line(values, width=58):
    return "\t".join(values.get(at, "") for at in range(width))


def test_columns():
    assert len(ENRICHED_COLUMNS) == 27 and len(RAW_EVENT_COLUMNS) == 22
    assert set(EVENT_POSITIONS) == set(RAW_EVENT_COLUMNS) == set(EVENT_POSITIONS_61)


def test_event_lines_to_typed_rows(spark, tmp_path):
    with gzip.open(tmp_path / "a.CSV.gz", "wt") as out:
        out.write(line(LINE) + "\n" + line({**LINE, 0: "1002", 30: "bad"}) + "\n" + line({0: "1003"}, 40) + "\n")
    rows = landed.conform(landed.landed_events(landed.read_lines(spark, str(tmp_path)))).orderBy("GLOBALEVENTID").collect()
    assert [r.GLOBALEVENTID for r in rows] == [1001, 1002, 1003]
    assert rows[0].SQLDATE == 20260318 and rows[0].EventBaseCode == "19" and rows[0].GoldsteinScale == -8.5
    assert rows[0].SOURCEURL == "https://example.com" and rows[0].ActionGeo_Lat == 23.03 and rows[0].themes == []
    assert rows[1].GoldsteinScale is None and rows[2].SOURCEURL is None and rows[2].mentions_count is None


def test_other_layout(spark):
    values = {**{k: v for k, v in LINE.items() if k < 50}, 53: "IN", 56: "1.5", 57: "2.5", 60: "https://e.org"}
    lines = spark.createDataFrame([(line(values, 61),)], "value string")
    row = landed.conform(landed.landed_events(lines, EVENT_POSITIONS_61)).first()
    assert (row.ActionGeo_CountryCode, row.ActionGeo_Lat, row.ActionGeo_Long, row.SOURCEURL) == ("IN", 1.5, 2.5, "https://e.org")


def test_manifest(spark):
    lines = spark.createDataFrame(
        [(1, "123 h http://x/mentions.csv"), (2, " 456 h http://x/old.export.CSV.zip "), (3, "456 h http://x/export.CSV.zip"),
         (4, "7 h http://x/a.GKG.csv.zip"), (5, ""), (6, "8 h http://x/a.mentions.CSV.zip")], "at int, value string"
    )
    urls = {r.kind: r.url for r in landed.manifest_urls(lines, "at").collect()}
    assert urls == {
        "events": "http://x/export.CSV.zip", "entities": "http://x/a.GKG.csv.zip", "mentions": "http://x/a.mentions.CSV.zip",
    }


def test_entity_list(spark):
    rows = spark.createDataFrame([("ECONOMY,0.8;POLITICS,0.6;",), (None,), (" b,1; ;\ta ;b",)], "v string")
    got = [tuple(r) for r in rows.select(entity_list(F.col("v")), entity_list(F.col("v"), True)).collect()]
    assert got == [(["ECONOMY", "POLITICS"], ["ECONOMY", "POLITICS"]), ([], []), (["b", "a", "b"], ["a", "b"])]


def _feeds(spark):
    events = event_rows(
        spark,
        [{"GLOBALEVENTID": 1, "SQLDATE": 20240101, "SOURCEURL": "u1"}, {"GLOBALEVENTID": 2, "SQLDATE": 20240101, "SOURCEURL": "u9"},
         {"GLOBALEVENTID": 3, "SQLDATE": 20240101, "SOURCEURL": None}],
    ).select(RAW_EVENT_COLUMNS)
    mentions = spark.createDataFrame(
        [(1, "u2", "50", 2), (1, "u1", "70", 3), (1, "u3", "x", 1), (2, "u2", "10", 4)],
        "GLOBALEVENTID long, MentionIdentifier string, Confidence string, seq int",
    )
    documents = spark.createDataFrame(
        [("u1", "B,1;A,2;B,3", "P", None), ("u1", "Z", "P", None), ("u3", "C;", "", "O,1"), (None, "X", "X", "X")],
        "DocumentIdentifier string, Themes string, Persons string, Organizations string",
    )
    return events, mentions, documents


def test_batch_enrichment_keeps_every_event_once(spark):
    rows = enrichment.enrich_batch(*_feeds(spark)).orderBy("GLOBALEVENTID").collect()
    assert [r.GLOBALEVENTID for r in rows] == [1, 2, 3]
    assert (rows[0].themes, rows[0].persons, rows[0].organizations) == (["A", "B", "Z"], ["P"], [])
    assert (rows[0].mentions_count, rows[0].avg_confidence) == (3, 60.0)
    assert (rows[2].themes, rows[2].mentions_count, rows[2].avg_confidence) == ([], 0, None)


def test_stream_enrichment_follows_the_first_mention(spark):
    events, mentions, documents = _feeds(spark)
    rows = enrichment.enrich_stream(events, mentions, documents, F.col("seq")).orderBy("GLOBALEVENTID").collect()
    assert (rows[0].themes, rows[0].organizations, rows[0].mentions_count) == (["C"], ["O"], 3)
    assert rows[1].themes == [] and rows[2].mentions_count is None


def test_enrichment_of_a_hot_url_without_broadcast(spark):
    """A third of the events share a URL and another third has none; nothing is lost."""
    events = spark.range(3000).select(
        F.col("id").alias("GLOBALEVENTID"), F.lit(20240101).alias("SQLDATE"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), "id")).alias("SOURCEURL"),
    )
    _, mentions, _ = _feeds(spark)
    documents = spark.range(900).select(
        F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("DocumentIdentifier"),
        F.lit("T").alias("Themes"), F.lit("P").alias("Persons"), F.lit("O").alias("Organizations"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = enrichment.enrich_batch(events, mentions, documents)
        assert "Broadcast" not in plan(rows)
        assert rows.count() == 3000
        assert rows.where(F.size("themes") == 1).count() == 1000 + 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, 20260318), (2, 20260318), (3, 20260318)], "GLOBALEVENTID long, SQLDATE int")
    known = spark.createDataFrame([(2, 1), (3, 2)], "GLOBALEVENTID long, SQLDATE int")
    assert [r[0] for r in enrichment.drop_known(rows, enrichment.newest_ids(known)).collect()] == [1]
    assert [r[0] for r in enrichment.newest_ids(rows, 2).collect()] == [3, 2]
    left = enrichment.drop_days(rows.withColumn("SQLDATE", F.lit(7)), known.withColumn("SQLDATE", F.lit(7)))
    assert left.count() == 0


def test_keep_last_cuts_before_the_shuffle(spark):
    """One key with a third of all rows must not travel whole into one task."""
    rows = spark.range(9000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("GLOBALEVENTID"), F.col("id").alias("seq")
    )
    last = enrichment.keep_last(rows, F.col("seq"))
    text = plan(last)
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
    kept = {r.GLOBALEVENTID: r.seq for r in last.collect()}
    assert len(kept) == 6001 and kept[-1] == 8997


def test_write_and_read_days(spark, events, tmp_path):
    path = str(tmp_path / "days")
    store.write_days(events, path)
    stored = store.read_events(spark, path)
    assert stored.columns == [*ENRICHED_COLUMNS, "event_date"] and stored.count() == 5
    # Writing one day again replaces that day only.
    store.write_days(events.where("SQLDATE = 20240101").limit(1), path)
    assert store.read_events(spark, path).groupBy("SQLDATE").count().where("SQLDATE = 20240101").first()["count"] == 1
    assert store.read_events(spark, path).count() == 4
    day = store.one_day(stored, date(2024, 1, 3))
    assert day.columns == RAW_EVENT_COLUMNS and [r[0] for r in day.collect()] == [104]


def test_stored_days_are_pruned_and_filters_pushed(spark, events, tmp_path):
    from newsloom.operators.trends import country_volumes, daily_counts
    from newsloom.plans.filters import EventFilter

    path = str(tmp_path / "days")
    store.write_days(events, path)
    stored = store.read_events(spark, path)
    f = EventFilter(start_date=date(2024, 1, 2), end_date=date(2024, 1, 3), geo_country="GB")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    counts = daily_counts(stored, f)
    text = plan(counts)
    assert "PartitionFilters: [isnotnull(event_date" in text and "EqualTo(ActionGeo_CountryCode,GB)" in text
    read = next(part for part in text.split("ReadSchema: ") if part.startswith("struct<"))
    assert set(c.split(":")[0] for c in read[7:read.index(">")].split(",")) == {
        "SQLDATE", "GoldsteinScale", "NumMentions", "AvgTone", "ActionGeo_CountryCode",
    }
    # A window counted from the newest day prunes too, once the subquery is known.
    newest = country_volumes(stored, 1)
    assert sorted(r.country_code for r in newest.collect()) == ["BR", "IL"]
    ran = tree(newest)
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= ", ran)
    assert "GreaterThanOrEqual(SQLDATE,ScalarSubquery" in ran or "DataFilters: [isnotnull(SQLDATE" in ran


def test_missing_or_empty_folder(spark, tmp_path):
    with pytest.raises(AnalysisException):
        store.read_events(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        store.read_events(spark, str(tmp_path / "empty"))


def test_older_files_get_null_columns(spark, events, tmp_path):
    events.drop("ActionGeo_Lat", "persons").write.parquet(str(tmp_path / "old"))
    row = store.read_events(spark, str(tmp_path / "old")).where("GLOBALEVENTID = 101").first()
    assert row.ActionGeo_Lat is None and row.persons == [] and row.ActionGeo_Long == -77.0


def test_backfill(spark, tmp_path):
    days = store.backfill_days(date(2024, 1, 20), 30, 2)
    assert len(days) == 30 and days[0] == date(2023, 12, 20) and days[-1] == date(2024, 1, 18)
    events, mentions, documents = _feeds(spark)
    on = F.to_date(F.lit("2024-01-01"))
    both = [t.withColumn("event_date", on) for t in (events, mentions, documents)]
    other = both[1].withColumn("event_date", F.to_date(F.lit("2024-01-02")))
    path = str(tmp_path / "days")
    store.ingest_days(both[0], both[1].unionByName(other), both[2], [date(2024, 1, 1), date(2024, 1, 3)], path)
    rows = store.read_events(spark, path).orderBy("GLOBALEVENTID").collect()
    # Mentions of another day do not count.
    assert [(r.GLOBALEVENTID, r.mentions_count) for r in rows] == [(1, 3), (2, 1), (3, 0)]


def _dated(spark, days, poison=None):
    """Feeds of some days, three events each; the events of `poison` lack a numeric id, as landed strings do."""
    events, mentions, documents = [], [], []
    for at, day in enumerate(days):
        for k in range(3):
            key = "x" if day == poison and k == 1 else str(10 * at + k)
            events.append((key, int(f"{day:%Y%m%d}"), f"u{at}", day))
            mentions.append((10 * at + k, f"u{at}", "50", day))
        documents.append((f"u{at}", "ECON_TRADE", "Ada", "UN", day))
    return (
        spark.createDataFrame(events, "GLOBALEVENTID string, SQLDATE int, SOURCEURL string, event_date date"),
        spark.createDataFrame(mentions, "GLOBALEVENTID bigint, MentionIdentifier string, Confidence string, event_date date"),
        spark.createDataFrame(documents, "DocumentIdentifier string, Themes string, Persons string, Organizations string, event_date date"),
    )


def test_backfill_outlives_a_bad_day(spark, tmp_path):
    path, days = str(tmp_path / "days"), [date(2024, 1, d) for d in range(1, 6)]
    feeds = _dated(spark, days[:4], poison=days[2])
    run = {r.event_date: r for r in backfill.backfill(*feeds, days, path).collect()}
    assert [run[day].state for day in days] == ["stored", "stored", "failed", "stored", "empty"]
    assert run[days[2]].problem == "event without a numeric id: 1 rows" and run[days[0]].files >= 1 and run[days[0]].bytes > 0
    assert sorted({r.SQLDATE for r in store.read_events(spark, path).collect()}) == [20240101, 20240102, 20240104]
    stored = {r.path for r in backfill.stored_files(spark, path).collect()}
    # The next run takes up the reported and the empty day only.
    again = {r.event_date: (r.attempt, r.state) for r in backfill.backfill(*_dated(spark, days[:4]), days, path).collect()}
    assert again == {days[2]: (2, "stored"), days[4]: (2, "empty")}
    assert stored < {r.path for r in backfill.stored_files(spark, path).collect()}
    states = {r.event_date: r.state for r in backfill.day_states(backfill.read_ledger(spark, path)).collect()}
    assert list(states.values()).count("stored") == 4 and store.read_events(spark, path).count() == 12
    assert backfill.backfill(*feeds, [], path).count() == 0


def test_backfill_isolates_a_day_whose_job_fails(spark, tmp_path):
    """Two days break the enrichment in a task, one cannot even be counted; the others are stored."""
    path, days = str(tmp_path / "days"), [date(2024, 1, d) for d in range(1, 8)]
    events, mentions, documents = _dated(spark, days)
    bad = F.col("event_date").isin(days[1], days[4])
    mentions = mentions.withColumn("Confidence", F.when(bad, F.raise_error(F.lit("corrupt file"))).otherwise(F.col("Confidence")))
    unread = F.when(F.col("event_date") == days[6], F.raise_error(F.lit("unreadable"))).otherwise(F.col("GLOBALEVENTID"))
    run = {r.event_date: r for r in backfill.backfill(events.withColumn("GLOBALEVENTID", unread), mentions, documents, days, path).collect()}
    assert [run[day].state for day in days] == ["stored", "failed", "stored", "stored", "failed", "stored", "failed"]
    assert "corrupt file" in run[days[1]].problem and "unreadable" in run[days[6]].problem
    assert len({r.SQLDATE for r in store.read_events(spark, path).collect()}) == 4


def test_backfill_that_stops_before_its_ledger_runs_again(spark, tmp_path):
    path, days = str(tmp_path / "days"), [date(2024, 1, 1), date(2024, 1, 2)]
    feeds = _dated(spark, days)
    store.ingest_days(*feeds, days, path)
    assert backfill.read_ledger(spark, path).count() == 0
    backfill.backfill(*feeds, days, path)
    assert store.read_events(spark, path).count() == 6


def test_buffer_days_are_retired(spark, events, tmp_path):
    path, held = str(tmp_path / "days"), str(tmp_path / "buffer")
    store.write_days(events, held)
    store.write_days(events.where("SQLDATE < 20240103"), path)
    stored, buffer = store.read_events(spark, path), store.read_events(spark, held)
    before = sorted(r[0] for r in store.with_buffer(stored, buffer).select("GLOBALEVENTID").collect())
    assert store.retire_buffer(spark, held, stored) == [date(2024, 1, 1), date(2024, 1, 2)]
    buffer = store.read_events(spark, held)
    assert buffer.count() == 2
    assert sorted(r[0] for r in store.with_buffer(stored, buffer).select("GLOBALEVENTID").collect()) == before
    assert store.retire_buffer(spark, held, stored) == [] and store.retire_buffer(spark, str(tmp_path / "none"), stored) == []


def test_buffer_gives_way_to_stored_days(events):
    stored = events.where("SQLDATE < 20240103").withColumn("NumMentions", F.lit(1).cast("bigint"))
    rows = store.with_buffer(stored, events).orderBy("GLOBALEVENTID").collect()
    assert [r.NumMentions for r in rows] == [1, 1, 1, 1000, 20]


def test_caches(spark, events, tmp_path):
    schema = "country_code string, score double"
    kind = spark.createDataFrame([], schema).schema
    assert store.read_cache(spark, str(tmp_path / "none"), kind).count() == 0
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        store.write_cache(spark.createDataFrame([("US", 1.5)], schema), path, form)
        assert [tuple(r) for r in store.read_cache(spark, path, kind, form).collect()] == [("US", 1.5)]
        store.write_cache(spark.range(3), path, form)
        assert store.read_cache(spark, path, kind, form).count() == 0


def test_lookup(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("CODE\tLABEL\n us \t United States\n\nXX\n\tnobody\nYY\t\nfr\tFrance\n")
    found = lookups.read_lookup(spark, str(tmp_path / "codes.txt"))
    assert sorted(map(tuple, found.collect())) == [("FR", "France"), ("US", "United States")]
    empty = found.where("1 = 0")
    assert lookups.prefer(empty, found, empty).count() == 2
    rows = spark.createDataFrame([("US",), ("ZZ",), (None,), ("",)], "code string")
    shown = [r.place_display for r in lookups.with_country_names(rows, found, "code", "place").collect()]
    assert sorted(shown) == ["US".join(["United States (", ")"]), "Unknown", "Unknown", "ZZ"]


def test_rows_without_a_day_are_kept(spark, tmp_path):
    """Writes and micro-batches with bad and missing days never take each other's rows."""
    path, streamed = str(tmp_path / "days"), str(tmp_path / "streamed")
    upsert = feeds.upsert_days(streamed)
    for at, day in enumerate((20240230, None, 20240231, 20240101, 20240101)):
        rows = event_rows(spark, [{"GLOBALEVENTID": at, "SQLDATE": day, "NumMentions": at}])
        store.write_days(rows, path)
        upsert(rows, at)
    upsert(event_rows(spark, []), 5)
    upsert(event_rows(spark, [{"GLOBALEVENTID": 2, "SQLDATE": 20240231, "NumMentions": 2}]), 2)
    assert [r.GLOBALEVENTID for r in store.read_events(spark, path).collect()] == [4]
    assert sorted(r.GLOBALEVENTID for r in spark.read.parquet(streamed).collect()) == [3, 4]
    for place in (path, streamed):
        assert sorted(r.GLOBALEVENTID for r in store.read_undated(spark, place).collect()) == [0, 1, 2]
    assert store.read_undated(spark, str(tmp_path / "none")).count() == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_lists_of_all_rows_of_a_document(spark):
    rows = [("u", None, "Ada", None), ("u", "ECON_TRADE,1;", "Ada", None), ("u", "TAX,2;ECON_TRADE,9", "Bob;Ada", None)]
    documents = spark.createDataFrame(rows, "DocumentIdentifier string, Themes string, Persons string, Organizations string")
    event = event_rows(spark, [{"GLOBALEVENTID": 1, "SQLDATE": 20240101, "SOURCEURL": "u"}])
    mention = spark.createDataFrame([(1, "u", "5")], "GLOBALEVENTID bigint, MentionIdentifier string, Confidence string")
    raw = event.drop("themes", "persons", "organizations", "mentions_count", "avg_confidence")
    got = enrichment.enrich_batch(raw, mention, documents).first()
    assert (got.themes, got.persons, got.organizations) == (["ECON_TRADE", "TAX"], ["Ada", "Bob"], [])
    got = enrichment.enrich_stream(raw, mention, documents).first()
    assert got.themes == ["ECON_TRADE"] and got.persons == ["Ada"]
