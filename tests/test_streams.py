import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.session import work_dir
from newsloom.streaming import feeds
from tests.conftest import event_rows, plan

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def land(spark, folder, name, rows):
    """One Parquet file of events; `minute` counts from the first of January."""
    events = event_rows(
        spark,
        [{"SQLDATE": int(f"{START + timedelta(minutes=r['minute']):%Y%m%d}"), "NumMentions": 1, "NumSources": 1,
          "ActionGeo_CountryCode": "US", **{k: v for k, v in r.items() if k != "minute"}} for r in rows],
    )
    times = spark.createDataFrame(
        [(r["GLOBALEVENTID"], START + timedelta(minutes=r["minute"])) for r in rows], "GLOBALEVENTID long, event_time timestamp"
    ).distinct()
    events.join(times, "GLOBALEVENTID").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/*").schema
    return feeds.stream_files(spark, f"{folder}/*", schema, files_per_batch=1)


def run(spark, rows, tmp_path, name):
    feeds.append_to(rows, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name)).collect()


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, "a", [{"GLOBALEVENTID": 1, "minute": 0}, {"GLOBALEVENTID": 2, "minute": 1}])
    land(spark, folder, "b", [{"GLOBALEVENTID": 2, "minute": 5}, {"GLOBALEVENTID": 3, "minute": 6}])
    rows = run(spark, feeds.first_seen(stream(spark, folder)).select("GLOBALEVENTID"), tmp_path, "once")
    assert sorted(r[0] for r in rows) == [1, 2, 3]


def test_upsert_keeps_the_last_row_and_other_days(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "days")
    checkpoint = str(tmp_path / "checkpoint")

    def upsert():
        events = stream(spark, folder).drop("event_time")
        feeds.upsert_stream(events, path, checkpoint).start().awaitTermination()

    land(spark, folder, "a", [{"GLOBALEVENTID": 1, "minute": 0, "NumMentions": 5}, {"GLOBALEVENTID": 9, "minute": 3000}])
    upsert()
    land(spark, folder, "b", [{"GLOBALEVENTID": 1, "minute": 0, "NumMentions": 2}, {"GLOBALEVENTID": 2, "minute": 4}])
    upsert()
    stored = feeds.read_upserted(spark, path)
    rows = {r.GLOBALEVENTID: (r.NumMentions, str(r.event_date)) for r in stored.collect()}
    assert rows == {1: (2, "2024-01-01"), 2: (1, "2024-01-01"), 9: (1, "2024-01-03")}
    # A batch that is run again leaves the table as it is, and touches no other batch's files.
    same = {"SQLDATE": 20240101, "NumSources": 1, "ActionGeo_CountryCode": "US"}
    again = event_rows(spark, [{"GLOBALEVENTID": 1, "NumMentions": 2, **same}, {"GLOBALEVENTID": 2, "NumMentions": 1, **same}])

    def first_files():
        return {file for file in spark.read.parquet(path).inputFiles() if "ingest_seq=0" in file}

    first = first_files()
    for _ in range(2):
        feeds.upsert_days(path)(again, 1)
    assert {r.GLOBALEVENTID: (r.NumMentions, str(r.event_date)) for r in feeds.read_upserted(spark, path).collect()} == rows
    assert first and first == first_files()
    assert feeds.read_upserted(spark, str(tmp_path / "none")).count() == 0


def test_upserted_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    feeds.upsert_days(path)(event_rows(spark, [{"GLOBALEVENTID": k, "SQLDATE": 20240101 + k % 3} for k in range(9)]), 0)
    text = plan(feeds.read_upserted(spark, path).where("event_date = DATE '2024-01-02'"))
    assert re.search(r"PartitionFilters: \[[^]]*\(event_date#\d+ = 2024-01-02\)", text) and "Filter (event_date" not in text


def batch_of(spark, *rows):
    """Events (id, day, mentions)."""
    return event_rows(spark, [{"GLOBALEVENTID": i, "SQLDATE": day, "NumMentions": n, "NumSources": 1} for i, day, n in rows])


def seen(spark, path):
    return sorted(((r.GLOBALEVENTID, str(r.event_date), r.NumMentions) for r in feeds.read_upserted(spark, path).collect()), key=lambda r: (str(r[0]), r[1:]))


def files_below(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


MOVES = [
    [(1, 20240101, 1), (2, 20240101, 1), (3, 20240102, 1)],
    # Event 1 moves on, event 2 is repeated, and one batch names two days for event 4.
    [(1, 20240105, 2), (2, 20240101, 7), (4, 20240101, 1), (4, 20240103, 9)],
    # Event 1 moves back, event 3 leaves the table's days, ids far apart.
    [(1, 20240101, 3), (5 << 30, 20240102, 1), (-7, 20240102, 1)],
    [(5 << 30, 20240103, 2), (3, 20240106, 4)],
]
MOVED = sorted([(1, "2024-01-01", 3), (2, "2024-01-01", 7), (3, "2024-01-06", 4), (4, "2024-01-03", 9), (5 << 30, "2024-01-03", 2), (-7, "2024-01-02", 1)], key=lambda r: (str(r[0]), r[1:]))


def test_an_event_whose_day_changes_stands_once(spark, tmp_path):
    path = str(tmp_path / "days")
    for at, rows in enumerate(MOVES):
        feeds.upsert_days(path)(batch_of(spark, *rows), at)
    assert seen(spark, path) == MOVED
    # A batch that is run again changes nothing, whichever it is.
    feeds.upsert_days(path)(batch_of(spark, *MOVES[3]), 3)
    assert seen(spark, path) == MOVED
    day = feeds.read_upserted(spark, path).where("event_date = DATE '2024-01-05'")
    assert day.count() == 0


def test_a_batch_is_seen_when_it_is_committed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "days")
    feeds.upsert_days(path)(batch_of(spark, *MOVES[0]), 0)
    before = seen(spark, path)
    for broken in ("_write_keys", "commit"):
        def stop(*_):
            raise RuntimeError("stopped")

        with monkeypatch.context() as patch:
            patch.setattr(feeds, broken, stop)
            with pytest.raises(RuntimeError):
                feeds.upsert_days(path)(batch_of(spark, *MOVES[1]), 1)
        assert seen(spark, path) == before
    for at in (1, 2, 3):
        feeds.upsert_days(path)(batch_of(spark, *MOVES[at]), at)
    assert seen(spark, path) == MOVED
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_compaction_is_safe_to_stop_anywhere(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "days")
    for at, rows in enumerate(MOVES[:3]):
        feeds.upsert_days(path)(batch_of(spark, *rows), at)
    before, files = seen(spark, path), files_below(path)
    # Stopped after the bases are written and before they count.
    from newsloom.sources import batches

    with monkeypatch.context() as patch:
        patch.setattr(batches, "merged_path", lambda folder: f"{folder}\0")
        with pytest.raises(Exception):
            feeds.compact_upserted(spark, path)
    assert seen(spark, path) == before
    feeds.compact_upserted(spark, path)
    assert seen(spark, path) == before and files_below(path) == files
    assert feeds.retire_upserted(spark, path) > 0
    assert seen(spark, path) == before and files_below(path) < files
    # Later batches and a second round find the keys and tombstones they need.
    feeds.upsert_days(path)(batch_of(spark, *MOVES[3]), 3)
    assert seen(spark, path) == MOVED
    feeds.compact_upserted(spark, path)
    feeds.retire_upserted(spark, path)
    assert seen(spark, path) == MOVED and feeds.retire_upserted(spark, path) == 0
    text = plan(feeds.read_upserted(spark, path).where("event_date = DATE '2024-01-02'"))
    assert len(re.findall(r"PartitionFilters: \[[^]]*\(event_date#\d+ = 2024-01-02\)", text)) >= 2
    feeds.compact_upserted(spark, str(tmp_path / "none"))
    assert feeds.retire_upserted(spark, str(tmp_path / "none")) == 0


def test_keys_are_read_by_range(spark, tmp_path):
    path = str(tmp_path / "days")
    feeds.upsert_days(path)(batch_of(spark, *[(k << 20, 20240101, 1) for k in range(20)]), 0)
    asked = spark.createDataFrame([(3 << 20,), (None,)], "GLOBALEVENTID bigint")
    found = feeds.known_days(spark, path, asked, 0)
    assert [(r[0], str(r[1])) for r in found.collect()] == [(3 << 20, "2024-01-01")]
    assert re.search(r"PartitionFilters: \[[^]]*id_range#\d+L? = 3", plan(found))


def test_repeats_are_dropped_however_late(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "days")

    def run_stream():
        events = feeds.first_seen(stream(spark, folder)).drop("event_time")
        feeds.unseen_stream(events, path, str(tmp_path / "checkpoint")).start().awaitTermination()

    land(spark, folder, "a", [{"GLOBALEVENTID": 1, "minute": 0, "NumMentions": 5}, {"GLOBALEVENTID": 2, "minute": 1}])
    land(spark, folder, "b", [{"GLOBALEVENTID": 3, "minute": 9 * 1440}])
    run_stream()
    # Ten days on, behind any watermark of a day: the first row of event 1 stays.
    land(spark, folder, "c", [{"GLOBALEVENTID": 1, "minute": 10 * 1440, "NumMentions": 9}, {"GLOBALEVENTID": 4, "minute": 10 * 1440}])
    run_stream()
    assert seen(spark, path) == [(1, "2024-01-01", 5), (2, "2024-01-01", 1), (3, "2024-01-10", 1), (4, "2024-01-11", 1)]


def test_events_without_an_id_are_not_known(spark, tmp_path):
    path = str(tmp_path / "days")
    for at in range(2):
        feeds.append_unseen(path)(batch_of(spark, (None, 20240101, at), (None, 20240102, at), (6, 20240101, at)), at)
    feeds.append_unseen(path)(batch_of(spark), 2)
    assert seen(spark, path) == [(6, "2024-01-01", 0), (None, "2024-01-01", 1), (None, "2024-01-02", 1)]


def test_windows_close_with_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, "a", [{"GLOBALEVENTID": i, "minute": i, "AvgTone": float(i)} for i in range(20)])
    land(spark, folder, "b", [{"GLOBALEVENTID": 100, "minute": 100}])
    land(spark, folder, "b2", [{"GLOBALEVENTID": 100, "minute": 101}])
    land(spark, folder, "c", [{"GLOBALEVENTID": 101, "minute": 2}, {"GLOBALEVENTID": 102, "minute": 200}])
    rows = run(spark, feeds.country_counts(stream(spark, folder)), tmp_path, "counts")
    found = {(r.window_start - START).seconds // 60: (r.event_count, r.avg_tone) for r in rows}
    # The watermark of the second file is in force from the fourth on, so the late row of
    # that one finds its window closed. The last window stays open.
    assert found[0] == (15, pytest.approx(7.0)) and found[15] == (5, pytest.approx(17.0))
    assert set(found) == {0, 15, 90}


def test_stream_alerts(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows, at = [], 0
    for day in range(10):
        for _ in range(30 if day == 8 else 2):
            at += 1
            rows.append({"GLOBALEVENTID": at, "minute": day * 1440 + at % 600})
    land(spark, folder, "a", rows)
    land(spark, folder, "b", [{"GLOBALEVENTID": 999, "minute": 20 * 1440}])
    found = run(spark, feeds.spike_alerts(stream(spark, folder)), tmp_path, "alerts")
    spikes = {(r.as_of - START).days: (r.events_24h, r.baseline_avg, r.spike_ratio) for r in found}
    assert spikes[9] == (30, pytest.approx(2.0), pytest.approx(15.0))
    assert set(spikes) == {9}


def test_work_dir_is_new_each_time(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, other = work_dir(spark, "x"), work_dir(spark, "x")
    assert one != other and one.startswith(root or "/")


def counted_batch(spark, count, *rows):
    """Like `batch_of`; `count` grows by one for each row each time it is computed."""
    frame = batch_of(spark, *rows)

    def seen_row(row):
        count.add(1)
        return row

    return spark.createDataFrame(frame.rdd.map(seen_row), frame.schema)


@pytest.mark.parametrize("add", [feeds.upsert_days, feeds.append_unseen])
def test_a_batch_is_computed_once_with_and_without_undated_rows(spark, tmp_path, add):
    from newsloom.sources.store import read_undated

    path, count = str(tmp_path / "days"), spark.sparkContext.accumulator(0)
    add(path)(counted_batch(spark, count, (1, 20240101, 1), (1, 20240101, 2), (2, 20240102, 1)), 0)
    assert count.value == 3
    # Rows without a day all go to the table beside, also those with the same id, or with none.
    odd = [(3, 20249999, 1), (3, 20249999, 2), (None, None, 5), (None, None, 6)]
    add(path)(counted_batch(spark, count, (4, 20240101, 1), *odd), 1)
    assert count.value == 8
    assert seen(spark, path) == [(1, "2024-01-01", 2), (2, "2024-01-02", 1), (4, "2024-01-01", 1)]
    assert sorted((str(r.GLOBALEVENTID), r.NumMentions) for r in read_undated(spark, path).collect()) == [
        ("3", 1), ("3", 2), ("None", 5), ("None", 6),
    ]
    assert not [name for name in os.listdir(path) if "DEFAULT" in name]


def test_a_merge_moves_rows_once(spark, tmp_path, monkeypatch):
    from newsloom.sources import batches

    path, plans = str(tmp_path / "days"), {}
    for at, rows in enumerate(MOVES):
        feeds.upsert_days(path)(batch_of(spark, *rows), at)
    put = batches._put

    def noted(rows, folder, *parts):
        plans[os.path.basename(folder)] = plan(rows)
        put(rows, folder, *parts)

    with monkeypatch.context() as patch:
        patch.setattr(batches, "_put", noted)
        patch.setattr(batches, "SLICE_ROWS", 1)
        feeds.compact_upserted(spark, path)
    assert set(plans) == {"days_bases", "days_keys_bases"}
    for text in plans.values():
        # The list of partitions to merge is cached; below it other exchanges follow.
        moved = text.split("InMemoryRelation")[0]
        assert len(re.findall(r"Exchange (?:hash|range)partitioning|Rebalance", moved)) == 1, text
    assert seen(spark, path) == MOVED
    feeds.retire_upserted(spark, path)
    assert seen(spark, path) == MOVED
