import hashlib
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.models import anomaly, clustering, forecast
from newsloom.plans.filters import EventFilter
from tests.conftest import event_rows, plan

SERIES = "country_code string, date date, count long"


def _series(spark, counts, code="A", start=date(2024, 1, 1)):
    rows = [(code, start + timedelta(days=i), int(c)) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, SERIES)


def test_forecast_follows_trend_and_week(spark):
    counts = [10 + 2 * i + (30 if i % 7 == 3 else 0) for i in range(28)]
    rows = forecast.forecast(_series(spark, counts), 7).orderBy("date").collect()
    assert [r.date for r in rows] == [date(2024, 1, 29) + timedelta(days=i) for i in range(7)]
    wanted = [10 + 2 * i + (30 if i % 7 == 3 else 0) for i in range(28, 35)]
    assert [r.predicted_count for r in rows] == pytest.approx(wanted)
    assert rows[0].training_days == 28 and rows[0].total_historical_events == sum(counts)


def test_forecast_is_never_negative_and_has_bounds(spark):
    rows = forecast.forecast(_series(spark, [50, 41, 33, 24, 13, 7, 1]), 200).collect()
    assert len(rows) == 200
    assert all(0 <= r.lower_bound <= r.predicted_count <= r.upper_bound for r in rows)


def test_short_series_stay_flat(spark):
    rows = forecast.forecast(_series(spark, [9]), 3).orderBy("date").collect()
    assert [(r.predicted_count, r.lower_bound, r.model_type) for r in rows] == [(9.0, 9.0, "naive_fallback")] * 3
    assert forecast.forecast(_series(spark, []), 3).count() == 0
    assert [r.predicted_count for r in forecast.forecast(_series(spark, [1, 2]), 2).orderBy("date").collect()] == pytest.approx([3, 4])


def test_yearly_waves_need_a_year():
    days = np.arange(400.0)
    wave = 100 + 20 * np.sin(2 * np.pi * days / 365.25)
    value, _, name = forecast.fit_days(days, wave, np.arange(400.0, 430.0))
    assert name == "trend_weekly_yearly"
    assert value == pytest.approx(100 + 20 * np.sin(2 * np.pi * np.arange(400, 430) / 365.25))
    assert forecast.fit_days(days[:364], wave[:364], days[:1])[2] == "trend_weekly"
    assert forecast.fit_days(days[:6], wave[:6], days[:1])[2] == "trend"


def test_unseen_weekdays_get_the_mean_level():
    days = np.array([0.0, 7.0, 14.0, 1.0, 8.0, 15.0, 21.0])
    counts = np.where(days % 7 == 0, 10.0, 20.0)
    value, _, _ = forecast.fit_days(days, counts, np.array([22.0, 23.0, 28.0]))
    assert value == pytest.approx([20.0, 15.0, 10.0])


def test_conflict_forecast_counts_conflicts_only(spark):
    rows = [
        {"GLOBALEVENTID": d * 10 + i, "SQLDATE": 20240101 + d, "ActionGeo_CountryCode": "A", "QuadClass": 4 if i < 2 else 1}
        for d in range(10) for i in range(5)
    ]
    found = forecast.forecast_countries(event_rows(spark, rows), horizon_days=2).collect()
    assert [r.predicted_count for r in found] == pytest.approx([2.0, 2.0])
    world = forecast.forecast_country(event_rows(spark, rows), None, 2).collect()
    assert [r.predicted_count for r in world] == pytest.approx([5.0, 5.0]) and world[0].country_code is None


def _bent(noise=0.0, at=45, length=90):
    chance = np.random.default_rng(7)
    days = np.arange(length)
    week = np.array([0, 5, 9, 3, -2, -8, -7])[days % 7]
    trend = 200 + 2.0 * days - 5.0 * np.maximum(days - at, 0)
    return np.round(trend + week + noise * chance.standard_normal(length), 6)


@pytest.mark.parametrize("noise", [0.0, 2.0])
@pytest.mark.parametrize("at", [20, 45, 70])
def test_a_break_is_found_within_a_day(spark, noise, at):
    days = np.arange(90) + 19723.0
    knots = forecast.find_knots(days, _bent(noise, at))
    assert len(knots) == 1 and abs(knots[0] - days[at]) <= 1
    assert forecast.find_knots(days[:10], _bent(noise, at)[:10]) == []


def test_straight_series_do_not_bend():
    days = np.arange(60) + 19723.0
    chance = np.random.default_rng(1)
    for slope in (0.0, 3.0):
        assert forecast.find_knots(days, 50 + slope * days + 3 * chance.standard_normal(60)) == []
        assert forecast.find_knots(days, 50 + slope * days) == []
    two = np.concatenate([np.arange(30.0), 30 - 2 * np.arange(30.0), -30 + 4 * np.arange(30.0)])
    assert [k - 19723 for k in forecast.find_knots(np.arange(90) + 19723.0, two)] == pytest.approx([30, 60], abs=1)


def test_segments_are_the_cheapest():
    """The dynamic programme against all choices of borders."""
    chance = np.random.default_rng(2)
    days, counts = np.arange(16.0), chance.integers(0, 30, 16).astype(float)
    errors = forecast.line_errors(days, counts)
    for start, end in ((0, 16), (3, 9), (10, 13)):
        fit = np.polyfit(days[start:end], counts[start:end], 1)
        assert errors(np.array([start]), end)[0] == pytest.approx(((counts[start:end] - np.polyval(fit, days[start:end])) ** 2).sum(), abs=1e-8)


def test_bent_forecasts(spark):
    counts = _bent(2.0)
    series = _series(spark, counts[:83].round().astype(int).tolist())
    errors = {}
    for bends in (False, True, [date(2024, 1, 1) + timedelta(days=45)]):
        rows = forecast.forecast(series, 7, bends).orderBy("date").collect()
        errors[str(bends)[:5]] = np.abs(np.array([r.predicted_count for r in rows]) - counts[83:]).mean()
        assert rows[0].model_type == ("trend_bent_weekly" if bends else "trend_weekly")
    assert errors["True"] < 0.3 * errors["False"] and len(set(errors.values())) >= 2
    straight, bent = (forecast.backtest(series, bends=bends).first().mae for bends in (False, True))
    assert bent < 0.6 * straight
    change = forecast.trend_changes(series).first()
    assert abs((change.date - date(2024, 2, 15)).days) <= 1 and change.before > 1 and change.after < -2
    assert forecast.trend_changes(_series(spark, [3, 4])).count() == 0


def test_backtest(spark):
    exact = _series(spark, [10 + i for i in range(30)])
    short = _series(spark, range(20), "B")
    rows = forecast.backtest(exact.unionByName(short)).collect()
    assert [r.country_code for r in rows] == ["A"]
    assert rows[0].windows == 9 and rows[0].mae == pytest.approx(0, abs=1e-6)
    assert rows[0].naive_mae == pytest.approx(4) and rows[0].improvement_pct == pytest.approx(100)


def test_backtest_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(20, 27).astype(float)
    errors, naive, share, inside = [], [], [], []
    for cut in range(14, 27 - 7):
        value, band, _ = forecast.fit_days(np.arange(cut) + 19723.0, counts[:cut], np.arange(cut, cut + 7) + 19723.0)
        actual = counts[cut:cut + 7]
        errors += list(np.abs(actual - np.maximum(value, 0)))
        naive += list(np.abs(actual - counts[cut - 1]))
        share += [abs(a - max(v, 0)) / a for a, v in zip(actual, value) if a]
        inside += list((actual >= value - band) & (actual <= value + band))
    row = forecast.backtest(_series(spark, counts)).first()
    assert row.windows == 6 and row.mae == pytest.approx(np.mean(errors)) and row.naive_mae == pytest.approx(np.mean(naive))
    assert row.mape_pct == pytest.approx(100 * np.mean(share)) and row.band_coverage_pct == pytest.approx(100 * np.mean(inside))


def test_isolation_scores_set_outliers_apart():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (200, 3)), [[9.0, 9.0, 9.0]]])
    scores = anomaly.isolation_scores(rows, rows)
    assert scores.argmin() == 200 and (scores < 0).all() and (scores > -1).all()
    assert np.allclose(scores, anomaly.isolation_scores(rows, rows))
    near = np.array([[1.0], [np.nextafter(1.0, 2)]])
    assert len(anomaly.isolation_scores(near, near)) == 2
    same = anomaly.isolation_scores(np.ones((20, 2)), np.ones((3, 2)))
    assert len(set(same)) == 1


def _plain_forest_paths(rows, trees, tree_rows, seed):
    """Mean path per row of one key ('k'), grown node by node; rows maps a row to its values."""
    def drawn(*parts):
        return int(hashlib.md5(":".join(map(str, (seed, "k", *parts))).encode()).hexdigest()[:12], 16) / 2**48

    total = dict.fromkeys(rows, 0.0)
    for tree in range(trees):
        sample = sorted(rows, key=lambda r: (drawn(tree, r, "row"), r))[:tree_rows]
        depth = int(np.ceil(np.log2(max(len(sample), 2))))

        def walk(node, level, inside, asked):
            values = np.array([rows[r] for r in inside])
            varied = [k for k in range(values.shape[1]) if values[:, k].max() > values[:, k].min()]
            if level == depth or not varied:
                for r in asked:
                    total[r] += level + anomaly._mean_path(len(inside))
                return
            k = varied[int(drawn(tree, node, "feature") * len(varied))]
            low, high = values[:, k].min(), values[:, k].max()
            cut = low + drawn(tree, node, "split") * (high - low)
            cut = cut if cut < high else low
            for side in (0, 1):
                walk(2 * node + side, level + 1, [r for r in inside if (rows[r][k] > cut) == side], [r for r in asked if (rows[r][k] > cut) == side])

        walk(1, 0, sample, list(rows))
    return {r: value / trees for r, value in total.items()}


@pytest.mark.parametrize("tree_rows", [256, 16])
def test_walked_forest_equals_one_grown_node_by_node(spark, tree_rows):
    chance = np.random.default_rng(3)
    rows = {at: [float(chance.integers(0, 4)), round(float(chance.normal()), 6), 1.0] for at in range(60)}
    rows[59] = [50.0, 9.0, 1.0]
    frame = spark.createDataFrame([("k", at, *v) for at, v in rows.items()] + [("other", 1, 0.0, 0.0, 0.0)], "key string, row int, a double, b double, c double")
    found = anomaly.forest_paths(frame, "key", "row", ["a", "b", "c"], trees=5, tree_rows=tree_rows, seed=9)
    got = {r.row: r.mean_path for r in found.where("key = 'k'").collect()}
    want = _plain_forest_paths(rows, 5, tree_rows, 9)
    assert got.keys() == want.keys() and all(got[at] == pytest.approx(want[at], abs=1e-9) for at in want)
    assert min(got, key=got.get) == 59
    assert found.where("key = 'other'").first().mean_path == 0.0
    text = plan(found)
    assert "Python" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+, tree#\d+", text)) == 1


def test_tree_paths_equal_a_walk_in_the_tree():
    chance = np.random.default_rng(6)
    train, asked = chance.integers(0, 5, (70, 3)).astype(float), chance.integers(-1, 6, (40, 3)).astype(float)
    tree = anomaly.grow_tree(train, [1, 2], tree_rows=50)
    inner = len(tree["feature"])
    for row, path in zip(asked, anomaly.tree_paths(tree, asked)):
        at = 0
        while at < inner:
            at = 2 * at + 1 + int(row[tree["feature"][at]] > tree["split"][at])
        assert path == tree["path"][at - inner] and path > 0


def _country_days(spark):
    rows, at = [], 0
    for day in range(1, 21):
        for country, count in (("A", 200 if day == 20 else 5 + day % 3), ("B", 5 + day % 3), ("C", 3)):
            if country == "C" and day > 12:
                continue
            for i in range(count):
                at += 1
                rows.append({"GLOBALEVENTID": at, "SQLDATE": 20240100 + day, "ActionGeo_CountryCode": country,
                             "QuadClass": 4 if (i + day) % 3 else 1, "GoldsteinScale": float(i % 5), "AvgTone": float(day % 4),
                             "NumMentions": 3})
    return event_rows(spark, rows)


def test_country_anomalies(spark, names):
    rows = {r.country_code: r for r in anomaly.country_anomalies(_country_days(spark), names).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"].score < rows["B"].score
    assert rows["A"].is_anomaly and rows["A"].reason.endswith("σ above mean")
    assert not rows["B"].is_anomaly and rows["B"].reason is None


def test_validation_finds_injected_rows(spark, events):
    base = spark.range(3000).select(
        F.col("id").alias("GLOBALEVENTID"), (F.randn(1) * 3).alias("GoldsteinScale"), (F.randn(2) * 4 - 2).alias("AvgTone"),
        (F.rand(3) * 50).alias("NumMentions"), (F.floor(F.rand(4) * 3) + 1).alias("QuadClass"), (F.rand(5) * 20).alias("NumSources"),
    )
    labelled = anomaly.inject_anomalies(base)
    share = labelled.where("injected").count() / 3000
    assert 0.03 < share < 0.07
    rows = anomaly.validate_anomalies(labelled, rates=(0.05, 0.10), seeds=(0, 1)).collect()
    assert len(rows) == 4
    assert all(r.f1 > 0.8 for r in rows if r.rate == 0.05)
    assert all(r.recall > 0.95 and r.separation_gap > 0.1 for r in rows if r.rate == 0.10)
    summary = anomaly.validation_summary(anomaly.validate_anomalies(labelled, (0.05,), (0,))).first()
    assert summary.avg_f1 > 0.8 and summary.f1_std == 0


def test_trees_draw_from_all_rows(spark):
    features = [F.lit(1.0).alias(c) for c in anomaly.EVENT_FEATURES[1:]]
    for total, trees in ((100, 6), (3000, 8), (60_000, 3)):
        rows = spark.range(total).select(
            F.col("id").alias("GLOBALEVENTID"), F.lit(False).alias("injected"), F.col("id").cast("double").alias("GoldsteinScale"), *features
        )
        drawn = anomaly.draw_tree_rows(rows, total, trees, tree_rows=50).toPandas()
        assert drawn.groupby("tree").size().to_dict() == {tree: 50 for tree in range(trees)}
        assert drawn.groupby("tree")["GoldsteinScale"].nunique().min() == 50
        assert drawn["GoldsteinScale"].max() > 0.9 * total and drawn["GoldsteinScale"].min() < 0.1 * total


def test_validation_of_no_rows_and_its_plan(spark):
    shape = "GLOBALEVENTID bigint, injected boolean, " + ", ".join(f"{c} double" for c in anomaly.EVENT_FEATURES)
    rows = anomaly.validate_anomalies(spark.createDataFrame([], shape), (0.05,), (0,)).collect()
    assert [(r.hits, r.flagged, r.f1, r.threshold) for r in rows] == [(0, 0, 0.0, None)]
    scored = spark.createDataFrame([(True, 1.0), (False, 2.0), (False, 3.0), (False, 4.0)], "injected boolean, seed_0 double")
    row = anomaly.score_metrics(scored, (0.5,), (0,)).first()
    assert (row.threshold, row.hits, row.flagged, row.precision, row.recall, row.separation_gap) == (2.0, 1, 1, 1.0, 1.0, 2.0)
    plan = anomaly.score_metrics(scored, (0.5,), (0,))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def _two_kinds(spark):
    rows = [
        {"GLOBALEVENTID": i, "SQLDATE": 20240101, "Actor1CountryCode": "US" if i % 2 else "FR", "Actor2CountryCode": "CN",
         "EventRootCode": "19" if i % 2 else "03", "GoldsteinScale": -9.0 if i % 2 else 6.0}
        for i in range(40)
    ]
    return event_rows(spark, rows)


def test_clusters_split_unlike_events(spark):
    found = clustering.cluster_events(_two_kinds(spark), EventFilter(), n_clusters=2)
    rows = found.clusters.orderBy("label").collect()
    plan = found.clusters._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "GLOBALEVENTID" not in plan
    assert [r.event_count for r in rows] == [20, 20]
    assert [r.label for r in rows] == ["CN/FR - Event 03", "CN/US - Event 19"]
    assert [r.avg_goldstein_scale for r in rows] == [6.0, -9.0]
    assert rows[1].top_country_codes == ["CN", "US"] and rows[1].top_event_codes == ["19"]
    assert found.members.count() == 40 and found.members.select("GLOBALEVENTID").distinct().count() == 40


def test_cluster_sizes_sum_and_few_events(spark, events):
    alike = clustering.cluster_events(_two_kinds(spark), EventFilter(), n_clusters=9).clusters
    assert [r.event_count for r in alike.collect()] == [20, 20]
    found = clustering.cluster_events(events, EventFilter(), n_clusters=50)
    assert sum(r.event_count for r in found.clusters.collect()) == 5
    single = clustering.cluster_events(events.where("GLOBALEVENTID = 101"), EventFilter()).clusters.collect()
    assert [(r.cluster_id, r.event_count, r.label) for r in single] == [(0, 1, "CN/US - Event 01")]
    assert clustering.cluster_events(events.where("1 = 0"), EventFilter()).clusters.collect() == []
    newest = clustering.cluster_events(events, EventFilter(), newest=2).members
    assert sorted(r.GLOBALEVENTID for r in newest.collect()) == [104, 105]


def test_tfidf_counts_a_text_by_its_weight(spark):
    rows = [("red apple", 3.0), ("green apple", 1.0), ("green pear pear", 2.0)]
    texts = spark.createDataFrame(rows, "text string, weight double")
    stages = clustering.tfidf(texts, clustering.TEXT_TOKEN, 10)
    terms = stages.stages[0].vocabulary
    assert terms == ["apple", "pear", "green", "red"]
    idf = {t: np.log(7 / (1 + n)) + 1 for t, n in {"apple": 4, "pear": 2, "green": 3, "red": 3}.items()}
    for row in stages.transform(clustering._tokens(texts, clustering.TEXT_TOKEN)).collect():
        words = row.text.split()
        weights = np.array([words.count(t) * idf[t] for t in terms])
        assert row.features.toArray() == pytest.approx(weights / np.linalg.norm(weights))


def test_cluster_quality(spark):
    rows = [
        {"GLOBALEVENTID": i, "SQLDATE": 20240101, "SOURCEURL": f"https://site.org/{('war', 'peace', 'trade')[i % 3]}/{('aaa', 'bbb')[i % 2]}"}
        for i in range(60)
    ]
    found = clustering.cluster_quality(event_rows(spark, rows), EventFilter(), ks=(2, 3, 4), seeds=(0, 1)).collect()
    assert [r.k for r in found] == [2, 3, 4]
    best = [r for r in found if r.is_best]
    assert len(best) == 1 and best[0].k == 3 and best[0].silhouette > 0.4 and best[0].stability == pytest.approx(1.0)
    assert found[0].inertia > found[1].inertia
    few = clustering.cluster_quality(event_rows(spark, rows[:2]), EventFilter())
    assert few.count() == 0
