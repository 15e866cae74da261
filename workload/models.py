"""Forecast, anomaly and clustering queries."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from newsloom.models import anomaly, clustering, forecast
from newsloom.operators.trends import FEATURES, country_conflict_daily
from newsloom.sources.demo_events import country_names, enriched_events
from workload.base import NAMES_VIEW, SHARE, display, on_events, r6, register, since
from workload.reports import JANUARY

# Least squares with a level per weekday and one trend: the trend is the slope of the
# series after taking off the weekday means, the levels follow from it.
_FIT = """sized AS (SELECT country_code, count(*) >= 7 AND count(*) > count(DISTINCT t % 7) AS weekly, count(*) AS n,
    sum(y)::BIGINT AS total, max(t) AS last_t FROM series GROUP BY 1),
  fitted AS (
    SELECT *, y - wy AS dy, t - wt AS dt FROM (
      SELECT s.country_code, t, y, CASE WHEN weekly THEN t % 7 ELSE 0 END AS dow, avg(y) OVER w AS wy, avg(t) OVER w AS wt
      FROM series s JOIN sized z ON z.country_code IS NOT DISTINCT FROM s.country_code
      WINDOW w AS (PARTITION BY s.country_code, CASE WHEN weekly THEN t % 7 ELSE 0 END))),
  slopes AS (SELECT country_code, CASE WHEN sum(dt * dt) > 0 THEN sum(dy * dt) / sum(dt * dt) ELSE 0 END AS slope,
    count(DISTINCT dow) AS dows FROM fitted GROUP BY 1),
  spread AS (SELECT f.country_code, sqrt(sum((dy - slope * dt) ** 2) / greatest(1, count(*) - any_value(dows) - 1)) AS s
    FROM fitted f JOIN slopes k ON k.country_code IS NOT DISTINCT FROM f.country_code GROUP BY 1),
  levels AS (SELECT DISTINCT f.country_code, dow, wy - slope * wt AS level
    FROM fitted f JOIN slopes k ON k.country_code IS NOT DISTINCT FROM f.country_code),
  means AS (SELECT country_code, avg(level) AS mean_level FROM levels GROUP BY 1),
  ahead AS (SELECT country_code, n, total, weekly, last_t + h AS t,
      CASE WHEN weekly THEN (last_t + h) % 7 ELSE 0 END AS dow
    FROM sized CROSS JOIN (SELECT unnest(range(1, {horizon} + 1)) AS h)),
  predicted AS (SELECT a.country_code, a.t, n, total, coalesce(level, mean_level) + slope * a.t AS v,
      1.2815515655446004 * s AS band,
      CASE WHEN n < 2 THEN 'naive_fallback' WHEN weekly THEN 'trend_weekly' ELSE 'trend' END AS model_type
    FROM ahead a LEFT JOIN levels l ON l.country_code IS NOT DISTINCT FROM a.country_code AND l.dow = a.dow
    JOIN means m ON m.country_code IS NOT DISTINCT FROM a.country_code
    JOIN slopes k ON k.country_code IS NOT DISTINCT FROM a.country_code
    JOIN spread p ON p.country_code IS NOT DISTINCT FROM a.country_code)"""
_FORECAST = f"""SELECT country_code, strftime(DATE '1970-01-01' + t::INT, '%Y-%m-%d') AS date,
  {r6('greatest(v, 0)')} AS predicted_count, {r6('greatest(v - band, 0)')} AS lower_bound,
  {r6('greatest(v + band, 0)')} AS upper_bound, model_type, {{horizon}}::BIGINT AS horizon_days,
  n AS training_days, total AS total_historical_events FROM predicted"""


def _series(code, where):
    return f"""series AS (SELECT {code} AS country_code, (d - DATE '1970-01-01')::BIGINT AS t, count(*)::DOUBLE AS y
      FROM ev WHERE {where} GROUP BY 1, 2)"""


_CONFLICT = f"{since(90)} AND ActionGeo_CountryCode <> '' AND QuadClass IN (3, 4)"


@register(
    "forecast_countries",
    on_events(
        _FORECAST.format(horizon=30),
        _series(
            "ActionGeo_CountryCode",
            _CONFLICT
            + f""" AND ActionGeo_CountryCode IN (SELECT ActionGeo_CountryCode FROM ev WHERE {since(90)}
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50)""",
        ),
        _FIT.format(horizon=30),
    ),
)
def _(spark, sf):
    return forecast.forecast_countries(enriched_events(spark, sf))


@register(
    "forecast_world",
    on_events(_FORECAST.format(horizon=7), _series("NULL::VARCHAR", since(90)), _FIT.format(horizon=7)),
)
def _(spark, sf):
    return forecast.forecast_country(enriched_events(spark, sf), None)


@register(
    "forecast_country",
    on_events(
        _FORECAST.format(horizon=14),
        _series("'N3'", f"{since(90)} AND (Actor1CountryCode = 'N3' OR ActionGeo_CountryCode = 'N3')"),
        _FIT.format(horizon=14),
    ),
)
def _(spark, sf):
    return forecast.forecast_country(enriched_events(spark, sf), "n3", 14)


#: Day on which the trend of one query may bend.
BEND = date(2024, 1, 16)
_BENT_FIT = """bent AS (SELECT *, greatest(t - bend, 0) AS h, t % 7 AS dow FROM series, (SELECT DATE '{bend}' - DATE '1970-01-01' AS bend)),
  centred AS (SELECT *, y - avg(y) OVER w AS dy, t - avg(t) OVER w AS dt, h - avg(h) OVER w AS dh,
    avg(y) OVER w AS wy, avg(t) OVER w AS wt, avg(h) OVER w AS wh FROM bent WINDOW w AS (PARTITION BY dow)),
  products AS (SELECT sum(dt * dt) AS tt, sum(dh * dh) AS hh, sum(dt * dh) AS th, sum(dt * dy) AS ty, sum(dh * dy) AS hy,
    count(DISTINCT dow) AS dows, count(*) AS n, sum(y)::BIGINT AS total, max(t) AS last_t, any_value(bend) AS bend FROM centred),
  slopes AS (SELECT *, (ty * hh - hy * th) / (tt * hh - th * th) AS b, (hy * tt - ty * th) / (tt * hh - th * th) AS c FROM products),
  spread AS (SELECT sqrt(sum((dy - b * dt - c * dh) ** 2) / greatest(1, any_value(n) - any_value(dows) - 2)) AS s FROM centred, slopes),
  levels AS (SELECT DISTINCT dow, wy - b * wt - c * wh AS level FROM centred, slopes),
  predicted AS (SELECT NULL::VARCHAR AS country_code, n, total, t, level + b * t + c * greatest(t - bend, 0) AS v,
    1.2815515655446004 * s AS band, 'trend_bent_weekly' AS model_type
    FROM (SELECT *, last_t + unnest(range(1, 8)) AS t FROM slopes) JOIN levels ON dow = t % 7, spread)"""


@register(
    "forecast_bent",
    on_events(_FORECAST.format(horizon=7), _series("NULL::VARCHAR", since(90)), _BENT_FIT.format(bend=BEND)),
)
def _(spark, sf):
    return forecast.forecast_country(enriched_events(spark, sf), None, bends=[BEND])


@register("trend_changes")
def _(spark, sf):
    """Bends of each country's conflicts, on which a ramp from one day on is laid."""
    series = country_conflict_daily(enriched_events(spark, sf), conflict_only=True)
    ramp = F.greatest(F.datediff("date", F.lit(BEND)), F.lit(0)) * 20
    return forecast.trend_changes(series.withColumn("count", F.col("count") + ramp))


_GAIN = """CASE WHEN avg(abs(y - naive)) > 0
  THEN (avg(abs(y - naive)) - avg(abs(y - greatest(v, 0)))) / avg(abs(y - naive)) * 100 ELSE 0 END"""


@register(
    "forecast_backtest",
    on_events(
        f"""SELECT cc AS country_code, count(DISTINCT cut) AS windows, {r6('avg(abs(y - greatest(v, 0)))')} AS mae,
        {r6('avg(abs(y - naive))')} AS naive_mae,
        {r6('avg(CASE WHEN y <> 0 THEN abs(y - greatest(v, 0)) / y * 100 END)')} AS mape_pct,
        {r6('avg(CASE WHEN y BETWEEN v - band AND v + band THEN 100.0::DOUBLE ELSE 0 END)')} AS band_coverage_pct,
        {r6(_GAIN)} AS improvement_pct
        FROM (SELECT f.cc, cut, a.y, b.y AS naive, v, band FROM folds f JOIN predicted p ON p.country_code = key
          JOIN sized z ON z.country_code = key JOIN days a ON a.cc = f.cc AND a.at_day = cut + (p.t - z.last_t) - 1
          JOIN days b ON b.cc = f.cc AND b.at_day = cut - 1) GROUP BY 1""",
        f"""days AS (SELECT *, row_number() OVER (PARTITION BY cc ORDER BY t) - 1 AS at_day, count(*) OVER (PARTITION BY cc) AS n
          FROM (SELECT ActionGeo_CountryCode AS cc, (d - DATE '1970-01-01')::BIGINT AS t, count(*)::DOUBLE AS y
            FROM ev WHERE {_CONFLICT} GROUP BY 1, 2))""",
        """folds AS (SELECT cc, cut, cc || '#' || cut AS key FROM (SELECT cc, unnest(range(14, n - 7)) AS cut
          FROM (SELECT DISTINCT cc, n FROM days)))""",
        """series AS (SELECT key AS country_code, t, y FROM days d JOIN folds f ON f.cc = d.cc AND at_day < cut)""",
        _FIT.format(horizon=7),
    ),
)
def _(spark, sf):
    return forecast.backtest(country_conflict_daily(enriched_events(spark, sf)))


#: Levels of a tree of 256 rows.
_LEVELS = 8
_VALUES = range(1, len(FEATURES) + 1)


def _chance(*parts: str) -> str:
    """A draw in [0, 1) from the seed and the parts."""
    return f"(('0x' || substr(md5(concat_ws(':', '42', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE / {1 << 48}::DOUBLE)"


def _usual(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n} - 1) + {float(np.euler_gamma)}::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} END"


def _level(at: int) -> tuple[str, ...]:
    """One step of all rows down all trees."""
    split = f"low[pick] + {_chance('country_code', 'tree', 'node', quote('split'))} * (high[pick] - low[pick])"
    goes = f"path IS NULL AND pick IS NOT NULL AND depth > {at}"
    return (
        f"""ends{at} AS (SELECT *, [{', '.join(f'min(f[{k}]) OVER w' for k in _VALUES)}] AS low,
          [{', '.join(f'max(f[{k}]) OVER w' for k in _VALUES)}] AS high, count(*) OVER w AS n
          FROM at{at} WINDOW w AS (PARTITION BY country_code, tree, node))""",
        f"varied{at} AS (SELECT *, list_filter({list(_VALUES)}, lambda k: high[k] > low[k]) AS varied FROM ends{at})",
        f"""picked{at} AS (SELECT *, varied[floor({_chance('country_code', 'tree', 'node', quote('feature'))} * len(varied))::INT + 1] AS pick
          FROM varied{at})""",
        f"cut{at} AS (SELECT *, CASE WHEN {split} < high[pick] THEN {split} ELSE low[pick] END AS cut FROM picked{at})",
        f"""at{at + 1} AS (SELECT country_code, SQLDATE, f, tree, depth, rows_per_tree,
          CASE WHEN {goes} THEN 2 * node + (f[pick] > cut)::INT ELSE node END AS node,
          CASE WHEN path IS NOT NULL OR {goes} THEN path ELSE {at} + {_usual('n')} END AS path FROM cut{at})""",
    )


def quote(text: str) -> str:
    return f"'{text}'"


_Z = ", ".join(f"({name} - avg({name}) OVER c) / coalesce(nullif(stddev_samp({name}) OVER c, 0), 1)" for name in FEATURES)
_NAMES = ", ".join(quote(name.replace("_", " ").capitalize()) for name in FEATURES)
_FOREST = (
    f"""days AS (SELECT ActionGeo_CountryCode AS country_code, SQLDATE, count(*)::DOUBLE AS event_count,
      {SHARE} AS conflict_ratio, coalesce(avg(GoldsteinScale), 0) AS avg_goldstein, coalesce(avg(AvgTone), 0) AS avg_tone,
      coalesce(sum(NumMentions), 0)::DOUBLE AS num_mentions_sum FROM ev
      WHERE {since(90)} AND ActionGeo_CountryCode <> '' GROUP BY ALL)""",
    f"""judged AS (SELECT *, SQLDATE = (SELECT max(SQLDATE) FROM ev) AS is_anchor, count(*) OVER c AS n, [{_Z}] AS z
      FROM days WINDOW c AS (PARTITION BY country_code))""",
    """able AS (SELECT * FROM judged WHERE n >= 14 AND country_code IN (SELECT country_code FROM judged WHERE is_anchor))""",
    f"""at0 AS (SELECT country_code, SQLDATE, [{', '.join(f'round({name}, 9)' for name in FEATURES)}] AS f, unnest(range(0, 100)) AS tree,
      ceil(log2(n) - 1e-9)::INT AS depth, n AS rows_per_tree, 1::BIGINT AS node, NULL::DOUBLE AS path FROM able)""",
    *(part for at in range(_LEVELS) for part in _level(at)),
    f"""walked AS (SELECT *, coalesce(path, depth + {_usual('count(*) OVER w')}) AS length FROM at{_LEVELS}
      WINDOW w AS (PARTITION BY country_code, tree, node))""",
    f"""scored AS (SELECT country_code, SQLDATE, -(2 ** (-avg(length) / greatest({_usual('max(rows_per_tree)')}, 1))) AS score
      FROM walked GROUP BY ALL)""",
    """offsets AS (SELECT country_code, quantile_cont(score, 0.05::DOUBLE) AS usual FROM scored GROUP BY 1)""",
    f"""tops AS (SELECT country_code, SQLDATE, z, list_position(list_transform(z, lambda v: abs(v)), list_max(list_transform(z, lambda v: abs(v)))) AS k
      FROM able WHERE is_anchor)""",
    f"""found AS (SELECT t.country_code, score - usual AS score, [{_NAMES}][k] || ' ' || printf('%.1f', round(abs(z[k]), 1)) || 'σ ' ||
      CASE WHEN z[k] > 0 THEN 'above' ELSE 'below' END || ' mean' AS reason
      FROM tops t JOIN scored USING (country_code, SQLDATE) JOIN offsets USING (country_code))""",
)


def _anomalies(name: str, flag_below: float) -> None:
    sql = on_events(
        f"""SELECT country_code, name AS country_name, {display('country_code', 'name')} AS country_display,
        score < {flag_below} AS is_anomaly, round_even(score, 3) + 0.0 AS score,
        CASE WHEN score < {flag_below} THEN reason END AS reason FROM found LEFT JOIN names ON code = country_code""",
        *_FOREST,
        NAMES_VIEW,
    )

    @register(name, sql)
    def _(spark, sf):
        events = enriched_events(spark, sf)
        return anomaly.country_anomalies(events, country_names(spark, sf), flag_below=flag_below)


_anomalies("country_anomalies", anomaly.FLAG_BELOW)
# A bound that every country is below shows every reason.
_anomalies("country_anomalies_all_reasons", 1.0)


@register("anomaly_validation")
def _(spark, sf):
    labelled = anomaly.inject_anomalies(enriched_events(spark, sf))
    return anomaly.validation_summary(anomaly.validate_anomalies(labelled))


_RATES = ", ".join(f"{rate}::DOUBLE" for rate in anomaly.RATES)


@register(
    "anomaly_metrics",
    on_events(
        f"""SELECT rate, seed::BIGINT AS seed, {r6('threshold')} AS threshold, hits, flagged, injected,
        {r6('separation_gap')} AS separation_gap, {r6('p')} AS "precision", {r6('r')} AS recall,
        {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END')} AS f1
        FROM (SELECT *, CASE WHEN flagged > 0 THEN hits::DOUBLE / flagged ELSE 0 END AS p,
          CASE WHEN injected > 0 THEN hits::DOUBLE / injected ELSE 0 END AS r FROM cells)""",
        """scores AS (SELECT injected, u.seed AS seed, u.score AS score FROM (
          SELECT QuadClass = 4 AS injected, unnest([{'seed': 0, 'score': GoldsteinScale}, {'seed': 1, 'score': AvgTone}]) AS u
          FROM ev WHERE QuadClass IS NOT NULL AND GoldsteinScale IS NOT NULL AND AvgTone IS NOT NULL))""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score) AS k,
          count(*) OVER (PARTITION BY seed) AS n FROM scores)""",
        f"""cuts AS (SELECT seed, rate, score AS threshold FROM ranked, (SELECT unnest([{_RATES}]) AS rate)
          WHERE k = greatest(1, ceil(rate * n)))""",
        """cells AS (SELECT rate, seed, threshold, count(*) FILTER (score < threshold AND injected) AS hits,
          count(*) FILTER (score < threshold) AS flagged, count(*) FILTER (injected) AS injected,
          avg(score) FILTER (NOT injected) - avg(score) FILTER (injected) AS separation_gap
          FROM ranked JOIN cuts USING (seed) GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    scores = (F.col("GoldsteinScale").alias("seed_0"), F.col("AvgTone").alias("seed_1"))
    rows = enriched_events(spark, sf).select((F.col("QuadClass") == 4).alias("injected"), *scores).dropna()
    return anomaly.score_metrics(rows, seeds=(0, 1), accuracy=1_000_000)


def _leading(values: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster_id, list(code ORDER BY k) AS {name} FROM (
      SELECT cluster_id, code, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, code) AS k
      FROM (SELECT cluster_id, unnest({values}) AS code FROM placed) WHERE code <> '' GROUP BY 1, 2) WHERE k <= 3 GROUP BY 1)"""


@register(
    "cluster_description",
    on_events(
        f"""SELECT cluster_id, coalesce(nullif(concat_ws(' - ', nullif(array_to_string(countries[1:2], '/'), ''), 'Event ' || roots[1]), ''),
          'Mixed Cluster') AS label, event_count, {r6('avg_goldstein_scale')} AS avg_goldstein_scale,
        array_to_string(countries, '|') AS top_country_codes, array_to_string(roots, '|') AS top_event_codes
        FROM (SELECT cluster_id, count(*) AS event_count, avg(GoldsteinScale) AS avg_goldstein_scale FROM placed GROUP BY 1)
        LEFT JOIN countries USING (cluster_id) LEFT JOIN roots USING (cluster_id)""",
        "placed AS (SELECT *, floor((GoldsteinScale + 10) / 4)::BIGINT AS cluster_id FROM ev)",
        _leading("[Actor1CountryCode, Actor2CountryCode]", "countries"),
        _leading("[EventRootCode]", "roots"),
    ),
)
def _(spark, sf):
    placed = enriched_events(spark, sf).withColumn("cluster_id", F.floor((F.col("GoldsteinScale") + 10) / 4))
    return clustering.describe(clustering.count_groups(placed, "cluster_id"))


@register("event_clusters")
def _(spark, sf):
    return clustering.cluster_events(enriched_events(spark, sf), JANUARY).clusters


@register("cluster_members")
def _(spark, sf):
    return clustering.cluster_events(enriched_events(spark, sf), JANUARY, n_clusters=8).members


@register("cluster_quality")
def _(spark, sf):
    return clustering.cluster_quality(enriched_events(spark, sf, urls=True), JANUARY)
