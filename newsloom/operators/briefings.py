"""Country summaries and briefings as text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.text import is_poor_briefing
from newsloom.operators.trends import COUNTRY, top_countries
from newsloom.plans.filters import days_between, has_country

TOP_CODES = 5


def _two_digits(value: Column) -> Column:
    return F.format_string("%.2f", F.round(F.coalesce(value, F.lit(0.0)), 2))


def country_summaries(events: DataFrame, days: int = 7, anchor: date | None = None) -> DataFrame:
    """Figures and leading root codes of every country, as columns and as one sentence.

    Counts per country and code come first; the country totals and the ordered codes are
    taken from those few rows.
    """
    rows = events.where(days_between(events, -days, 1, anchor)).where(has_country())
    codes = rows.groupBy(F.col(COUNTRY).alias("country_code"), "EventRootCode").agg(
        F.count("*").alias("n"),
        F.sum("GoldsteinScale").alias("goldstein_sum"),
        F.count("GoldsteinScale").alias("goldstein_rows"),
        F.sum("AvgTone").alias("tone_sum"),
        F.count("AvgTone").alias("tone_rows"),
        F.sum("NumMentions").alias("mentions"),
        F.sum("NumSources").alias("sources"),
    )
    coded = F.when(F.col("EventRootCode") != "", F.struct(-F.col("n"), F.col("EventRootCode").alias("code")))

    def mean(name: str) -> Column:
        return F.when(F.sum(f"{name}_rows") > 0, F.sum(f"{name}_sum") / F.sum(f"{name}_rows"))

    totals = codes.groupBy("country_code").agg(
        F.sum("n").alias("event_count"),
        mean("goldstein").alias("avg_goldstein"),
        mean("tone").alias("avg_tone"),
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_mentions"),
        F.coalesce(F.sum("sources"), F.lit(0)).alias("total_sources"),
        F.slice(F.array_sort(F.collect_list(coded)), 1, TOP_CODES)["code"].alias("top_codes"),
    )
    leading = F.when(F.size("top_codes") > 0, F.array_join("top_codes", ", ")).otherwise("n/a")
    # The wording of the summary.
    summary = F.concat(
        F.lit("Country "), F.col("country_code"),
        F.lit(". Recent events: "), F.col("event_count"),
        F.lit(". Avg Goldstein: "), _two_digits(F.col("avg_goldstein")),
        F.lit(". Avg tone: "), _two_digits(F.col("avg_tone")),
        F.lit(". Total mentions: "), F.col("total_mentions"),
        F.lit(". Total sources: "), F.col("total_sources"),
        F.lit(". Top root codes: "), leading, F.lit("."),
    )
    return totals.withColumn("summary", summary)


def template_briefing(country_code: Column, summary: Column) -> Column:
    # The wording of the template.
    return F.concat(
        F.lit("Geopolitical briefing for "), country_code, F.lit(": "), summary,
        F.lit(
            " Interpretation: monitor changes in tone, Goldstein score, and event mix "
            "for escalation or de-escalation signals."
        ),
    )


def country_briefings(
    events: DataFrame,
    supplied: DataFrame | None = None,
    days: int = 7,
    countries: int = 30,
    anchor: date | None = None,
) -> DataFrame:
    """Briefings of the busiest countries.

    `supplied` (country_code, text) may bring written texts; a text that fails the
    quality check gives way to the template.
    """
    busiest = top_countries(events, days, countries, anchor).select("country_code")
    rows = country_summaries(events, days, anchor).join(busiest, "country_code", "left_semi")
    if supplied is None:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    else:
        written = supplied.groupBy("country_code").agg(F.max("text").alias("text"))
        rows = rows.join(written, "country_code", "left")
    given = F.coalesce(F.col("text"), F.lit("")) != ""
    poor = is_poor_briefing(F.col("text"))
    source = F.when(~given, "template").when(poor, "template_after_check").otherwise("supplied")
    template = template_briefing(F.col("country_code"), F.col("summary"))
    return rows.select(
        "country_code",
        F.when(given & ~poor, F.col("text")).otherwise(template).alias("briefing"),
        source.alias("source"),
        "summary",
    )
