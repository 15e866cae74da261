from __future__ import annotations

import pytest

from newsloom.schema import ENRICHED_SCHEMA
from newsloom.session import local_session
from newsloom.sources.landed import conform

FIELDS = (
    "GLOBALEVENTID", "SQLDATE", "Actor1CountryCode", "Actor2CountryCode", "EventRootCode", "EventCode",
    "GoldsteinScale", "NumMentions", "NumSources", "AvgTone", "ActionGeo_CountryCode", "ActionGeo_Lat",
    "ActionGeo_Long", "SOURCEURL", "Actor1Type1Code", "Actor2Type1Code", "QuadClass", "themes", "persons",
    "organizations", "mentions_count", "avg_confidence",
)
# The five events whose results are known.
EVENTS = [
    (101, 20240101, "US", "CN", "01", "010", 0.0, 100, 10, 1.5, "US", 38.9, -77.0, "https://example.com/101",
     "GOV", "GOV", 1, ["POLITICS", "LEGISLATION"], ["Joe Biden", "Xi Jinping"], ["UN", "WHO"], 10, 95.0),
    (102, 20240101, "RU", "UA", "19", "190", -10.0, 500, 50, -8.5, "UA", 50.45, 30.52, "http://www.bbc.com/102",
     "MIL", "MIL", 4, ["TERROR", "TAX_MILITARY"], ["Vladimir Putin", "Volodymyr Zelenskyy"], ["NATO"], 50, 80.0),
    (103, 20240102, "GB", "FR", "07", "070", 7.0, 50, 5, 5.0, "GB", 51.5, -0.12, "https://example.org/103",
     "BUS", "GOV", 2, ["ECON_TRADE", "MARKET"], ["Rishi Sunak"], ["EU"], 5, 99.0),
    (104, 20240103, "IL", "PS", "19", "192", -9.0, 1000, 100, -9.5, "IL", 31.7, 35.2, "https://example.com/104",
     "MIL", "REB", 4, ["TERROR", "HUMAN_RIGHTS"], [], ["UN"], 100, 85.0),
    (105, 20240104, "BR", None, "03", "030", 4.0, 20, 2, 2.0, "BR", -15.7, -47.8, "https://example.com/105",
     "ENV", None, 1, ["ENV_CLIMATE"], [], ["NGO"], 2, 70.0),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


def event_rows(spark, rows):
    """Enriched events from dictionaries; fields left out are NULL, lists empty."""
    schema = ENRICHED_SCHEMA
    return conform(
        spark.createDataFrame([tuple(row.get(n) for n in schema.fieldNames()) for row in rows], schema)
    )


@pytest.fixture(scope="session")
def events(spark):
    return event_rows(spark, [dict(zip(FIELDS, row)) for row in EVENTS])


@pytest.fixture(scope="session")
def names(spark):
    rows = [("US", "United States"), ("UA", "Ukraine"), ("IL", "Israel")]
    return spark.createDataFrame(rows, "code string, name string")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def tree(frame) -> str:
    """Plan as it finally ran."""
    frame.collect()
    return plan(frame)
