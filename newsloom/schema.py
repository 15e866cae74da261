"""Types, column lists and code dictionaries of the enriched event table."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_LIST = T.ArrayType(T.StringType())

# The enriched table, in its fixed column order.
ENRICHED_SCHEMA = T.StructType(
    [
        T.StructField("GLOBALEVENTID", T.LongType()),
        T.StructField("SQLDATE", T.IntegerType()),
        T.StructField("MonthYear", T.IntegerType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Actor1CountryCode", T.StringType()),
        T.StructField("Actor2CountryCode", T.StringType()),
        T.StructField("Actor1Type1Code", T.StringType()),
        T.StructField("Actor2Type1Code", T.StringType()),
        T.StructField("EventCode", T.StringType()),
        T.StructField("EventBaseCode", T.StringType()),
        T.StructField("EventRootCode", T.StringType()),
        T.StructField("QuadClass", T.IntegerType()),
        T.StructField("GoldsteinScale", T.DoubleType()),
        T.StructField("NumMentions", T.LongType()),
        T.StructField("NumSources", T.LongType()),
        T.StructField("AvgTone", T.DoubleType()),
        T.StructField("Actor1Geo_CountryCode", T.StringType()),
        T.StructField("Actor2Geo_CountryCode", T.StringType()),
        T.StructField("ActionGeo_CountryCode", T.StringType()),
        T.StructField("ActionGeo_Lat", T.DoubleType()),
        T.StructField("ActionGeo_Long", T.DoubleType()),
        T.StructField("SOURCEURL", T.StringType()),
        T.StructField("themes", STRING_LIST),
        T.StructField("persons", STRING_LIST),
        T.StructField("organizations", STRING_LIST),
        T.StructField("mentions_count", T.LongType()),
        T.StructField("avg_confidence", T.DoubleType()),
    ]
)
ENRICHED_COLUMNS = ENRICHED_SCHEMA.fieldNames()
LIST_COLUMNS = ("themes", "persons", "organizations")
ENRICHMENT_COLUMNS = (*LIST_COLUMNS, "mentions_count", "avg_confidence")
RAW_EVENT_COLUMNS = [c for c in ENRICHED_COLUMNS if c not in ENRICHMENT_COLUMNS]

# The partition column of the stored table: a date copy of SQLDATE.
PARTITION_COLUMN = "event_date"

# Positions of the fields in the landed tab-separated files.
EVENT_POSITIONS = {
    "GLOBALEVENTID": 0,
    "SQLDATE": 1,
    "MonthYear": 2,
    "Year": 3,
    "Actor1CountryCode": 7,
    "Actor1Type1Code": 12,
    "Actor2CountryCode": 17,
    "Actor2Type1Code": 22,
    "EventCode": 26,
    "EventBaseCode": 27,
    "EventRootCode": 28,
    "QuadClass": 29,
    "GoldsteinScale": 30,
    "NumMentions": 31,
    "NumSources": 32,
    "AvgTone": 34,
    "Actor1Geo_CountryCode": 37,
    "Actor2Geo_CountryCode": 44,
    "ActionGeo_CountryCode": 51,
    "ActionGeo_Lat": 53,
    "ActionGeo_Long": 54,
    "SOURCEURL": 57,
}
# The 61-field layout moves the action place and the URL.
EVENT_POSITIONS_61 = {
    **EVENT_POSITIONS,
    "ActionGeo_CountryCode": 53,
    "ActionGeo_Lat": 56,
    "ActionGeo_Long": 57,
    "SOURCEURL": 60,
}
MENTION_POSITIONS = {"GLOBALEVENTID": 0, "MentionIdentifier": 5, "Confidence": 11}
ENTITY_POSITIONS = {"DocumentIdentifier": 4, "Themes": 7, "Persons": 11, "Organizations": 13}

# Theme categories and the tokens that put a theme into them.
THEME_CATEGORIES = {
    "POLITICS": ("ELECTIONS", "GOVERNMENT", "LEGISLATION", "POLITICAL"),
    "ECONOMY": ("ECON_", "TRADE", "MARKET", "SANCTIONS", "WB_ECONOMY"),
    "HEALTH": ("HEALTH_", "PANDEMIC", "DISEASE", "WB_HEALTH"),
    "ENVIRONMENT": ("ENV_", "CLIMATE", "NATURAL_DISASTER", "FLOOD", "DROUGHT"),
    "TECHNOLOGY": ("CYBER_", "ARTIFICIAL_INTEL", "INTERNET"),
    "ENERGY": ("ENERGY_", "OIL", "NUCLEAR", "SOLAR"),
    "HUMAN_RIGHTS": ("HUMAN_RIGHTS", "REFUGEES", "DISCRIMINATION"),
    "SECURITY": ("TERROR", "WEAPONS", "TAX_MILITARY"),
}
POPULAR_THEME = "POPULAR_NEWS"
POPULAR_MENTIONS = 10

# Event category groups as root codes; None means every code.
CATEGORY_ROOT_CODES = {
    "ALL": None,
    "CONFLICT": ("18", "19", "20"),
    "DIPLOMACY": ("01", "02", "03"),
    "COOPERATION": ("04", "05", "06", "07", "08"),
    "PRESSURE": ("09", "10", "11", "12", "13"),
}

# Display labels.
QUAD_CLASS_LABELS = {
    1: "Verbal Cooperation",
    2: "Material Cooperation",
    3: "Verbal Conflict",
    4: "Material Conflict",
}
ROOT_CODE_LABELS = {
    "01": "Make Public Statement",
    "02": "Appeal",
    "03": "Express Intent to Cooperate",
    "04": "Consult",
    "05": "Engage in Diplomatic Cooperation",
    "06": "Engage in Material Cooperation",
    "07": "Provide Aid",
    "08": "Yield",
    "09": "Investigate",
    "10": "Demand",
    "11": "Disapprove",
    "12": "Reject",
    "13": "Threaten",
    "14": "Protest",
    "15": "Exhibit Military Posture",
    "16": "Reduce Relations",
    "17": "Coerce",
    "18": "Assault",
    "19": "Fight",
    "20": "Use Unconventional Mass Violence",
}
ACTOR_TYPE_LABELS = {
    "GOV": "Government",
    "MIL": "Military",
    "REB": "Rebel",
    "MED": "Media",
    "NGO": "NGO",
    "IGO": "Intergovernmental Org",
    "CVL": "Civilian",
    "OPP": "Political Opposition",
    "BUS": "Business",
    "CRM": "Criminal",
    "UAF": "Unaffiliated Armed Forces",
    "AGR": "Agriculture",
    "EDU": "Education",
    "ELI": "Elite",
    "ENV": "Environment",
    "HLH": "Health",
    "LAB": "Labor",
    "LEG": "Legislature",
    "REL": "Religion",
    "SOC": "Social",
    "SPY": "Intelligence",
    "JUD": "Judiciary",
    "MOD": "Moderate",
    "RAD": "Radical",
    "REF": "Refugee",
    "SET": "Settler",
    "VET": "Veteran",
}
