"""A gazetteer standing in for the live geocoding service.

Keys are geocoder query strings (the output of ``preprocess_loc``).  It holds
some literal entries, and by rule the fixture's places in every other state,
by the state's name and by a glued-on code, so direct hits, fall-back hits and
misses all occur.  On a real corpus this would be a gazetteer table read from
storage; the join code does not change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtrails.functions.location import COUNTRY_TAG, STATE_ABBREV, STATE_NAMES
from jobtrails.sources.tables import PLACES

SCHEMA = "key string, city string, state string, country string, latitude double, longitude double"

# Gazetteer rows (query key, city, state, country, lat, lon).
ROWS = [
    ("boston ma United States of America", "Boston", "Massachusetts",
     "United States of America", 42.3601, -71.0589),
    ("new york NY United States of America", "New York", "New York",
     "United States of America", 40.7128, -74.006),
    ("austin texas usa United States of America", "Austin", "Texas",
     "United States of America", 30.2672, -97.7431),
    ("old hickory tn united states of america united states of america United States of America",
     "Old Hickory", "Tennessee", "United States of America", 36.2584, -86.6475),
    ("chapel hill north carolina United States of America", "Chapel Hill", "North Carolina",
     "United States of America", 35.9132, -79.0558),
    ("san juan puerto rico United States of America", "San Juan", "Puerto Rico",
     "United States of America", 18.4655, -66.1057),
]


def rows() -> list[tuple]:
    """The literal rows, and those by rule."""
    made = []
    for i, place in enumerate(PLACES):
        for j, name in enumerate(STATE_NAMES[::2]):
            rest = (place.title(), name.title(), COUNTRY_TAG, 25.0 + i + j / 8, -70.0 - j)
            made.append((f"{place.lower()} {name.lower()} {COUNTRY_TAG}", *rest))
            glued = f"{place} {STATE_ABBREV[name]} {COUNTRY_TAG} {COUNTRY_TAG}".lower()
            made.append((f"{glued} {COUNTRY_TAG}", *rest))
    return ROWS + made


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)
