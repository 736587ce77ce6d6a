"""Table contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw history records: every value arrives as text.
RAW_HISTORY_FIELDS = [
    "NORAD_CAT_ID", "OBJECT_NAME", "EPOCH", "CREATION_DATE", "REV_AT_EPOCH", "INCLINATION",
    "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "MEAN_MOTION", "ECCENTRICITY", "BSTAR",
]
RAW_HISTORY = T.StructType([T.StructField(f, T.StringType()) for f in RAW_HISTORY_FIELDS])

CATALOGUE = T.StructType([
    T.StructField("NORAD_CAT_ID", T.LongType()),
    T.StructField("OBJECT_NAME", T.StringType()),
    T.StructField("COUNTRY_CODE", T.StringType()),
    T.StructField("OBJECT_TYPE", T.StringType()),
    T.StructField("SEMIMAJOR_AXIS", T.DoubleType()),
])

# name in the typed table -> (raw field, type)
HISTORY_CASTS = {
    "norad": ("NORAD_CAT_ID", "bigint"),
    "object_name": ("OBJECT_NAME", "string"),
    "epoch": ("EPOCH", "timestamp_ntz"),
    "creation_date": ("CREATION_DATE", "timestamp_ntz"),
    "rev_at_epoch": ("REV_AT_EPOCH", "bigint"),
    "inclination": ("INCLINATION", "double"),
    "raan": ("RA_OF_ASC_NODE", "double"),
    "arg_perigee": ("ARG_OF_PERICENTER", "double"),
    "mean_anomaly": ("MEAN_ANOMALY", "double"),
    "mean_motion": ("MEAN_MOTION", "double"),
    "eccentricity": ("ECCENTRICITY", "double"),
    "bstar": ("BSTAR", "double"),
}
DERIVED = ["sma", "apogee", "period", "velocity"]
HISTORY = T.StructType(
    [T.StructField(name, {"bigint": T.LongType(), "string": T.StringType(),
                          "timestamp_ntz": T.TimestampNTZType(), "double": T.DoubleType()}[kind])
     for name, (_, kind) in HISTORY_CASTS.items()]
    + [T.StructField(name, T.DoubleType()) for name in DERIVED]
)
