"""Explicit schemas (never inferred)."""

from pyspark.sql import types as T

# stored measurement row (one sensor reading)
MEASUREMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("room_id", T.LongType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("co2", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("presence", T.BooleanType()),
    ]
)

# incoming payload: five required fields
PAYLOAD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("co2", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("presence", T.BooleanType()),
    ]
)

WEATHER_FIELDS = [
    "outside_temp_max",
    "outside_temp_min",
    "precipitation",
    "cloudcover",
    "wind",
    "solar_radiation",
]

WEATHER = T.StructType(
    [
        T.StructField("ds", T.DateType()),
        T.StructField("outside_temp_max", T.DoubleType()),
        T.StructField("outside_temp_min", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("cloudcover", T.IntegerType()),
        T.StructField("wind", T.DoubleType()),
        T.StructField("solar_radiation", T.DoubleType()),
    ]
)

# weather API response: struct of parallel arrays (one response per request)
WEATHER_RESPONSE = T.StructType(
    [
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
                    T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
                    T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
                    T.StructField("cloudcover_mean", T.ArrayType(T.IntegerType())),
                    T.StructField("wind_speed_10m_max", T.ArrayType(T.DoubleType())),
                    T.StructField("shortwave_radiation_sum", T.ArrayType(T.DoubleType())),
                ]
            ),
        )
    ]
)

# change feed over the store: insert / delete / set_presence
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("presence", T.BooleanType()),
        T.StructField("co2", T.IntegerType()),
    ]
)

# one forecast day of one run (the 12-field result plus keys)
FORECAST_FIELDS = [
    "ds",
    "pred_temp",
    "outside_temp_max",
    "outside_temp_min",
    "precipitation",
    "cloudcover",
    "wind",
    "solar_radiation",
    "is_weekend",
    "is_holiday",
    "pred_co2",
    "advies",
]
