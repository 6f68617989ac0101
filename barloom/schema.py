"""Fixed schemas, timeframes and session constants."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("exchange", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
FILLS = "order_id string, symbol string, side string, quantity decimal(20,4), price decimal(20,4), timestamp timestamp, fill_id string, strategy_id string"
TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "1d": 86400, "1w": 604800}
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "1d": "1 day"}
SESSION_OPEN, SESSION_CLOSE = 9 * 3600 + 15 * 60, 15 * 3600 + 30 * 60  # seconds of the exchange's day
DAYS_PER_YEAR, MINUTES_PER_DAY = 252, 375
