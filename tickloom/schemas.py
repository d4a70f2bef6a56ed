"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, D, DATE, TS = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampType()

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]

BARS = _schema(symbol=S, bar_date=DATE, open=D, high=D, low=D, close=D, volume=D)
# The same columns before numeric coercion (vendor text files).
RAW_BARS = _schema(symbol=S, bar_date=DATE, open=S, high=S, low=S, close=S, volume=S)
INTRADAY_BARS = _schema(symbol=S, bar_start=TS, open=D, high=D, low=D, close=D, volume=D)

CHAIN_REQUIRED = ["expiration_date", "strike", "option_type"]
CHAIN = _schema(
    symbol=S, as_of=DATE, expiration_date=DATE, strike=D, option_type=S,
    bid=D, ask=D, implied_volatility=D, delta=D,
)

AUDIT_COLUMNS = [
    "timestamp", "entry_type", "model_version", "ticker", "signal_date", "score", "decision",
    "reason", "probability", "threshold", "position_size", "operator_id", "run_id", "audit_id",
]
AUDIT = _schema(
    timestamp=TS, entry_type=S, model_version=S, ticker=S, signal_date=S, score=D, decision=S,
    reason=S, probability=D, threshold=D, position_size=D, operator_id=S, run_id=S, audit_id=S,
    checksum=S,
)
