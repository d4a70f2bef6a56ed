"""Option-chain source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schemas

# Vendor field names (fixed values).
RENAME = {
    "impliedVolatility": "implied_volatility",
    "expiration": "expiration_date",
    "optionType": "option_type",
    "contractType": "option_type",
    "type": "option_type",
    "lastPrice": "last",
}
# Numeric fields of a chain (fixed values).
NUMERIC = ("strike", "bid", "ask", "last", "implied_volatility", "delta")


def normalize_chain(raw: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Rename vendor fields; bad numbers and dates become NULL; check required columns."""
    chain = raw.withColumnsRenamed({k: v for k, v in (rename or RENAME).items() if k in raw.columns})
    missing = [c for c in schemas.CHAIN_REQUIRED if c not in chain.columns]
    if missing:
        raise ValueError(f"chain lacks required columns: {missing}")
    casts = {c: F.col(c).try_cast("double") for c in NUMERIC if c in chain.columns}
    casts["expiration_date"] = F.col("expiration_date").try_cast("date")
    return chain.withColumns(casts)
