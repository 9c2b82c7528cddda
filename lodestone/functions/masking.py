"""One-way masking, and the column-name heuristic that asks for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first that a lower-cased column name contains marks it as sensitive.
SENSITIVE_FRAGMENTS = ["email", "phone", "ssn", "social_security", "credit_card", "card_number", "password", "secret"]
HIDDEN, GAP = "●●●", "…"


def mask(value: str) -> str:
    """Fewer than eight characters: hidden whole; else the first and last two show."""
    return HIDDEN if len(value) < 8 else value[:2] + GAP + value[-2:]


def mask_column(col: Column) -> Column:
    """mask() as a column expression; null stays null."""
    return F.when(F.length(col) < 8, F.lit(HIDDEN)).otherwise(F.concat(F.substring(col, 1, 2), F.lit(GAP), F.substring(col, -2, 2)))


def sensitive_fragment(column_name: str) -> str | None:
    low = column_name.lower()
    return next((f for f in SENSITIVE_FRAGMENTS if f in low), None)
