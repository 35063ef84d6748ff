"""Short money text: sign, currency, thousands as K, M or B."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CURRENCY = "₹"
# Unit sizes and suffixes.
UNITS = ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"))


def money(amount: Column, currency: str = DEFAULT_CURRENCY) -> Column:
    """Column expression; below one thousand the full number with separators.

    Amounts between -1000 and 0 carry the sign twice: before the currency and on
    the number.
    """
    size = F.abs(amount)
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.lit(currency), F.format_string("%,.2f", amount))
    for unit, suffix in reversed(UNITS):
        short = F.concat(sign, F.lit(currency), F.format_string("%.2f", size / unit),
                         F.lit(suffix))
        text = F.when(size >= unit, short).otherwise(text)
    return F.when(amount.isNotNull(), text)


def money_text(amount: float, currency: str = DEFAULT_CURRENCY) -> str:
    """The same for one driver-side number."""
    sign = "-" if amount < 0 else ""
    for unit, suffix in UNITS:
        if abs(amount) >= unit:
            return f"{sign}{currency}{abs(amount) / unit:.2f}{suffix}"
    return f"{sign}{currency}{amount:,.2f}"
