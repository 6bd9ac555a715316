"""Month-precision dates (B3) and stint durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_month_date(year: Column, month: Column) -> Column:
    """First day of (year, month).

    year null -> null; month null or 0 -> January; two-digit year -> 19xx;
    an impossible month or year -> null (no ANSI error).
    """
    y = year.try_cast("int") if hasattr(year, "try_cast") else F.expr(f"try_cast({year} as int)")
    m = month.try_cast("int") if hasattr(month, "try_cast") else F.expr(f"try_cast({month} as int)")
    m = F.when(m.isNull() | (m == 0), F.lit(1)).otherwise(m)
    y = F.when(y < 100, y + 1900).otherwise(y)
    ok = m.between(1, 12) & y.between(1, 9999)
    return F.when(y.isNotNull() & ok, F.make_date(y, m, F.lit(1)))


def stint_years(start: Column, end: Column) -> Column:
    """(end - start) in years of 365.25 days."""
    return F.datediff(end, start) / F.lit(365.25)


def stint_years_text(start: Column, end: Column) -> Column:
    return F.format_string("%.1f yrs", stint_years(start, end))
