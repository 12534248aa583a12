"""Calendar rules for cutoff-bounded windows. Step 0 is the month of the cutoff, larger is older."""

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, functions as F


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def calendar_step(end: Column, event: Column) -> Column:
    """Difference in calendar months, not elapsed months."""
    return (F.year(end) - F.year(event)) * 12 + F.month(end) - F.month(event)


def add_month_steps(end: Column, step: Column) -> Column:
    """Same day `step` months earlier, clamped to the month length; always from the original cutoff."""
    return F.add_months(end, -step)


def asof_date(end: Column, step: Column, policy: str) -> Column:
    """As-of date of a step: `same_day_months` or `month_end_history` (step 0 keeps the exact cutoff)."""
    if policy == "same_day_months":
        return add_month_steps(end, step)
    if policy == "month_end_history":
        return F.when(step == 0, end).otherwise(F.last_day(F.add_months(month_start(end), -step)))
    raise ValueError(f"unknown as-of policy: {policy}")


def count_window_start(end: Column, steps: int = 12) -> Column:
    """First day of the oldest calendar month of a monthly sequence."""
    return F.add_months(month_start(end), 1 - steps)


def rolling_year_start(end: Column) -> Column:
    """Exclusive-year rolling window: one year back plus one day."""
    return F.date_add(F.add_months(end, -12), 1)


def recent_window(end: Column) -> tuple[Column, Column]:
    """Inclusive shifted dates four to one months before the cutoff; the newest month is left out."""
    return F.add_months(end, -4), F.add_months(end, -1)


def forward_window(end: Column, event: Column, days: int) -> Column:
    """True for cutoff < event <= cutoff + days."""
    return (event > end) & (event <= F.date_add(end, days))


def month_end_cutoffs(first: date, last: date, horizon: int, near: tuple[int, ...]) -> list[date]:
    """Month ends `near` months before the newest one that lies `horizon` days before `last`, and each year before it back to `first`.

    Every date from `first` to the newest cutoff lies in the twelve months up to some cutoff.
    """
    top = last - timedelta(days=horizon)
    newest = top.year * 12 + top.month - 1
    if (top + timedelta(days=1)).month == top.month:
        newest -= 1
    years = range(0, max(newest - (first.year * 12 + first.month - 1), 0) + 1, 12)

    def month_end(index: int) -> date:
        year, month = index // 12, index % 12 + 1
        return date(year, month, monthrange(year, month)[1])
    return sorted(month_end(newest - m) for m in {*near, *years})
