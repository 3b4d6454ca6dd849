"""Date arithmetic that counts the calendar boundaries crossed, not elapsed units.

31 Jan to 1 Feb is one month apart here and 23:00:59 to 23:01:00 one minute. Built
from date parts, so no value passes through the session time zone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: str | date | Column) -> Column:
    """A date literal from an ISO text or ``date``; a column passes through as a date."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("date")


def day_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Midnights between two dates or stamps."""
    return F.datediff(_col(end), _col(start))


def minute_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Minute boundaries between two stamps."""
    def of_day(c: Column) -> Column:
        return F.hour(c) * 60 + F.minute(c)

    start, end = _col(start), _col(end)
    return F.datediff(end, start) * 1440 + of_day(end) - of_day(start)


def month_index(c: ColumnOrName) -> Column:
    """Months since year 0, so that differences count month boundaries."""
    c = _col(c)
    return F.year(c) * 12 + F.month(c) - 1


def month_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Month boundaries between two dates."""
    return month_index(end) - month_index(start)


def add_months(c: ColumnOrName, months: int) -> Column:
    """Same day ``months`` later, clipped to the month end."""
    return F.add_months(_col(c), months)


def month_start(c: ColumnOrName) -> Column:
    return F.trunc(_col(c).cast("date"), "MM")


def month_end(c: ColumnOrName) -> Column:
    return F.last_day(_col(c).cast("date"))


def month_key_text(c: ColumnOrName) -> Column:
    """'YYYY-MM'."""
    return F.substring(_col(c).cast("date").cast("string"), 1, 7)


def month_key_int(c: ColumnOrName) -> Column:
    """YYYYMM."""
    c = _col(c)
    return F.year(c) * 100 + F.month(c)


def same_month(start: ColumnOrName, end: ColumnOrName) -> Column:
    return month_key_int(start) == month_key_int(end)


def half_year(c: ColumnOrName) -> Column:
    """'Q1-Q2' or 'Q3-Q4'; 'What' where the date is missing."""
    m = F.month(_col(c))
    return F.when(m <= 6, "Q1-Q2").when(m >= 7, "Q3-Q4").otherwise("What")


def age_years(birth: ColumnOrName, on: ColumnOrName) -> Column:
    """Completed years; a birthday has passed once (month, day) is reached."""
    birth, on = _col(birth), _col(on)
    due = F.month(on) * 100 + F.dayofmonth(on) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(on) - F.year(birth) - due.cast("int")


def age_group(age: ColumnOrName) -> Column:
    """Reporting band of an age; '0.5' marks a missing age."""
    age = _col(age)
    # The lower edge of each band and its label.
    bands = [(65, "65+"), (55, "55-64"), (45, "45-54"), (35, "35-44"), (25, "25-34"), (18, "18-24")]
    out = F.when(age.isNull(), "0.5")
    for low, label in bands:
        out = out.when(age >= low, label)
    return out.otherwise("<18")


def spans_days(first: ColumnOrName, last: ColumnOrName, at_least: int = 1) -> Column:
    """True when two dates lie at least ``at_least`` days apart, in either order."""
    return F.abs(day_diff(first, last)) >= at_least
