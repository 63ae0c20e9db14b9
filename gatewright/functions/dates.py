"""ISO text dates and instants. Results do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.functions.text import _col, or_empty, strip

DAY_MICROS = 86_400_000_000
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def stripped_micros(s: Column) -> Column:
    """As instant_micros, for a text that is stripped already. Uses the text several times: give it as a plain column."""
    has_offset = s.endswith("Z") | F.substring(s, -6, 1).isin("+", "-")
    suffix = F.when(F.length(s) == 10, "T00:00:00+00:00").when(has_offset, "").otherwise("+00:00")
    return F.when(s.rlike(_ISO), F.unix_micros(F.try_to_timestamp(F.concat(s, suffix))))


def instant_micros(c) -> Column:
    """Microseconds since the epoch of an ISO text; a text without offset is UTC; NULL if it cannot be read."""
    return stripped_micros(strip(c))


def epoch_micros(as_of: str) -> int:
    """The same rule for a plan-time parameter."""
    t = datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def micros_to_date_text(us: Column) -> Column:
    days = _div(us - F.pmod(us, F.lit(DAY_MICROS)), DAY_MICROS).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def valid_instant_or_empty(c) -> Column:
    return F.when(instant_micros(c).isNotNull(), strip(c)).otherwise(F.lit(""))


def days_until(us: Column, as_of: str) -> Column:
    """Whole days from an instant to as_of, never negative, 0 for NULL."""
    elapsed = F.lit(epoch_micros(as_of)).cast("bigint") - us
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), _div(elapsed, DAY_MICROS)), F.lit(0).cast("bigint"))


def days_since(c, as_of: str) -> Column:
    return days_until(instant_micros(c), as_of)


def date_text(c) -> Column:
    return F.coalesce(micros_to_date_text(instant_micros(c)), F.substring(or_empty(c), 1, 10))


def days_label(days) -> Column:
    d = _col(days)
    return (
        F.when(d.isNull(), "Not set").when(d <= 0, "<1 day").when(d == 1, "1 day")
        .otherwise(F.concat(d.cast("string"), F.lit(" days")))
    )


def calendar_date(c) -> Column:
    """The date of a year-month-day text, NULL if it is not one."""
    s = strip(c)
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
