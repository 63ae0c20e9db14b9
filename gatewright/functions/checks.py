"""Typed field cleaning as column pairs: the cleaned value and the first error message, or NULL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.functions.dates import calendar_date
from gatewright.functions.text import strip
from gatewright.model import TEXT_LIMIT, URL_LIMIT


HTTP_URL = r"(?i)^https?://[^/?#]+"


@dataclass(frozen=True)
class Checked:
    value: Column
    error: Column


# fixed values: what is said of each fault
MESSAGES = {
    "missing": "{label} is required",
    "long": "{label} must be {limit} characters or fewer",
    "mail": "{label} must use {domain}",
    "date": "{label} must use YYYY-MM-DD format",
    "whole": "{label} must be a whole number",
    "large": "{label} is too large",
    "url": "{label} must be a valid http(s) URL",
}


def _checked(value: Column, label: str, faults: dict[str, Column], **words) -> Checked:
    """The value with the message of the first fault that holds, in the order given."""
    said = [F.when(at, F.lit(MESSAGES[name].format(label=label, **words))) for name, at in faults.items()]
    return Checked(value, F.coalesce(*said, F.lit(None).cast("string")))


def _filled(s: Column, required: bool, **faults: Column) -> dict[str, Column]:
    """Faults of a filled field, after the one of a blank field where it is required."""
    own = {name: (s != "") & at for name, at in faults.items()}
    return {"missing": s == ""} | own if required else own


def text(c, label: str, *, required: bool = False, max_length: int = TEXT_LIMIT) -> Checked:
    s = strip(c)
    return _checked(s, label, _filled(s, required, long=F.length(s) > max_length), limit=max_length)


def mail_pattern(domain: str) -> str:
    return rf"^[^@\s]+@{re.escape(domain)}$"


def is_mail(c, domain: str) -> Column:
    return F.lower(strip(c)).rlike(mail_pattern(domain))


def email(c, domain: str, label: str = "email", *, required: bool = True) -> Checked:
    s = F.lower(strip(c))
    return _checked(s, label, _filled(s, required, mail=~s.rlike(mail_pattern(domain))), domain=domain)


def date(c, label: str, *, required: bool = False) -> Checked:
    s = strip(c)
    return _checked(s, label, _filled(s, required, date=calendar_date(s).isNull()))


def whole_number(c, label: str, *, required: bool = False) -> Checked:
    """The number, and a message where the digits are beyond the type: never a silent NULL."""
    s = strip(c)
    digits = s.rlike(r"^\d+$")
    value = F.when(digits, s.try_cast("bigint"))
    return _checked(value, label, _filled(s, required, whole=~digits, large=value.isNull()))


def http_url(c, label: str, *, required: bool = False) -> Checked:
    s = strip(c)
    return _checked(s, label, _filled(s, required, long=F.length(s) > URL_LIMIT, url=~s.rlike(HTTP_URL)), limit=URL_LIMIT)


def first_error(*errors) -> Column:
    return F.coalesce(*[e.error if isinstance(e, Checked) else e for e in errors])
