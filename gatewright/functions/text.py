"""String columns: cleaning, numbers written as text, search tokens, log text. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.model import LOG_TEXT_LIMIT

# The full Unicode white-space set; engines' own \s and trim() know fewer characters.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Null-safe strip: NULL becomes ''. Looks at the ends of the text only."""
    text = F.coalesce(_col(c), F.lit(""))
    stripped = F.btrim(text, F.lit(WS_CHARS))
    if not isinstance(c, str):
        return stripped
    # btrim goes through all of a text and all of the set; columns that begin and end with visible ASCII need none of it
    last = F.substring(text, -1, 1)
    return F.when((text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f"), text).otherwise(stripped)


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def blank(c) -> Column:
    c = _col(c)
    return c.isNull() | (c == "")


def or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First value that is neither NULL nor ''; the last argument is the default and is taken as it is."""
    *head, last = [_col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def zero_fill(digits, width: int = 8) -> Column:
    """Left-fill with zeros to a width, never cutting longer text."""
    digits = _col(digits)
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def normalize_number(c) -> Column:
    s = strip(c)
    digits = F.regexp_extract(s, r"(?i)^(?:REQ-)?(\d+)$", 1)
    return F.when(digits == "", s).otherwise(zero_fill(digits))


def number_sort_value(c) -> Column:
    tail = F.nullif(F.regexp_extract(strip(c), r"(\d+)$", 1), F.lit(""))
    # digits beyond the type sort last instead of first
    return F.coalesce(tail.try_cast("bigint"), F.when(tail.isNotNull(), F.lit((1 << 63) - 1)), F.lit(0).cast("bigint"))


def last_digits_number(c, width: int = 8) -> Column:
    """Keep the last `width` characters, then left-fill."""
    return F.lpad(F.right(_col(c), F.lit(width)), width, "0")


def digits_only(c) -> Column:
    return F.regexp_replace(_col(c), r"\D", "")


def checkbox(c) -> Column:
    return F.when(F.lower(strip(c)) == "true", F.lit("true")).otherwise(F.lit("false"))


def answer_complete(input_type, value) -> Column:
    v = strip(value)
    return F.when(_col(input_type) == "checkbox", v == "true").otherwise(v != "")


def log_text(c, limit: int = LOG_TEXT_LIMIT) -> Column:
    t = strip(F.regexp_replace(or_empty(c), f"{WS}+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def display_name(name, email) -> Column:
    return F.coalesce(_col(name), F.substring_index(_col(email), "@", 1))


def joined_detail(*cols, sep: str = " | ") -> Column:
    """Join the filled values only."""
    return F.concat_ws(sep, *[F.nullif(_col(c), F.lit("")) for c in cols])


def search_blob(*cols) -> Column:
    """Lower-cased text of all given fields; NULL fields are skipped."""
    return F.lower(F.concat_ws(" ", *[_col(c).cast("string") for c in cols]))


def search_tokens(query: str | None) -> list[str]:
    return (query or "").strip().lower().split()


def contains_all(blob, tokens) -> Column:
    hit = F.lit(True)
    for token in tokens:
        hit = hit & _col(blob).contains(token)
    return hit


def canonical_json(columns) -> Column:
    """Whole-row text with a fixed column order and kept NULLs, the base of row hashes."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_md5(columns) -> Column:
    return F.md5(canonical_json(columns))


def ladder(steps, default, value=None) -> Column:
    """Ordered first-match mapping.

    steps: (kind, column, patterns, result); kind 'in' compares exactly, 'contains' looks for substrings.
    """
    out = None
    for kind, column, patterns, result in steps:
        c = _col(column)
        if kind == "in":
            test = c.isin(list(patterns))
        else:
            test = F.lit(False)
            for p in patterns:
                test = test | c.contains(p)
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(test, result) if out is None else out.when(test, result)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default)
