"""Scalar rules on literal values."""

import pytest
from pyspark.sql import functions as F

from gatewright.functions import checks, dates, text as tx


@pytest.fixture(scope="module")
def value(spark):
    def of(column, raw=None):
        return spark.createDataFrame([(raw,)], "c string").select(column.alias("x")).first().x

    return of


C = "c"


@pytest.mark.parametrize("raw,want", [
    ("155", "00000155"), ("REQ-155", "00000155"), (" req-7 ", "00000007"), ("123456789", "123456789"), ("DP-00000155", "DP-00000155"),
    (None, ""), ("12a", "12a")])
def test_normalize_number(value, raw, want):
    assert value(tx.normalize_number(C), raw) == want


@pytest.mark.parametrize("raw,want", [("00000155", 155), ("REQ-155", 155), ("DP-00000155", 155), ("text", 0), (None, 0), ("12a", 0)])
def test_number_sort_value(value, raw, want):
    assert value(tx.number_sort_value(C), raw) == want


def test_three_ways_to_fill_a_number_differ(value):
    assert value(tx.zero_fill(C), "1234567890") == "1234567890"
    assert value(tx.last_digits_number(C), "1234567890") == "34567890"
    assert value(F.lpad(C, 8, "0"), "1234567890") == "12345678"


@pytest.mark.parametrize("raw,want", [("Commercial Domain", "commercial_domain"), (" __ ", ""), ("A--b/C ", "a_b_c"), (" x ", "x")])
def test_slug(value, raw, want):
    assert value(tx.slug(C), raw) == want


@pytest.mark.parametrize("raw,want", [
    ("x" * 90, "x" * 90), ("x" * 91, "x" * 87 + "..."), (" a \n b\t c ", "a b c"), (None, "")])
def test_log_text(value, raw, want):
    assert value(tx.log_text(C), raw) == want


@pytest.mark.parametrize("raw,error", [
    ("2024-02-30", True), ("2024-2-3", False), ("2024-01-01x", True), ("", False), ("24-01-01", True)])
def test_date(value, raw, error):
    assert (value(checks.date(C, "day").error, raw) is not None) == error


@pytest.mark.parametrize("raw,error", [
    ("javascript:alert(1)", True), ("http://", True), ("HTTPS://Example.com/a b", False), ("", False), ("https://x" + "y" * 2050, True)])
def test_url(value, raw, error):
    assert (value(checks.http_url(C, "link").error, raw) is not None) == error


def test_mail_domain_is_literal(value):
    assert value(checks.email(C, "example.com").error, "A@Example.com") is None
    assert value(checks.email(C, "example.com").value, " A@Example.com ") == "a@example.com"
    assert value(checks.email(C, "example.com").error, "a@exampleXcom") == "email must use example.com"
    assert value(checks.email(C, "example.com", "updated by").error, "") == "updated by is required"


@pytest.mark.parametrize("kind,raw,want", [
    ("checkbox", "true", True), ("checkbox", "false", False), ("checkbox", "TRUE", False), ("number", "0", True), ("text", "   ", False),
    ("text", None, False)])
def test_completeness(value, kind, raw, want):
    assert value(tx.answer_complete(F.lit(kind), C), raw) is want


AS_OF = "2024-03-10T12:00:00+00:00"


@pytest.mark.parametrize("raw,days,day", [
    ("2024-03-09T12:00:00Z", 1, "2024-03-09"), ("2024-03-09T12:00:01+00:00", 0, "2024-03-09"), ("2024-03-01", 9, "2024-03-01"),
    ("2024-03-08T23:30:00-02:00", 1, "2024-03-09"), ("2025-01-01", 0, "2025-01-01"), ("not a date at all", 0, "not a date"),
    (None, 0, ""), ("12:30", 0, "12:30"), ("1969-12-31T23:59:59Z", 19792, "1969-12-31")])
def test_elapsed_days(value, raw, days, day):
    assert value(dates.days_since(C, AS_OF), raw) == days
    assert value(dates.date_text(C), raw) == day


def test_instants_do_not_follow_the_session_zone(spark, value):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert value(dates.instant_micros(C), "1970-01-01T00:00:01") == 1_000_000
        assert value(dates.date_text(C), "1970-01-02T00:00:00Z") == "1970-01-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("raw,want", [
    ("Retail data", "lynx"), ("LYNX board", "lynx"), ("plain", "lynx"), ("ledger", "databricks")])
def test_ladder_matches_inside_words(value, raw, want):
    from gatewright.plans.imports import PLATFORM_STEPS, on

    assert value(tx.ladder(on(F.lower(C), PLATFORM_STEPS), "databricks"), raw) == want


@pytest.mark.parametrize("raw,flat,parent", [("latin_america", "global", "latin_america"), ("narm", "north_america", "global")])
def test_the_two_scope_ladders_differ(value, raw, flat, parent):
    from gatewright.plans import imports as im

    assert value(tx.ladder(im.on(C, im.SCOPE_STEPS_FLAT), "global"), raw) == flat
    assert value(tx.ladder(im.on(C, im.SCOPE_STEPS_PARENT), "global"), raw) == parent


def test_strip_leaves_visible_ends_alone_and_takes_all_white_space(spark):
    strip, white = tx.strip, tx.WS_CHARS
    ends = ["", "!", "~", "a", "\x7f", "\x00", "é", " ", " ", "😀", *white]
    texts = [None, *[a + m + z for a in ends for m in ("", "x y", "\tü ") for z in ends]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip("t").alias("by_name"), strip(F.col("t")).alias("by_column")).collect()
    want = [(r.t or "").strip(white) for r in rows]
    assert [r.by_name for r in rows] == want and [r.by_column for r in rows] == want
    assert "CASE WHEN" in str(strip("t"))  # columns with visible ends are not trimmed
