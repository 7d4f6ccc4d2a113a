"""Date column functions. Days are UTC days whatever the session time zone; "now" is an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from newsgauge.functions.text import WS, blank_to_null

ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def as_instant(moment: dt.datetime | str | Column) -> Column:
    """A timestamp column; a datetime or text without zone is taken as UTC."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(int(moment.timestamp()) * 1_000_000 + moment.microsecond))


def epoch_to_day(seconds: Column) -> Column:
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return day.cast("string")


def utc_day(instant: Column, minus_seconds: Column | int = 0) -> Column:
    back = F.lit(minus_seconds) if isinstance(minus_seconds, int) else minus_seconds
    return epoch_to_day(F.unix_seconds(instant) - back)


def normalise_date(text: Column, as_of) -> Column:
    """Relative or partial dates to ``YYYY-MM-DD``; anything else unchanged, blank stays blank."""
    now = as_instant(as_of)

    def ago(unit: str, seconds: int):
        # a count that leads out of the calendar, or out of a LONG, leaves the text as it is; a cast that fails is slow, so no blank is cast
        n = blank_to_null(F.when(F.contains(text, F.lit(unit)), F.regexp_extract(text, rf"([0-9]+){WS}*{unit}", 1))).try_cast("bigint")
        usable = n.isNotNull() & (n <= 60_000_000_000 // seconds)
        return usable, utc_day(now, F.when(usable, n) * seconds)

    days, hours, minutes = ago("天前", 86400), ago("小时前", 3600), ago("分钟前", 60)
    month_day = "([0-9]{1,2})月([0-9]{1,2})日"
    full = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    return (
        F.when(F.contains(text, F.lit("今天")), utc_day(now))
        .when(F.contains(text, F.lit("昨天")), utc_day(now, 86400))
        .when(F.contains(text, F.lit("前天")), utc_day(now, 2 * 86400))
        .when(*days)
        .when(*hours)
        .when(*minutes)
        .when(
            text.rlike(month_day),
            F.concat_ws(
                "-",
                F.substring(utc_day(now), 1, 4),
                two(F.regexp_extract(text, month_day, 1)),
                two(F.regexp_extract(text, month_day, 2)),
            ),
        )
        .when(
            text.rlike(full),
            F.concat_ws(
                "-",
                F.regexp_extract(text, full, 1),
                two(F.regexp_extract(text, full, 2)),
                two(F.regexp_extract(text, full, 3)),
            ),
        )
        .otherwise(F.coalesce(text, F.lit("")))
    )


def epoch_day(seconds: Column, upper: int | None = None) -> Column:
    """Epoch seconds to a day; blank below 1e9 and, where given, above ``upper``."""
    ok = seconds >= 1_000_000_000
    if upper is not None:
        ok = ok & (seconds <= upper)
    return F.when(ok, epoch_to_day(seconds)).otherwise("")


def mail_date_day(text: Column) -> Column:
    """Day of an RFC 822 date, moved to UTC; ISO instants work too, other text passes through."""
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    said = F.regexp_extract(
        text, rf"([0-9]{{1,2}} (?:{months}) [0-9]{{4}}(?: [0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?)", 1
    )
    offset = F.regexp_extract(text, r"([+-][0-9]{4})\z", 1)
    moment = F.try_to_timestamp(
        F.concat(said, F.lit(" "), F.when(offset == "", "+0000").otherwise(offset)),
        F.lit("d MMM yyyy[ HH:mm[:ss]] Z"),
    )
    # an ISO day without time passes through as it is
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*(Z|[+-][0-9]{2}:[0-9]{2})\z")
    return F.coalesce(
        F.when(said != "", utc_day(moment)),
        F.when(iso, utc_day(text.try_cast("timestamp"))),
        text,
    )


def api_date_day(text: Column) -> Column:
    """Leading ISO day of an instant; otherwise as :func:`mail_date_day`."""
    lead = F.regexp_extract(text, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(lead != "", lead).otherwise(mail_date_day(text))


def range_instants(date_from: Column, date_to: Column, as_of, days_back: int = 365) -> Column:
    """Struct (start, end) in epoch seconds for a day range taken at +08:00, end no later than now."""
    now = F.unix_seconds(as_instant(as_of))

    def instant(day: Column, time: str) -> Column:
        return F.unix_seconds(F.concat(day, F.lit(f"T{time}+08:00")).try_cast("timestamp"))

    return F.struct(
        F.coalesce(instant(date_from, "00:00:00"), now - days_back * 86400).alias("start"),
        F.least(F.coalesce(instant(date_to, "23:59:59"), now), now).alias("end"),
    )


def _span_days(date_from: Column, as_of) -> Column:
    start = F.unix_seconds(F.concat(date_from, F.lit("T00:00:00+08:00")).try_cast("timestamp"))
    return (F.unix_seconds(as_instant(as_of)) - start) / 86400


def news_recency(date_from: Column, as_of) -> Column:
    """Smallest relative window that covers the range: 7d, 30d, 90d, 1y or blank."""
    span = F.greatest(_span_days(date_from, as_of), F.lit(0))
    return (
        F.when(span <= 7, "7d").when(span <= 30, "30d").when(span <= 90, "90d").when(span <= 365, "1y").otherwise("")
    )


def wechat_recency(date_from: Column, as_of) -> Column:
    span = _span_days(date_from, as_of)
    return F.when(span <= 1, "day").when(span <= 7, "week").when(span <= 180, "half_year").otherwise("all")


def api_freshness(days_back: Column) -> Column:
    return F.when(days_back <= 1, "Day").when(days_back <= 7, "Week").otherwise("Month")


def check_range(date_from: str, date_to: str) -> tuple[str, str]:
    """Validate a requested day range; raises ``ValueError`` with the reason."""
    if not date_from or not date_to:
        raise ValueError("a date range is needed")
    try:
        first, last = dt.date.fromisoformat(date_from), dt.date.fromisoformat(date_to)
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a date: {date_from!r}, {date_to!r}") from e
    if first > last:
        raise ValueError("the range starts after it ends")
    return first.isoformat(), last.isoformat()


def range_reason(date_from: Column, date_to: Column) -> Column:
    """Why a landed request has no valid day range, or NULL: the rules of :func:`check_range` for days ``yyyy-MM-dd``, row by row."""

    def day(c: Column) -> Column:
        return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))

    missing = (F.coalesce(date_from, F.lit("")) == "") | (F.coalesce(date_to, F.lit("")) == "")
    return (F.when(missing, "missing").when(day(date_from).isNull() | day(date_to).isNull(), "not_a_date")
            .when(day(date_from) > day(date_to), "starts_after_end"))
