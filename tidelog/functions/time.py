"""Dates, zones and cron schedules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET = r"([+-]\d{2}:?\d{2}|Z)\z"


def offset_of(date: Column) -> Column:
    """Offset of a date's text as ``+hhmm``."""
    found = F.regexp_extract(date, OFFSET, 1)
    return F.when(found == "Z", "+0000").otherwise(F.replace(found, F.lit(":"), F.lit("")))


def instant(date: Column) -> Column:
    """Instant of an ISO text, null if it is none."""
    return F.try_to_timestamp(date)


def _colon(offset: Column) -> Column:
    return F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))


def format_in_zone(ts: Column, offset: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss+hhmm`` in the zone of an offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), _colon(offset)), "yyyy-MM-dd'T'HH:mm:ss"), offset)


def iso_in_zone(ts: Column, zone: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSS`` in a zone with its offset as ``+hh:mm``, or ``Z`` for none."""
    utc, local = (F.convert_timezone(None, z, ts.cast("timestamp_ntz")) for z in (F.lit("UTC"), zone))
    minutes = F.timestamp_diff("MINUTE", utc, local)
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(minutes == 0, "Z").otherwise(offset))


#: Largest hour of an offset.
_OFFSET_HOURS = 14


def client_zone(text: Column) -> Column:
    """A zone's name as it is (case ignored), or an offset ``[+-]h[h][:mm]`` as ``UTC+h`` or ``UTC+hh:mm``; null for anything else."""
    from zoneinfo import available_timezones

    part = lambda n: F.regexp_extract(text, r"\A([+-]?)([0-9]{1,2})(?::([0-9]{2}))?\z", n)
    hours, minutes = F.nullif(part(2), F.lit("")).cast("int"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    sign = F.when(part(1) == "-", "-").otherwise("+")
    offset = F.when(minutes == 0, F.concat(F.lit("UTC"), sign, hours.cast("string"))).otherwise(F.concat(F.lit("UTC"), sign, F.format_string("%02d:%02d", hours, minutes)))
    named = F.lower(text).isin(*sorted({z.lower() for z in available_timezones()}))
    return F.when(named, text).when((hours <= _OFFSET_HOURS) & (minutes <= 59), offset)


def asset_directory(date: Column, id_: Column) -> Column:
    """``YYYY-MM/DD/id``, in the zone that the date is written in."""
    return F.concat(F.substring(date, 1, 7), F.lit("/"), F.substring(date, 9, 2), F.lit("/"), id_)


def file_timestamp(name: Column) -> Column:
    """Instant that a file name ``YYYYMMDDThhmmssZ.ext`` encodes; null where the digits are no valid time."""
    digits = F.regexp_extract(name, r"\A(\d{8}T\d{6})Z\.[^/]+\z", 1)
    ts = F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
    return F.when(F.date_format(ts, "yyyyMMdd'T'HHmmss") == digits, ts)


def start_of_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def start_of_next_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts) + F.expr("interval 1 minute")


def weekday(date: Column) -> Column:
    """Cron's number of the weekday, Sunday 0."""
    return F.dayofweek(date) - 1


def days_in_month(date: Column) -> Column:
    return F.day(F.last_day(date))


class CronError(ValueError):
    """An expression that is no POSIX cron expression."""


_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def _field(text: str, low: int, high: int) -> tuple[int, ...]:
    if text == "*":
        return tuple(range(low, high + 1))
    out: set[int] = set()
    for part in text.split(","):
        ends = part.split("-")
        if len(ends) > 2 or not all(x.isascii() and x.isdigit() for x in ends):
            raise CronError(f"not a list of numbers and ranges: {text}")
        a, b = int(ends[0]), int(ends[-1])
        if not low <= a <= b <= high:
            raise CronError(f"out of {low} to {high}: {part}")
        out.update(range(a, b + 1))
    return tuple(sorted(out))


@dataclass(frozen=True)
class Cron:
    """Minutes, hours, days of the month, months and weekdays that an expression allows."""

    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    #: Both day fields are restricted, so either may fit. A field is restricted unless it is written ``*``.
    either: bool
    any_day: bool = field(compare=False)
    any_weekday: bool = field(compare=False)


def parse_cron(text: str) -> Cron:
    """Five fields of numbers, ranges and lists; equal expressions are equal values."""
    fields = text.split()
    if len(fields) != 5:
        raise CronError(f"five fields needed: {text!r}")
    parts = [_field(f, *r) for f, r in zip(fields, _RANGES, strict=True)]
    any_day, any_weekday = fields[2] == "*", fields[4] == "*"
    return Cron(*parts, either=not any_day and not any_weekday, any_day=any_day, any_weekday=any_weekday)


def equivalent(a: Cron, b: Cron) -> bool:
    return a == b


_PATTERN = r"\d+(?:-\d+)?"


def _numbers(field: Column, low: int, high: int) -> Column:
    """Numbers that a field's text allows, as an array."""
    part = lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(field, ","), part))))
    return F.when(field == "*", F.sequence(F.lit(low), F.lit(high))).otherwise(listed)


def cron_columns(cron: Column) -> dict[str, Column]:
    """The fields of well-formed expressions in a column, as arrays of numbers, and whether either day field may fit (neither is written ``*``)."""
    fields = F.split(F.trim(cron), r"\s+")
    names = ("minutes", "hours", "days", "months", "weekdays")
    either = (fields[2] != "*") & (fields[4] != "*")
    return {f"cron_{n}": _numbers(fields[i], *_RANGES[i]) for i, n in enumerate(names)} | {"cron_either": either}


def valid_cron(cron: Column) -> Column:
    """Five fields of numbers, ranges or lists in form; bounds are checked as well."""
    one = rf"(?:\*|{_PATTERN}(?:,{_PATTERN})*)"
    shaped = cron.rlike(rf"\A\s*{one}(?:\s+{one}){{4}}\s*\z")
    fields = F.split(F.trim(cron), r"\s+")

    def bounded(i: int, low: int, high: int) -> Column:
        ends = lambda p: (F.split(p, "-")[0].cast("int") >= low) & (F.element_at(F.split(p, "-"), -1).cast("int") <= high) & (F.split(p, "-")[0].cast("int") <= F.element_at(F.split(p, "-"), -1).cast("int"))
        return (fields[i] == "*") | F.forall(F.split(fields[i], ","), ends)

    ok = shaped
    for i, (low, high) in enumerate(_RANGES):
        ok = F.when(ok, bounded(i, low, high)).otherwise(False)
    return ok


def _valid_day(day: Column) -> Column:
    """Whether a date is a day of the schedule in the ``cron_`` columns; both day fields restricted means either."""
    dom, dow = F.array_contains("cron_days", F.day(day)), F.array_contains("cron_weekdays", weekday(day))
    return F.array_contains("cron_months", F.month(day)) & F.when(F.col("cron_either"), dom | dow).otherwise(dom & dow)


def cron_matches(ts: Column) -> Column:
    """Whether the minute of ``ts`` is one of the schedule in the ``cron_`` columns."""
    return F.array_contains("cron_minutes", F.minute(ts)) & F.array_contains("cron_hours", F.hour(ts)) & _valid_day(F.to_date(ts))


def _minute_of_day() -> Column:
    return F.flatten(F.transform("cron_hours", lambda h: F.transform("cron_minutes", lambda m: h * 60 + m)))


#: Days that a schedule is searched over: ten years; the first of them, which are enough for most.
SEARCH_DAYS, NEAR_DAYS = 3653, 62


def _at(day: Column, minute: Column) -> Column:
    return F.timestamp_add("MINUTE", minute, day.cast("timestamp"))


def cron_previous(ts: Column) -> Column:
    """Latest time of the schedule up to the minute of ``ts``, within ten years; else null.

    Either the latest minute of that day, or the last of the nearest earlier valid day. Days are searched, never minutes.
    """
    day, now = F.to_date(ts), F.hour(ts) * 60 + F.minute(ts)
    today = F.when(_valid_day(day), F.array_max(F.filter(_minute_of_day(), lambda m: m <= now)))
    stretches = ((F.date_sub(day, NEAR_DAYS), F.date_sub(day, 1)), (F.date_sub(day, SEARCH_DAYS), F.date_sub(day, NEAR_DAYS + 1)))
    earlier = F.coalesce(*[F.array_max(F.filter(F.sequence(*x), _valid_day)) for x in stretches])
    return F.when(today.isNotNull(), _at(day, today)).otherwise(_at(earlier, F.array_max(_minute_of_day())))


def cron_next(ts: Column) -> Column:
    """First time of the schedule after the minute of ``ts``, within ten years; else null."""
    day, now = F.to_date(ts), F.hour(ts) * 60 + F.minute(ts)
    today = F.when(_valid_day(day), F.array_min(F.filter(_minute_of_day(), lambda m: m > now)))
    stretches = ((F.date_add(day, 1), F.date_add(day, NEAR_DAYS)), (F.date_add(day, NEAR_DAYS + 1), F.date_add(day, SEARCH_DAYS)))
    later = F.coalesce(*[F.array_min(F.filter(F.sequence(*x), _valid_day)) for x in stretches])
    return F.when(today.isNotNull(), _at(day, today)).otherwise(_at(later, F.array_min(_minute_of_day())))


def evaluate_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """What each task does now: ``decision`` is running, retry, cron, waiting_retry or waiting.

    ``tasks`` has name, cron, last_attempt, last_success, last_failure,
    pending_retry_until, running. A retry that is due comes before the schedule;
    the schedule is due if the last attempt is before its latest time.
    """
    t = tasks.withColumns(cron_columns(F.col("cron"))).withColumn("previous", cron_previous(now))
    retry = F.col("pending_retry_until")
    due_cron = F.col("previous").isNotNull() & (F.col("last_attempt").isNull() | (F.col("last_attempt") < F.col("previous")))
    decision = F.when(F.col("running"), "running").when(retry <= now, "retry").when(due_cron, "cron").when(retry.isNotNull(), "waiting_retry").otherwise("waiting")
    return t.withColumn("decision", decision)


def evaluation_stats(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("decision").agg(F.count("*").alias("n"))


def next_due(tasks: DataFrame, now: Column) -> DataFrame:
    """Earliest time that any task is due, running ones included, and milliseconds to sleep until then, from one second to three hours."""
    t = tasks.withColumns(cron_columns(F.col("cron"))).withColumn("_due", F.least("pending_retry_until", cron_next(now)))
    first = t.agg(F.min("_due").alias("due"), F.max(now).alias("_now"))
    wait = F.unix_millis("due") - F.unix_millis("_now")
    return first.select("due", F.greatest(F.lit(1_000), F.least(F.lit(10_800_000), F.coalesce(wait, F.lit(10_800_000)))).cast("bigint").alias("sleep_ms"))


def reconcile_tasks(registered: DataFrame, persisted: DataFrame, scheduler_id: Column) -> DataFrame:
    """``decision`` for every registered task: new, orphaned (another scheduler's), overridden (other schedule) or preserved. Others are dropped."""
    p = persisted.select("name", F.col("cron").alias("_cron"), F.col("retry_delay_ms").alias("_delay"), F.col("scheduler_id").alias("_owner"), F.lit(True).alias("_there"))
    same = (F.col("cron") == F.col("_cron")) & (F.col("retry_delay_ms") == F.col("_delay"))
    decision = F.when(F.col("_there").isNull(), "new").when(~F.col("_owner").eqNullSafe(scheduler_id), "orphaned").when(~same, "overridden").otherwise("preserved")
    return registered.join(p, "name", "left").withColumn("decision", decision).drop("_cron", "_delay", "_owner", "_there")
