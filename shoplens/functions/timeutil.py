"""Time parsing, formatting and reporting windows.

Stored times are UTC instants (the session zone is UTC); a tenant's zone enters only where a
local date or a local report bound is needed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats of the report interface.
REPORT_BOUND = "yyyy-MM-dd'T'HH-mm-ss"
DASHBOARD_DATE = "yyyy-MM-dd"
EXPERIMENT_DATE = "dd-MMM-yyyy"
SHORT_DAY = "MMM dd"
ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ssxxx"

# No zone is further than this from UTC, so a literal bound widened by it never loses a row.
ZONE_SPAN = dt.timedelta(hours=15)


def _zone(tz: str | Column) -> Column:
    return F.lit(tz) if isinstance(tz, str) else tz


def iso_utc(ts: Column) -> Column:
    """ISO text with a numeric offset, e.g. ``2020-05-21T07:30:00+00:00``."""
    return F.date_format(ts, ISO_OFFSET)


def epoch_to_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_to_time(text: Column) -> Column:
    """ISO text with any offset to an instant; null when it cannot be read."""
    return text.try_cast("timestamp")


def iso_to_epoch(text: Column) -> Column:
    return F.unix_timestamp(iso_to_time(text))


def report_bound(text: Column, tz: str | Column) -> Column:
    """A report bound given in local time as a UTC instant."""
    return F.to_utc_timestamp(F.to_timestamp(text, REPORT_BOUND), _zone(tz))


def dashboard_date(text: Column, tz: str | Column) -> Column:
    """A local calendar date as the UTC instant at which it starts."""
    return F.to_utc_timestamp(F.to_timestamp(text, DASHBOARD_DATE), _zone(tz))


def local_time(ts: Column, tz: str | Column) -> Column:
    return F.from_utc_timestamp(ts, _zone(tz))


def local_day(ts: Column, tz: str | Column) -> Column:
    return F.to_date(local_time(ts, tz))


def local_date_text(ts: Column, tz: str | Column) -> Column:
    return F.date_format(local_time(ts, tz), DASHBOARD_DATE)


def experiment_date_text(ts: Column) -> Column:
    return F.date_format(ts, EXPERIMENT_DATE)


def short_day(day: Column) -> Column:
    return F.date_format(day, SHORT_DAY)


def elapsed_hours(start: Column, end: Column) -> Column:
    """Whole hours from start to end."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).cast("bigint")


def utc_literal(value: dt.datetime) -> Column:
    """A Python time (naive means UTC) as a timestamp literal."""
    aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return F.lit(aware)


def _between_literals(df: DataFrame, column: str, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Open range against literals, so that the scan and the day layout can prune."""
    kept = df.filter((F.col(column) > utc_literal(lo)) & (F.col(column) < utc_literal(hi)))
    if "day" in df.columns:
        kept = kept.filter(F.col("day").between(F.lit(lo.date()), F.lit(hi.date())))
    if has_months(df, column):
        kept = kept.filter(F.col("open") | F.col("part").between(F.lit(f"{lo:%Y-%m}"), F.lit(f"{hi:%Y-%m}")))
    return kept


def has_months(df: DataFrame, column: str) -> bool:
    """Whether rows that are not ``open`` lie in folders ``part`` of the column's month, as the store says of its tables."""
    return "part" in df.columns and df.schema["part"].metadata.get("layout") == f"month of {column}"


def after(df: DataFrame, column: str, earliest: DataFrame) -> DataFrame:
    """Rows later than the one value of ``earliest``, which prunes the folders of stored tables at run time.

    Without a value there are no rows.
    """
    kept = df.filter(F.col(column) > earliest.scalar())
    if has_months(df, column):
        month = earliest.select(F.date_format(earliest.columns[0], "yyyy-MM"))
        kept = kept.filter(F.col("open") | (F.col("part") >= month.scalar()))
    return kept


@dataclass(frozen=True)
class ReportWindow:
    """An open time range in local time: ``start < t < end``.

    ``timezone=None`` reads the bounds in each tenant's own zone.
    """

    start: str
    end: str
    timezone: str | None = None

    def _parsed(self, text: str) -> dt.datetime:
        return dt.datetime.strptime(text, "%Y-%m-%dT%H-%M-%S")

    def restrict(self, df: DataFrame, column: str, clients: DataFrame) -> DataFrame:
        """Rows inside the window; in the tenants' own zones, of registered tenants only."""
        near = _between_literals(
            df, column, self._parsed(self.start) - ZONE_SPAN, self._parsed(self.end) + ZONE_SPAN
        )
        if self.timezone is not None:
            lo, hi = (report_bound(F.lit(t), self.timezone) for t in (self.start, self.end))
            return near.filter((F.col(column) > lo) & (F.col(column) < hi))
        zone = F.col("client_timezone")
        bounds = clients.select(
            "client_id",
            report_bound(F.lit(self.start), zone).alias("_lo"),
            report_bound(F.lit(self.end), zone).alias("_hi"),
        )
        return (
            near.join(bounds, "client_id")
            .filter((F.col(column) > F.col("_lo")) & (F.col(column) < F.col("_hi")))
            .drop("_lo", "_hi")
        )


@dataclass(frozen=True)
class RecentDays:
    """The last ``days`` local calendar days, the current one cut off at ``now``.

    Days are half-open. ``strict_edges`` reproduces the narrower range that drops the first
    instant of a day and its last second.
    """

    now: dt.datetime
    days: int = 7
    timezone: str | None = None
    strict_edges: bool = False

    @property
    def _now(self) -> Column:
        return utc_literal(self.now)

    def zone(self) -> Column:
        return F.col("client_timezone") if self.timezone is None else F.lit(self.timezone)

    def today(self, tz: Column) -> Column:
        return local_day(self._now, tz)

    def bucket(self, df: DataFrame, column: str, clients: DataFrame) -> DataFrame:
        """Rows of the last days with their local ``day``; a stored ``day`` is replaced."""
        now = self.now if self.now.tzinfo is None else self.now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        lo = now - dt.timedelta(days=self.days) - ZONE_SPAN
        near = _between_literals(df, column, lo, now + dt.timedelta(microseconds=1)).drop("day")
        near = near.filter(F.col(column) < self._now)
        zones = clients.select("client_id", self.zone().alias("_tz"))
        out = (
            near.join(zones, "client_id")
            .withColumn("_local", local_time(F.col(column), F.col("_tz")))
            .withColumn("day", F.to_date("_local"))
            .filter(F.col("day") >= F.date_sub(self.today(F.col("_tz")), self.days - 1))
        )
        if self.strict_edges:
            first = F.col("day").cast("timestamp") + F.expr(f"interval {now.microsecond} microseconds")
            last = F.col("day").cast("timestamp") + F.expr(
                f"interval {86399 * 1000000 + now.microsecond} microseconds"
            )
            closing = (F.col("_local") < last) | (F.col("day") == self.today(F.col("_tz")))
            out = out.filter((F.col("_local") > first) & closing)
        return out.drop("_local", "_tz")

    def grid(self, clients: DataFrame) -> DataFrame:
        """One row per tenant and day with its UTC bounds; the last day ends at ``now``."""
        tz = F.col("_tz")
        day = F.col("day")
        last_second = F.to_utc_timestamp(
            day.cast("timestamp") + F.expr("interval 86399 seconds"), tz
        )
        return (
            clients.select("client_id", self.zone().alias("_tz"))
            .withColumn("_today", self.today(tz))
            .withColumn(
                "day",
                F.explode(
                    F.sequence(F.date_sub("_today", self.days - 1), F.col("_today"), F.expr("interval 1 day"))
                ),
            )
            .select(
                "client_id",
                "day",
                short_day(day).alias("label"),
                F.to_utc_timestamp(day.cast("timestamp"), tz).alias("start_time"),
                F.when(day == F.col("_today"), self._now).otherwise(last_second).alias("end_time"),
            )
        )
