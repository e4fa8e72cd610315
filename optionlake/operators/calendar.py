"""Exchange sessions as tables, and session arithmetic as equi-joins.

The session table has one row per calendar day of a bounded span, so it is the one
dimension that is broadcast: `calendar_days` refuses spans of more than 200 years.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optionlake import names as N

MAX_CALENDAR_DAYS = 200 * 366
SECONDS_PER_YEAR = 365.0 * 24.0 * 60.0 * 60.0

# Unscheduled full-day closures and 13:00 closes of the New York exchange.
ADHOC_CLOSURES = (
    "1985-09-27",
    "1994-04-27",
    "2001-09-11",
    "2001-09-12",
    "2001-09-13",
    "2001-09-14",
    "2004-06-11",
    "2007-01-02",
    "2012-10-29",
    "2012-10-30",
    "2018-12-05",
    "2025-01-09",
)
ADHOC_EARLY_CLOSES = (
    "1997-12-26",
    "1999-12-31",
    "2003-12-26",
    "2013-07-03",
)


@dataclass(frozen=True)
class MarketRules:
    timezone: str = "America/New_York"
    close_time: str = "16:00:00"
    early_close_time: str = "13:00:00"
    decision_time: str = "15:45:00"
    minutes_before_close: int = 15
    am_settled_roots: tuple[str, ...] = ("SPX",)


def _good_friday(year: Column) -> Column:
    """Friday before Gregorian Easter (anonymous computus, integer arithmetic)."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b)).cast("int")

    century = div(year, 100)
    golden = year % 19
    epact = (century - div(century, 4) - div(century * 8 + 13, 25) + golden * 19 + 15) % 30
    moon = epact - div(epact, 28) * (
        F.lit(1) - div(epact, 28) * F.floor(F.lit(29) / (epact + 1)).cast("int")
        * div(F.lit(21) - golden, 11)
    )
    weekday = (year + div(year, 4) + moon + 2 - century + div(century, 4)) % 7
    offset = moon - weekday
    month = F.lit(3) + div(offset + 40, 44)
    day = offset + 28 - div(month, 4) * 31
    return F.date_sub(F.make_date(year, month, day), 2)


def calendar_days(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    span = (end - start).days + 1
    if span < 1 or span > MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar span of {span} days is outside 1..{MAX_CALENDAR_DAYS}")
    first = F.lit(start.isoformat()).cast("date")
    return spark.range(0, span, 1, 1).select(
        F.date_add(first, F.col("id").cast("int")).alias("calendar_date")
    )


def exchange_sessions(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """(session_date, is_early_close) from the New York exchange's holiday rules."""
    day = F.col("calendar_date")
    year, month, dom = F.year(day), F.month(day), F.dayofmonth(day)
    dow = F.dayofweek(day)  # 1 = Sunday
    sun, mon, tue, wed, thu, fri, sat = (dow == F.lit(i) for i in range(1, 8))

    def nth(weekday: Column, first_dom: int) -> Column:
        return weekday & dom.between(first_dom, first_dom + 6)

    def fixed(m: int, d: int, saturday_moves: bool = True) -> Column:
        """Holiday on month/day, moved to Monday from Sunday and to Friday from Saturday."""
        on_day = (month == m) & (dom == d) & ~sat & ~sun
        shifted = F.date_sub(day, 1)
        from_sunday = mon & (F.month(shifted) == m) & (F.dayofmonth(shifted) == d)
        ahead = F.date_add(day, 1)
        from_saturday = fri & (F.month(ahead) == m) & (F.dayofmonth(ahead) == d)
        return on_day | from_sunday | (from_saturday if saturday_moves else F.lit(False))

    holiday = (
        fixed(1, 1, saturday_moves=False)
        | ((year >= 1998) & (month == 1) & nth(mon, 15))
        | ((month == 2) & nth(mon, 15))
        | (day == _good_friday(year))
        | ((month == 5) & mon & (dom >= 25))
        | ((year >= 2022) & fixed(6, 19))
        | fixed(7, 4)
        | ((month == 9) & nth(mon, 1))
        | ((month == 11) & nth(thu, 22))
        | fixed(12, 25)
        | day.isin(*[F.lit(d).cast("date") for d in ADHOC_CLOSURES])
    )
    early = (
        ((month == 11) & nth(fri, 23))
        | ((month == 12) & (dom == 24) & (mon | tue | wed | thu))
        | ((year >= 1995) & (month == 7) & (dom == 3) & (mon | tue | thu))
        | ((year >= 1995) & (year < 2013) & (month == 7) & (dom == 5) & fri)
        | ((year > 2013) & (month == 7) & (dom == 3) & wed)
        | day.isin(*[F.lit(d).cast("date") for d in ADHOC_EARLY_CLOSES])
    )
    return (
        calendar_days(spark, start, end)
        .filter(~sat & ~sun & ~holiday)
        .select(day.alias("session_date"), early.alias("is_early_close"))
    )


def weekday_sessions(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """A venue that trades on every weekday and never closes early."""
    day = F.col("calendar_date")
    return (
        calendar_days(spark, start, end)
        .filter(~F.dayofweek(day).isin(1, 7))
        .select(day.alias("session_date"), F.lit(False).alias("is_early_close"))
    )


def iso_with_offset(utc: Column, timezone: str) -> Column:
    """ISO-8601 text of a UTC timestamp in a zone, with the zone's offset."""
    local = F.from_utc_timestamp(utc, timezone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    size = F.abs(minutes)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(minutes < 0, "-").otherwise("+"),
        F.format_string("%02d:%02d", F.floor(size / 60).cast("int"), size % 60),
    )


def session_table(sessions: DataFrame, rules: MarketRules = MarketRules()) -> DataFrame:
    """Number the sessions and attach close and decision instants (UTC timestamps)."""
    def instant(clock: Column) -> Column:
        local = F.concat(F.col("session_date").cast("string"), F.lit(" "), clock)
        return F.to_utc_timestamp(local.cast("timestamp"), rules.timezone)

    close = F.when(F.col("is_early_close"), rules.early_close_time).otherwise(rules.close_time)
    buffer = F.expr(f"INTERVAL {int(rules.minutes_before_close)} MINUTES")
    return (
        sessions
        .withColumn("session_no", F.row_number().over(Window.orderBy("session_date")).cast("long"))
        .withColumn("close_ts", instant(close))
        .withColumn("decision_ts",
                    F.least(instant(F.lit(rules.decision_time)), F.col("close_ts") - buffer))
        .withColumn("has_decision_time", F.col("close_ts") >= F.col("decision_ts"))
        .withColumn("decision_iso", iso_with_offset(F.col("decision_ts"), rules.timezone))
    )


def session_lookup(table: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per calendar day with its previous, own and following session.

    Both windows run over the bounded calendar dimension, never over data rows.
    """
    days = calendar_days(table.sparkSession, start, end)
    order = Window.orderBy("calendar_date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    on_or_before = order.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("session_date")
    return (
        days.join(table, days.calendar_date == table.session_date, "left")
        .select(
            "calendar_date",
            own.isNotNull().alias("is_session"),
            F.last(own, ignorenulls=True).over(before).alias("previous_session"),
            F.first(own, ignorenulls=True).over(after).alias("next_session"),
            F.last(own, ignorenulls=True).over(on_or_before).alias("settlement_session"),
            "session_no", "close_ts", "decision_ts", "has_decision_time", "decision_iso",
        )
    )


def with_session(df: DataFrame, lookup: DataFrame, date_column: str = N.DATE,
                 columns: tuple[str, ...] = ("is_session", "previous_session", "next_session"),
                 prefix: str = "") -> DataFrame:
    """Attach session columns of a date by one broadcast equi-join on the day."""
    side = lookup.select(
        F.col("calendar_date").alias("_day"), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return df.join(F.broadcast(side), df[date_column] == F.col("_day"), "left").drop("_day")


def add_decision_timestamp(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """ISO text of the effective decision instant; a day without a session is an error."""
    joined = with_session(df, lookup, columns=("decision_iso",))
    return joined.withColumn(
        N.DECISION_TS,
        F.when(F.col("decision_iso").isNull(),
               F.raise_error(F.concat(F.lit("not a trading session: "),
                                      F.col(N.DATE).cast("string"))).cast("string"))
        .otherwise(F.col("decision_iso")),
    ).drop("decision_iso")


def add_last_tradable(df: DataFrame, lookup: DataFrame,
                      rules: MarketRules = MarketRules()) -> DataFrame:
    """Session on which the contract last trades: one earlier for AM-settled roots.

    An expiration outside the calendar is an error.
    """
    settled = with_session(df, lookup, "expiration", ("settlement_session",), "_")
    side = lookup.select(F.col("calendar_date").alias("_day"),
                         F.col("previous_session").alias("_before"))
    joined = settled.join(F.broadcast(side), F.col("_settlement_session") == F.col("_day"), "left")
    last = F.when(F.col("root").isin(*rules.am_settled_roots), F.col("_before")) \
        .otherwise(F.col("_settlement_session"))
    unresolved = F.raise_error(F.concat(
        F.lit("the calendar has no session for expiration "),
        F.col("expiration").cast("string"))).cast("date")
    checked = F.when(F.col("expiration").isNotNull() & last.isNull(), unresolved).otherwise(last)
    return joined.withColumn("last_tradable_session", checked) \
        .drop("_day", "_before", "_settlement_session")


def add_tau_years(df: DataFrame, lookup: DataFrame, rules: MarketRules = MarketRules(),
                  strict: bool = True) -> DataFrame:
    """ACT/365 time from the decision instant to the last tradable close, floored at zero.

    Quote dates that are no session raise in strict mode and give NULL otherwise.
    """
    dated = add_last_tradable(df, lookup, rules)
    dated = with_session(dated, lookup, N.DATE, ("decision_ts", "has_decision_time"), "_q_")
    dated = with_session(dated, lookup, "last_tradable_session", ("close_ts",), "_x_")
    usable = F.coalesce(F.col("_q_has_decision_time"), F.lit(False))
    seconds = F.unix_timestamp("_x_close_ts") - F.unix_timestamp("_q_decision_ts")
    tau = F.when(F.col(N.DATE) > F.col("last_tradable_session"), F.lit(0.0)).otherwise(
        F.greatest(seconds, F.lit(0)).cast("double") / SECONDS_PER_YEAR)
    unusable = (
        F.raise_error(F.concat(F.lit("no usable decision snapshot on "),
                               F.col(N.DATE).cast("string"))).cast("double")
        if strict else F.lit(None).cast("double")
    )
    return dated.withColumn("tau_years", F.when(usable, tau).otherwise(unusable)).drop(
        "_q_decision_ts", "_q_has_decision_time", "_x_close_ts")


def add_gap_sessions(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sessions strictly between quote_date and target_date; a non-session target raises."""
    joined = with_session(df, lookup, N.DATE, ("session_no",), "_q_")
    joined = with_session(joined, lookup, N.TARGET_DATE, ("session_no",), "_t_")
    gap = F.col("_t_session_no") - F.col("_q_session_no") - 1
    checked = F.when(gap.isNull() | (gap < 0),
                     F.raise_error("target_date is not a session after quote_date").cast("long"))
    return joined.withColumn("target_gap_sessions", checked.otherwise(gap)).drop(
        "_q_session_no", "_t_session_no")
