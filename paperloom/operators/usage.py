"""Use over time: counts per day, week and month with the empty ones, the latest, per action."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a calendar, and how many of them the last thirty days are shown in.
RECENT = {"day": 30, "week": 5, "month": 2}


def period(t: Column, unit: str) -> Column:
    """The day a period begins; weeks begin on Sunday."""
    if unit == "week":
        return F.date_sub(F.to_date(t), F.dayofweek(t) - 1)
    return F.to_date(F.date_trunc(unit, t))


def counts(events: DataFrame, time: str, unit: str = "day", until: date | None = None, everything: bool = True) -> DataFrame:
    """``period, n_events, total_count`` for each period of the calendar from
    the first event to the last (or the last ``RECENT`` up to ``until``).
    ``total_count`` counts the whole history. Counting is partial first; the
    calendar is as long as the history has periods."""
    per = events.where(F.col(time).isNotNull()).groupBy(period(F.col(time), unit).alias("period")).agg(F.count("*").alias("n_events"))
    span = per.agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.sum("n_events").alias("total_count"))
    step = {"day": F.expr("interval 1 day"), "week": F.expr("interval 7 days"), "month": F.expr("interval 1 month")}[unit]
    if everything:
        spine = F.sequence("lo", "hi", step)
    else:
        last = period(F.lit(until).cast("timestamp"), unit) if until else F.col("hi")
        back = {"day": lambda: F.date_sub(last, 29), "week": lambda: F.date_sub(last, 28), "month": lambda: F.add_months(last, -1)}[unit]()
        spine = F.sequence(back, last, step)
    calendar = span.where("lo is not null").select(F.explode(spine).alias("period"), "total_count")
    return calendar.join(per, "period", "left").select("period", F.coalesce("n_events", F.lit(0)).alias("n_events"), "total_count")


def actions(events: DataFrame, action: str) -> DataFrame:
    return events.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n_events"))


def latest(events: DataFrame, time: str, key: str, most: int = 1000) -> DataFrame:
    """The newest events of a history that keeps so many; equal times by key."""
    return events.orderBy(F.col(time).desc(), F.col(key).desc()).limit(most)


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.2f", ms.cast("double") / 1000), F.lit("s")))


def token_estimate(text: Column) -> Column:
    """A third of the length, rounded up."""
    return F.ceil(F.length(text) / 3).cast("long")


def words_counted(text: Column) -> Column:
    """Ideographs, and words of letters and digits."""
    return (F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) + F.regexp_count(text, F.lit("[A-Za-z0-9]+"))).cast("long")
