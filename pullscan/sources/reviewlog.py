"""The review event log: JSON lines, appended by day, read back with one superset schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullscan.model import PR_KEY, REVIEW_LOG


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with microseconds and offset, whatever the session's zone."""
    return F.concat(F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def event_rows(source: DataFrame, step: int, event: str, at: Column, fields: dict[str, Column]) -> DataFrame:
    """One event per source row as JSON text. ``step, file_ord, rule_ord, line, seq`` order the log of a review;
    the text keeps only the fields that have a value."""
    have = source.columns

    def order(c, kind):
        return (F.col(c) if c in have else F.lit(0)).cast(kind).alias(c)

    return source.select(
        *PR_KEY,
        F.lit(step).alias("step"),
        order("file_ord", "bigint"),
        order("rule_ord", "int"),
        order("line", "int"),
        order("seq", "int"),
        F.lit(event).alias("event"),
        F.to_date(_utc(at)).alias("event_date"),
        F.to_json(
            F.struct(
                iso_utc(at).alias("timestamp"),
                F.lit(event).alias("event"),
                *[c.alias(k) for k, c in fields.items()],
            )
        ).alias("value"),
    )


def write_review_log(events: DataFrame, path: str) -> None:
    """Append the events as JSON lines, one folder per day."""
    events.select("event_date", "value").write.mode("append").partitionBy("event_date").text(path)


def parse_review_log(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed log rows from JSON lines in a ``value`` column; fields an event lacks are null."""
    return lines.select(*keep, F.from_json("value", REVIEW_LOG).alias("e")).select(*keep, "e.*")


def read_review_log(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The log with ``event_date``. A range of days (both included, as ``yyyy-MM-dd``) reads only the folders of these days."""
    lines = spark.read.text(path)
    day = F.col("event_date").cast("date")
    if since is not None:
        lines = lines.where(day >= F.lit(since).cast("date"))
    if until is not None:
        lines = lines.where(day <= F.lit(until).cast("date"))
    return parse_review_log(lines, ("event_date",))
