"""Listing, lookup and display rules over the tender table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import codes, display


def list_conditions(
    *,
    code: str | None = None,
    status: str | None = None,
    min_budget: float | str | None = None,
    max_budget: float | str | None = None,
    location: str | None = None,
) -> Column:
    """Every given filter, joined by AND; without any filter all rows pass."""
    money = lambda v: F.lit(str(v)).cast("decimal(14,2)")
    given = []
    if status is not None:
        given.append(F.col("status") == status)
    if location is not None:
        given.append(F.col("location") == location)
    if min_budget is not None:
        given.append(F.col("budget_with_vat") >= money(min_budget))
    if max_budget is not None:
        given.append(F.col("budget_with_vat") <= money(max_budget))
    if code is not None:
        given.append(codes.has_code(F.col("cpv_codes"), code))
    return reduce(lambda a, b: a & b, given, F.lit(True))


def list_tenders(tenders: DataFrame, *, limit: int, offset: int = 0, **filters) -> DataFrame:
    """One page of the matching tenders, newest first; the key settles ties."""
    return (
        tenders.filter(list_conditions(**filters))
        .orderBy(F.desc("published_at"), "expediente")
        .offset(offset)
        .limit(limit)
    )


def list_total(tenders: DataFrame, *, limit: int, offset: int = 0, **filters) -> DataFrame:
    """The envelope of a page: number of matches, page size and rows on this page."""
    total = tenders.filter(list_conditions(**filters)).agg(F.count("*").alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
    return total.select(
        "total",
        returned.cast("bigint").alias("returned"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
    )


def tender_by_key(tenders: DataFrame, key: str) -> DataFrame:
    return tenders.filter(F.col("expediente") == key)


def vertical_filter(tenders: DataFrame) -> DataFrame:
    """Tenders with at least one code in the IT services division."""
    return tenders.filter(codes.in_it_division(F.col("cpv_codes")))


def with_deadline_display(tenders: DataFrame, as_of: Column) -> DataFrame:
    days = display.days_until(F.col("submission_deadline"), as_of)
    return (
        tenders.withColumn("days", days)
        .withColumn("urgency", display.urgency(F.col("days")))
        .withColumn("deadline_text", display.deadline_text(F.col("days")))
    )


def status_counts(tenders: DataFrame, as_of: Column) -> DataFrame:
    """How many tenders still say open, and how many of those have expired."""
    is_open = F.col("status") == "open_for_submission"
    expired = is_open & (F.col("submission_deadline") < as_of)
    return tenders.agg(
        F.count("*").alias("total"),
        F.count_if(is_open).alias("open_status"),
        F.count_if(expired).alias("open_but_expired"),
        F.count_if(is_open & F.col("submission_deadline").isNull()).alias("open_no_deadline"),
    ).withColumn(
        "expired_share", F.round(F.try_divide(F.col("open_but_expired"), F.col("open_status")), 9)
    )
