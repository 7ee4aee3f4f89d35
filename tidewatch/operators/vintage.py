"""Vintages: the weekly series of every entity as it was known on each as-of date, for a whole grid of dates at once.

The triangle is grouped once by entity into one array per week of (day known, count). An as-of date then folds each
week's entries that were known by it, so neither a range join nor a loop over dates is needed, and what one task holds
of an entity is bounded by the calendar. The result has one row per (entity, as-of date) with the series ``s`` from the
first week of all to the week of the as-of date; every family of features is a projection of it.

Defined cases: an entity is part of a vintage once any of its cells is known; weeks without known cells are 0; an as-of
date before the first week has no rows, one after the last week reads the series up to the last week; null keys and
weeks are left out; an empty triangle gives no rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "entity_key string, country string, disease string, as_of date, s array<double>"


def week_start(column: Column) -> Column:
    return F.date_trunc("week", column).cast("date")


def span(tri: DataFrame):
    """(first, last) week of a triangle, or None if it is empty."""
    row = tri.agg(F.min("week").alias("a"), F.max("week").alias("b")).first()
    return None if row["a"] is None else row


@dataclass(frozen=True)
class Vintages:
    """``frame``: entity_key, country, disease, as_of, s. ``grid``: the as-of dates (a calendar, so bounded). ``first``: the
    first week of every series; None if the triangle is empty."""

    frame: DataFrame
    grid: DataFrame
    first: dt.date | None


def visible(tri: DataFrame, grid: DataFrame) -> Vintages:
    """The vintages of the as-of dates in ``grid`` (column as_of; dates of a calendar).

    ``tri``: entity_key, country, disease, week, available_week, count.
    """
    spark = tri.sparkSession
    row = span(tri)
    grid = grid.select("as_of").distinct()
    if row is None:
        return Vintages(spark.createDataFrame([], SCHEMA), grid, None)
    first, last = F.lit(row["a"]), F.lit(row["b"])
    size = (row["b"] - row["a"]).days // 7 + 1
    cell = F.struct(F.datediff("available_week", first).alias("a"), F.col("count").cast("double").alias("y"))
    known = tri.where(F.col("entity_key").isNotNull() & F.col("week").isNotNull() & F.col("available_week").isNotNull())
    weekly = known.groupBy("entity_key", "country", "disease", (F.datediff("week", first) / 7).cast("int").alias("i")).agg(F.collect_list(cell).alias("cells"))
    per = weekly.groupBy("entity_key", "country", "disease").agg(F.map_from_entries(F.collect_list(F.struct("i", "cells"))).alias("m"))
    none = F.array().cast("array<struct<a:int,y:double>>")
    by_week = per.select("entity_key", "country", "disease", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none)).alias("w"))
    crossed = by_week.crossJoin(F.broadcast(grid.where(F.col("as_of") >= first)))  # a calendar
    day, now = F.datediff("as_of", first), F.datediff(F.least(week_start(F.col("as_of")), last), first)
    series = F.transform(F.slice("w", F.lit(1), (now / 7).cast("int") + 1), lambda cells: F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + F.when(x["a"] <= day, x["y"]).otherwise(0.0)))
    seen = F.exists(F.slice("w", F.lit(1), (now / 7).cast("int") + 1), lambda cells: F.exists(cells, lambda x: x["a"] <= day))
    return Vintages(crossed.where(seen).select("entity_key", "country", "disease", "as_of", series.alias("s")), grid, row["a"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def last(s: Column, weeks: int) -> Column:
    """The last weeks of a series, all of it if it is shorter."""
    return F.slice(s, F.greatest(F.size(s) - weeks + 1, F.lit(1)), F.lit(weeks))


def last_sum(s: Column, weeks: int) -> Column:
    return total(last(s, weeks))


def last_mean(s: Column, weeks: int) -> Column:
    return last_sum(s, weeks) / F.greatest(F.least(F.size(s), F.lit(weeks)), F.lit(1))


def previous_four(s: Column) -> Column:
    """The four weeks before the last four; 0 while there are fewer than eight."""
    return F.when(F.size(s) >= 8, total(F.slice(s, F.greatest(F.size(s) - 7, F.lit(1)), F.lit(4)))).otherwise(0.0)


def weeks_since(s: Column, at_most: int = 260) -> Column:
    """Weeks since the last week with activity, or the length of the series (at most ``at_most``) if there is none."""
    place = F.array_position(F.transform(F.reverse(s), lambda x: x > 0), True)
    return F.when(place > 0, (place - 1).cast("double")).otherwise(F.least(F.size(s), F.lit(at_most)).cast("double"))


def season(grid: DataFrame, first_week: dt.date, ahead_days: int = 0, reach: int = 2) -> DataFrame:
    """(as_of, at, years): positions of the weeks whose ISO week lies within ``reach`` (on a circle of 53) of that of the
    target week (``ahead_days`` after the as-of date) in earlier ISO years, and the number of those years."""
    first = F.lit(first_week)
    target = week_start(F.date_add("as_of", ahead_days))
    now = week_start(F.col("as_of"))
    week = lambda i: F.date_add(first, i * 7)
    away = lambda i: F.abs(F.weekofyear(week(i)) - F.col("iso"))
    year = lambda d: F.extract(F.lit("YEAROFWEEK"), d)
    dated = grid.select("as_of", F.weekofyear(target).alias("iso"), year(target).alias("y"), (F.datediff(now, first) / 7).cast("int").alias("n")).where("n >= 0")
    at = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: (F.least(away(i), 53 - away(i)) <= reach) & (year(week(i)) < F.col("y")))
    return dated.select("as_of", at.alias("at")).select("as_of", "at", F.size(F.array_distinct(F.transform("at", lambda i: year(week(i))))).alias("years"))


def season_mean(s: Column, at: Column) -> Column:
    """Mean of the series over the given positions; null if there are none."""
    inside = F.filter(at, lambda i: i < F.size(s))
    return F.when(F.size(inside) > 0, F.aggregate(inside, F.lit(0.0), lambda a, i: a + F.element_at(s, i + 1)) / F.size(inside))
