"""Calendar helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def season_of(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "fall"))


def calendar_parts(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"year": F.year(day).cast("long"), "month": F.month(day).cast("long"),
                           "season": season_of(F.month(day))})


def next_saturday(day: Column) -> Column:
    """The Saturday strictly after the day."""
    return F.next_day(day, "SAT")


def us_dst(day: Column) -> Column:
    """Second Sunday of March up to, not including, the first Sunday of November."""
    year = F.year(day)
    starts = F.next_day(F.make_date(year, F.lit(3), F.lit(7)), "SUN")
    ends = F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "SUN")
    return (day >= starts) & (day < ends)
