"""Classes of hours, days, seasons, years, durations and probabilities, as column expressions.

Nulls follow the log's rules: an unknown hour is Night and Nighttime, an unknown month Autumn, an
unknown weekday Weekday, an unknown probability High; an unknown year has no class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.config import DEFAULT, Config


#: The classes of each function below, by its name.
VALUES = {
    "time_of_day": ("Morning", "Afternoon", "Night"),
    "daytime": ("Daytime", "Nighttime"),
    "season": ("Winter", "Spring", "Summer", "Autumn"),
    "part_of_week": ("Weekday", "Weekend"),
    "old_film": ("True", "False"),
    "click_length": ("Short", "Medium", "Long"),
    "follow_through_class": ("Low", "Medium", "High"),
}


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour.between(4, 11), "Morning").when(hour.between(12, 19), "Afternoon").otherwise("Night")


def daytime(ts: Column) -> Column:
    return F.when(F.hour(ts).between(6, 17), "Daytime").otherwise("Nighttime")


def is_peak_hour(ts: Column) -> Column:
    return F.when(F.hour(ts).between(18, 23), 1).otherwise(0)


def season(ts: Column) -> Column:
    month = F.month(ts)
    return F.when(month.isin(12, 1, 2), "Winter").when(month.between(3, 5), "Spring").when(month.between(6, 8), "Summer").otherwise("Autumn")


def part_of_week(ts: Column) -> Column:
    """Friday to Sunday are the weekend."""
    return F.when(F.weekday(ts) >= 4, "Weekend").otherwise("Weekday")


def old_film(ts: Column, config: Config = DEFAULT) -> Column:
    year = F.year(ts)
    return F.when(year <= config.old_year, "True").when(year > config.old_year, "False")


def click_length(duration: Column, config: Config = DEFAULT) -> Column:
    return F.when(duration <= config.short_click, "Short").when(duration <= config.medium_click, "Medium").otherwise("Long")


def follow_through_class(p: Column, config: Config = DEFAULT) -> Column:
    return F.when(p < config.medium_from, "Low").when(p <= config.medium_to, "Medium").otherwise("High")
