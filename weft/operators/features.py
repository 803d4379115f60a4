"""Fifteen features of each user, from the cleaned log.

The log is read once: ``summary`` sums it by user and genre string, with a column for each class of the
six class features, so nothing is exploded and no more rows than clicks come out. Sums and ratios
(``totals``), the class with the largest weight (``dominant_classes``) and genres (``genre_features``)
come from the summary; ``user_features`` writes it first, so that the three read that and not the log.
Durations are summed as decimals, so sums don't depend on the order of rows, and equal totals tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.config import DEFAULT, Config
from weft.functions import classify
from weft.storage import materialise

TOTALS = ("avg_click_duration", "avg_time_per_day", "ft_probability", "mean_duration_peak_hour", "total_time_spent", "consistency_ratio", "avg_click_per_movie")
CLASSES = ("most_active_time_day", "is_old_movie_lover", "most_active_time_week", "most_active_season", "most_common_click_length", "most_active_daytime")
#: The order of the feature table.
FEATURES = (
    "favourite_genre", "avg_click_duration", "most_active_time_day", "is_old_movie_lover", "avg_time_per_day", "most_active_time_week", "most_active_season",
    "genre_diversity", "ft_probability", "most_common_click_length", "mean_duration_peak_hour", "most_active_daytime", "total_time_spent", "consistency_ratio",
    "avg_click_per_movie",
)
NO_GENRE = "NaN"
#: Durations count exactly, to the billionth of a second; those of at least ``HUGE`` seconds, infinite ones too, are summed as doubles beside them.
EXACT, HUGE = "decimal(28,9)", 1e18


def _parts(value: Column) -> tuple[Column, Column]:
    """The value as a decimal, or where it is too large for one as a double; the other is null."""
    fits = F.abs(value) < HUGE
    return F.when(fits, value.cast(EXACT)), F.when(~fits, value.cast("double"))


def _total(exact: Column | str, huge: Column | str) -> Column:
    return F.struct(F.sum(exact).alias("exact"), F.sum(huge).alias("huge"))


def _total_again(name: str) -> Column:
    """The total of totals."""
    return _total(f"{name}.exact", f"{name}.huge").alias(name)


def _seconds(name: str) -> Column:
    """The double nearest to a total; null where nothing was summed."""
    exact, huge = F.col(name)["exact"].cast("double"), F.col(name)["huge"]
    return F.when(huge.isNull(), exact).otherwise(huge + F.coalesce(exact, F.lit(0.0)))


def class_weights(config: Config = DEFAULT) -> list[tuple[str, str, Column, tuple[Column, Column]]]:
    """(feature, class function, class, weight in parts) of the six class features: durations, but one click each for click lengths."""
    ts, duration = F.col("datetime"), F.col("duration")
    time, click = _parts(duration), _parts(F.lit(1.0))
    return [
        ("most_active_time_day", "time_of_day", classify.time_of_day(ts), time),
        ("is_old_movie_lover", "old_film", classify.old_film(F.col("release_date"), config), time),
        ("most_active_time_week", "part_of_week", classify.part_of_week(ts), time),
        ("most_active_season", "season", classify.season(ts), time),
        ("most_common_click_length", "click_length", classify.click_length(duration, config), click),
        ("most_active_daytime", "daytime", classify.daytime(ts), time),
    ]


def _weight_name(feature: str, value: str) -> str:
    return f"{feature}_{value}"


def summary(clicks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sums of the log by user and genre string, null users too, with the distinct days and movies of each."""
    duration, peak = F.col("duration"), classify.is_peak_hour(F.col("datetime")) == 1
    total = lambda condition, parts=_parts(duration): _total(*[F.when(condition, p) for p in parts])
    weights = [total(c == v, w).alias(_weight_name(f, v)) for f, kind, c, w in class_weights(config) for v in classify.VALUES[kind]]
    return clicks.groupBy("user_id", "genres").agg(
        total(F.lit(True)).alias("time"),
        F.count(duration).alias("clicks"),
        total(F.col("datetime").isNotNull()).alias("dated_time"),
        F.count_if(duration >= config.follow_through).alias("followed"),
        F.count("title").alias("titled"),
        total(peak).alias("peak_time"),
        F.count(F.when(peak, duration)).alias("peak_clicks"),
        F.count("movie_id").alias("movie_clicks"),
        F.collect_set(F.to_date("datetime")).alias("days"),  # no more than there are days, and movies
        F.collect_set("movie_id").alias("movies"),
        *weights,
    )


def totals(sums: DataFrame) -> DataFrame:
    """The seven sums and ratios of each user, from the summary."""
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    times, counts = ("time", "dated_time", "peak_time"), ("clicks", "followed", "titled", "peak_clicks", "movie_clicks")
    added = [*map(_total_again, times), *[F.sum(c).alias(c) for c in counts]]
    per_user = sums.where("user_id IS NOT NULL").groupBy("user_id").agg(*added, distinct("days").alias("days"), distinct("movies").alias("movies"))
    per_user = per_user.withColumns({c: _seconds(c) for c in times})
    every = sums.select(F.explode("days").alias("day")).agg(F.countDistinct("day").alias("all_days"))  # one row
    ratios = {
        "avg_click_duration": F.try_divide("time", "clicks"), "avg_time_per_day": F.try_divide("dated_time", "days"), "ft_probability": F.try_divide("followed", "titled"),
        "mean_duration_peak_hour": F.try_divide("peak_time", "peak_clicks"), "total_time_spent": F.col("time"), "consistency_ratio": F.try_divide("days", "all_days"),
        "avg_click_per_movie": F.try_divide("movie_clicks", "movies"),
    }
    return per_user.crossJoin(F.broadcast(every)).select("user_id", *[ratios[c].alias(c) for c in TOTALS])


def dominant_classes(sums: DataFrame, only: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """For each user the class with the largest total weight, the alphabetically first on ties, a column a feature; from the summary."""
    chosen = [(f, classify.VALUES[kind]) for f, kind, _, _ in class_weights(config) if only in (None, f)]
    weights = [_total_again(_weight_name(f, v)) for f, values in chosen for v in values]
    weight = lambda f, v: _seconds(_weight_name(f, v))
    best = lambda f, values: F.array_min(
        F.filter(F.array(*[F.when(weight(f, v).isNotNull(), F.struct((-weight(f, v)).alias("weight"), F.lit(v).alias("class"))) for v in values]), lambda x: x.isNotNull())
    )["class"]
    return sums.where("user_id IS NOT NULL").groupBy("user_id").agg(*weights).select("user_id", *[best(f, values).alias(f) for f, values in chosen])


def genre_features(sums: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """favourite_genre (the genre with the largest total time, where no genre competes as one) and genre_diversity; from the summary."""
    genre = F.explode(F.split(F.coalesce("genres", F.lit(NO_GENRE)), config.genre_separator))
    times = sums.where("user_id IS NOT NULL").select("user_id", "time", genre.alias("genre")).groupBy("user_id", "genre").agg(_total_again("time"))
    known = F.when(F.col("genre") != NO_GENRE, F.col("genre"))
    every = sums.where("genres IS NOT NULL").select(F.explode(F.split("genres", config.genre_separator)).alias("genre")).agg(F.countDistinct("genre").alias("all_genres"))
    per_user = times.groupBy("user_id").agg(F.min(F.struct((-_seconds("time")).alias("time"), F.col("genre")))["genre"].alias("favourite"), F.count(known).alias("own_genres"))
    return per_user.crossJoin(F.broadcast(every)).select(
        "user_id",
        F.nullif(F.col("favourite"), F.lit(NO_GENRE)).alias("favourite_genre"),
        F.try_divide(F.nullif(F.col("own_genres"), F.lit(0)), F.col("all_genres")).alias("genre_diversity"),
    )


def user_features(clicks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The feature table: every user of the log, left-joined with the other families on the user; reads the log once."""
    sums = materialise(summary(clicks, config), "summary")
    return (
        genre_features(sums, config)
        .join(totals(sums), "user_id", "left")
        .join(dominant_classes(sums, config=config), "user_id", "left")
        .select("user_id", *FEATURES)
    )


def impute(features: DataFrame) -> DataFrame:
    """Nulls of two numeric features become the column's mean, of two class features its mode (the smallest on ties)."""
    means, modes = ("mean_duration_peak_hour", "genre_diversity"), ("is_old_movie_lover", "favourite_genre")
    facts = features.agg(*[F.avg(c).alias(f"_{c}") for c in means], *[F.mode(c, True).alias(f"_{c}") for c in modes])  # one row
    filled = {c: F.coalesce(c, f"_{c}") for c in means + modes}
    return features.crossJoin(F.broadcast(facts)).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in features.columns])


def cluster_profile(rows: DataFrame, column: str, cluster: str = "cluster", config: Config = DEFAULT) -> DataFrame:
    """Percentages of a class column by cluster, over rows with a favourite genre; cells without rows are null."""
    values = {
        "most_active_time_day": ["Afternoon", "Morning", "Night"],
        "most_common_click_length": ["Long", "Medium", "Short"],
        "ft_probability": ["High", "Low", "Medium"],
    }
    for name in (cluster, column):
        if name not in rows.columns:
            raise ValueError(f"no column {name}")
    if column not in values:
        raise ValueError(f"{column} has no profile; choose one of {sorted(values)}")
    kind = classify.follow_through_class(F.col(column), config) if column == "ft_probability" else F.col(column)
    seen = rows.select(F.col(cluster).alias("cluster"), kind.alias("kind"), "favourite_genre")
    counts = seen.groupBy("cluster").pivot("kind", values[column]).agg(F.count("favourite_genre"))
    total = sum((F.coalesce(v, F.lit(0)) for v in values[column]), F.lit(0))
    return counts.select("cluster", *[F.try_divide(F.col(v) * 100.0, total).alias(v.lower()) for v in values[column]])


def top_titles(clicks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, title, genres, clicks): each user's most clicked titles."""
    order = Window.partitionBy("user_id").orderBy(F.desc("clicks"), "title", "genres")
    return user_title_clicks(clicks).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= config.titles_per_user).drop("_n")


def user_title_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.dropna(subset=["user_id", "title", "genres"]).groupBy("user_id", "title", "genres").agg(F.count("*").alias("clicks"))
