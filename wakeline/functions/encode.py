"""Labels, category codes and interaction terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.schema import GRADES, HEAD_WINDS, WEATHERS, WIND_DIRECTIONS


def code_of(column: Column | str, values: tuple[str, ...]) -> Column:
    """Position of a category in a fixed list; NULL when it is not listed."""
    lookup = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return lookup[F.col(column) if isinstance(column, str) else column]


def with_labels(df: DataFrame) -> DataFrame:
    """won / top2 / top3 (a missing finish is 0), course gain, goes-inside flag."""

    def finished(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("long")

    place = F.col("finish_position")
    lane, course = F.col("lane").cast("int"), F.col("course").cast("int")
    return df.withColumns(
        {
            "won": finished(place == 1),
            "top2": finished(place <= 2),
            "top3": finished(place <= 3),
            "course_gain": (lane - course).cast("long"),
            "goes_inside": (course < lane).cast("long"),
        }
    )


def with_encodings(df: DataFrame) -> DataFrame:
    lane, course = F.col("lane").cast("int"), F.col("course").cast("int")
    venue = F.col("stadium_id").cast("int")
    wind = F.coalesce(F.col("wind_speed_m").cast("double"), F.lit(0.0))
    wave = F.coalesce(F.col("wave_height_cm").cast("double"), F.lit(0.0))
    head = F.col("wind_direction").isin(*HEAD_WINDS).cast("long")
    return df.withColumns(
        {
            "grade_code": code_of("grade", GRADES),
            "wind_dir_code": code_of("wind_direction", WIND_DIRECTIONS),
            "weather_code": code_of("weather", WEATHERS),
            "wind_x_lane": wind * lane,
            "wind_x_course": wind * course,
            "head_wind_speed": head * wind,
            "head_wind_x_lane1": head * wind * (lane == 1).cast("long"),
            "wave_x_lane": wave * lane,
            "stadium_lane": venue * 10 + lane,
            "stadium_course": venue * 10 + F.coalesce(course, F.lit(0)),
            "fixed_course_flag": F.col("fixed_course").cast("long"),
        }
    )
