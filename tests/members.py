"""Synthetic members for the tests."""

from datetime import date, timedelta

DEFAULTS = {
    "race_date": date(2020, 1, 1), "stadium_id": 1, "race_no": 1, "lane": 1, "course": 1,
    "racer_id": 1000, "grade": "A1", "age": 30, "weight_kg": 52.0, "national_win_rate": 5.0,
    "national_top2_rate": 30.0, "local_win_rate": 5.0, "local_top2_rate": 30.0, "motor_no": 10,
    "motor_top2_rate": 35.0, "boat_no": 20, "boat_top2_rate": 35.0, "exhibition_time": 6.8,
    "finish_position": 1, "finish_status": None, "start_timing": 0.15, "deadline_time": "12:00:00",
    "fixed_course": False, "weather": "晴", "wind_direction": "北", "wind_speed_m": 2,
    "wave_height_cm": 1, "decision": "逃げ", "series_day": 1, "distance_m": 1800,
}
DDL = (
    "race_date DATE, stadium_id INT, race_no INT, lane INT, course INT, racer_id INT, grade STRING, "
    "age INT, weight_kg DOUBLE, national_win_rate DOUBLE, national_top2_rate DOUBLE, "
    "local_win_rate DOUBLE, local_top2_rate DOUBLE, motor_no INT, motor_top2_rate DOUBLE, "
    "boat_no INT, boat_top2_rate DOUBLE, exhibition_time DOUBLE, finish_position INT, "
    "finish_status STRING, start_timing DOUBLE, deadline_time STRING, fixed_course BOOLEAN, "
    "weather STRING, wind_direction STRING, wind_speed_m INT, wave_height_cm INT, decision STRING, "
    "series_day INT, distance_m INT"
)


def frame(spark, rows):
    return spark.createDataFrame([tuple({**DEFAULTS, **r}.values()) for r in rows], DDL)


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def six_boats(days):
    """Six racers a day, lane N finishing Nth."""
    return [
        {"race_date": day(d), "lane": n, "course": n, "racer_id": 1000 + n, "motor_no": n,
         "finish_position": n}
        for d in range(days) for n in range(1, 7)
    ]
