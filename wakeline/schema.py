"""Keys, declared types, feature sets and fixed values."""

from __future__ import annotations

RACE_KEYS = ["race_date", "stadium_id", "race_no"]
MEMBER_KEYS = [*RACE_KEYS, "lane"]
TICKET_KEYS = [*RACE_KEYS, "combination"]
ORDER_KEYS = ["race_ts", "stadium_id", "race_no", "lane"]

# --- fixed values ---------------------------------------------------------
GRADES = ("A1", "A2", "B1", "B2")
WIND_DIRECTIONS = (
    "北", "北東", "東", "南東", "南", "南西", "西", "北西",
    "北北東", "東北東", "東南東", "南南東", "南南西", "西南西", "西北西", "北北西",
)
HEAD_WINDS = ("北", "北北東", "北北西")
WEATHERS = ("晴", "曇", "曇り", "雨", "雪", "霧")
PAGE_WEATHER_WORDS = ("晴", "曇り", "曇", "雨", "雪", "霧")
DECISIONS = ("逃げ", "差し", "まくり差し", "まくり", "抜き", "恵まれ")
BET_LABELS = {
    "単勝": "win",
    "複勝": "place",
    "２連単": "exacta",
    "２連複": "quinella",
    "拡連複": "wide",
    "３連単": "trifecta",
    "３連複": "trio",
}
UNORDERED_BETS = ("trio", "quinella", "wide", "place", "win")
VENUES = {
    1: "桐生", 2: "戸田", 3: "江戸川", 4: "平和島", 5: "多摩川", 6: "浜名湖",
    7: "蒲郡", 8: "常滑", 9: "津", 10: "三国", 11: "びわこ", 12: "住之江",
    13: "尼崎", 14: "鳴門", 15: "丸亀", 16: "児島", 17: "宮島", 18: "徳山",
    19: "下関", 20: "若松", 21: "芦屋", 22: "福岡", 23: "唐津", 24: "大村",
}
VENUE_AFFIXES = ("ボートレース", "競艇場", "競艇")
UNAVAILABLE_MARKERS = ("指定されたレース", "該当するデータ")

MEMBERS_PER_GROUP = 6
TICKET_YEN = 100.0
PAYBACK_RATE = 0.75
DEFAULT_THRESHOLDS = (1.00, 1.10, 1.20, 1.30)
STAKINGS = ("flat", "quarter_kelly")
BANKROLL = 1_000_000.0
MIN_PRIOR_OBSERVATIONS = 30
KELLY_CAP = 0.02
KELLY_DIVISOR = 4.0
MOTOR_SHRINKAGE = 50.0
RACER_SHRINKAGE = 30.0
COURSE_SHRINKAGE = 20.0
TRAIN_YEARS = (2015, 2023)
VALID_YEARS = (2024, 2024)
TEST_YEARS = (2025, 2026)
SHUFFLE_SEED = 20240101
# --- end of fixed values --------------------------------------------------

# Declared row types, as DDL text for readers and casts.
RACES = (
    """race_date DATE, stadium_id SMALLINT, race_no SMALLINT, title STRING, distance_m SMALLINT,
    deadline_time STRING, series_day SMALLINT, fixed_course BOOLEAN, weather STRING,
    wind_direction STRING, wind_speed_m SMALLINT, wave_height_cm SMALLINT, decision STRING,
    has_b BOOLEAN, has_k BOOLEAN"""
)
ENTRIES = (
    """race_date DATE, stadium_id SMALLINT, race_no SMALLINT, lane TINYINT, course TINYINT,
    racer_id INT, racer_name STRING, grade STRING, branch STRING, age SMALLINT, weight_kg DOUBLE,
    national_win_rate DOUBLE, national_top2_rate DOUBLE, local_win_rate DOUBLE,
    local_top2_rate DOUBLE, motor_no SMALLINT, motor_top2_rate DOUBLE, boat_no SMALLINT,
    boat_top2_rate DOUBLE, exhibition_time DOUBLE, finish_position TINYINT,
    finish_status STRING, start_timing DOUBLE, race_time_sec DOUBLE"""
)
PAYOUTS = (
    """race_date DATE, stadium_id SMALLINT, race_no SMALLINT, bet_type STRING,
    combination STRING, payout_yen INT, popularity SMALLINT"""
)
ODDS = (
    "race_date DATE, stadium_id SMALLINT, race_no SMALLINT, combination STRING, odds DOUBLE"
)
PRICE_LOG = (
    """k STRING, d DATE, j INT, r INT, o MAP<STRING, DOUBLE>, unavailable STRING, error STRING,
    _corrupt_record STRING"""
)
PARSE_OUTCOMES = (
    """source STRING, day DATE, records_ok BIGINT, records_failed BIGINT, fatal STRING,
    samples ARRAY<STRING>"""
)

# --- feature sets: what is knowable when ----------------------------------
_CARD = [
    "lane", "race_no", "grade_code", "age", "weight_kg", "national_win_rate",
    "national_top2_rate", "local_win_rate", "local_top2_rate", "motor_top2_rate",
    "boat_top2_rate",
]
_SCHEDULE = ["series_day", "distance_m", "fixed_course_flag"]
_HISTORY = [
    "racer_win_rate", "racer_win_n", "racer_top2_rate", "racer_st_rate", "motor_hist_n",
    "motor_hist_rate", "racer_lane_win_rate", "stadium_lane_win_rate",
    "racer_course_gain_rate", "racer_goes_inside_rate", "racer_stadium_top2_rate",
]
_CONDITIONS = [
    "wind_speed_m", "wave_height_cm", "wind_dir_code", "weather_code", "wind_x_lane",
    "head_wind_speed", "head_wind_x_lane1", "wave_x_lane",
]
_VENUE = ["stadium_id", "stadium_lane"]
_REALISED = [
    "course", "stadium_course", "wind_x_course", "racer_course_win_rate",
    "stadium_course_win_rate",
]

FEATURE_SETS = {
    "morning": [*_CARD, *_SCHEDULE, *_HISTORY, *_VENUE],
    "prerace": [*_CARD, "exhibition_time", *_SCHEDULE, *_HISTORY, *_CONDITIONS, *_VENUE],
    "realised": [
        *_CARD, "exhibition_time", *_SCHEDULE, *_HISTORY, *_CONDITIONS, *_VENUE, *_REALISED,
    ],
}
#: Sets a model may use when it has to run before the deadline.
DEPLOYABLE_SETS = ("morning",)


def feature_columns(feature_set: str = "morning") -> list[str]:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; choose from {sorted(FEATURE_SETS)}")
    return list(FEATURE_SETS[feature_set])
