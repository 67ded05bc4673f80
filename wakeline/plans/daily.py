"""Daily run: a card without outcomes is scored on top of the history before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.encode import with_encodings
from wakeline.functions.text import venue_name
from wakeline.operators import boosting
from wakeline.operators.groups import group_softmax
from wakeline.operators.history_state import HistoryState
from wakeline.operators.merge import aligned_union
from wakeline.operators.models import TrainedModel, require_deployable
from wakeline.operators.pricing import attach_expected_payout, price_table
from wakeline.operators.triples import race_tickets
from wakeline.plans.features import build, prepare
from wakeline.schema import VENUES


def features_for_day(history: DataFrame, card: DataFrame, day, *, mode: str = "strict") -> DataFrame:
    """Features of the card's rows, with the history of every earlier row."""
    combined = aligned_union(history.filter(F.col("race_date") < F.lit(day)), card)
    return build(combined, mode=mode).filter(F.col("race_date") == F.lit(day))


def select_groups(df: DataFrame, *, stadium: int | None = None, race_no: int | None = None):
    """Narrow scored rows to a venue or number; call it after history, never before."""
    if stadium is not None:
        df = df.filter(F.col("stadium_id") == stadium)
    if race_no is not None:
        df = df.filter(F.col("race_no") == race_no)
    return df


def resolve_names(asked: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Add ``stadium_id`` for a code or a (decorated) name; NULL when unknown.

    ``known`` is the venue table (stadium_id, name), a couple of dozen rows.
    """
    text = F.trim(F.col(column))
    numeric = text.rlike("^[0-9]+$")
    key = F.when(numeric, F.concat(F.lit("#"), text.try_cast("int").cast("string"))).otherwise(
        venue_name(text)
    )
    names = known.select(
        "stadium_id",
        F.explode(F.array("name", F.concat(F.lit("#"), F.col("stadium_id").cast("string"))))
        .alias("_key"),
    )
    return asked.withColumn("_key", key).join(names, "_key", "left").drop("_key")


def resolve_venue(spark, value: str) -> int:
    """One venue argument to its id; an unknown one is an error."""
    known = spark.createDataFrame(list(VENUES.items()), "stadium_id INT, name STRING")
    asked = spark.createDataFrame([(value,)], "asked STRING")
    found = resolve_names(asked, "asked", known).first()["stadium_id"]
    if found is None:
        raise ValueError(f"unknown venue {value!r}; known: {'/'.join(VENUES.values())}")
    return found


#: Columns no card can state; they are typed NULLs on the day.
UNKNOWN_ON_THE_DAY = [
    "course", "finish_position", "finish_status", "start_timing", "exhibition_time", "weather",
    "wind_direction", "wind_speed_m", "wave_height_cm", "decision",
]
#: Their types where a card lacks them.
UNKNOWN_TYPES = {
    "course": "int", "finish_position": "int", "finish_status": "string", "start_timing": "double",
    "exhibition_time": "double", "weather": "string", "wind_direction": "string", "wind_speed_m": "int",
    "wave_height_cm": "int", "decision": "string",
}


def score_day(model: TrainedModel, history: DataFrame, card: DataFrame, day) -> DataFrame:
    """Probabilities for the card's rows; every row of the card is kept."""
    require_deployable(model)
    hidden = card.drop(*[c for c in UNKNOWN_ON_THE_DAY if c in card.columns])
    return model.predict(features_for_day(history, hidden, day))


def card_features(state: HistoryState, card: DataFrame, day) -> DataFrame:
    """The same features as :func:`features_for_day`, from kept sums instead of history."""
    types = {**UNKNOWN_TYPES, **dict(card.dtypes)}
    hidden = card.withColumns({c: F.lit(None).cast(types[c]) for c in UNKNOWN_ON_THE_DAY})
    return with_encodings(state.rates_for(prepare(hidden), day)).drop("race_block")


def score_card(nodes: DataFrame, state: HistoryState, card: DataFrame, day) -> DataFrame:
    """Features, ``score`` and ``p_win`` of the card's rows by an ensemble kept as nodes."""
    built = card_features(state, card, day)
    return group_softmax(built.withColumn("score", boosting.margin(nodes)))


def price_day(scored: DataFrame, dividends: DataFrame, day) -> DataFrame:
    """Tickets of the day priced with dividends of strictly earlier dates."""
    prices = price_table(dividends.filter(F.col("race_date") < F.lit(day)))
    return attach_expected_payout(race_tickets(scored), prices)
