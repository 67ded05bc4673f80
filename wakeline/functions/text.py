"""Text columns: width folding, clean-up, scalar parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.schema import BET_LABELS, DECISIONS, UNORDERED_BETS, VENUE_AFFIXES

# --- fixed values ---------------------------------------------------------
WIDE_DIGITS = "０１２３４５６７８９"
WIDE_UPPER = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
WIDE_LOWER = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW_DIGITS = "0123456789"
NARROW_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NARROW_LOWER = "abcdefghijklmnopqrstuvwxyz"
PADDING = " 　\t\r\n\u0000"
RACE_TIME = r"^(\d+)\.(\d{1,2})\.(\d)$"
CARD_HEADER = (
    r"^\s*(\d{1,2})R\s+(.*?)H(\d{3,4})m\s*(?:電話投票締切予定\s*(\d{1,2}):(\d{2}))?"
)
SERIES_DAY = r"第\s*(\d+)\s*日"
RESULT_HEADER = (
    r"^\s*(\d{1,2})R\s+(.*?)\s+H(\d{3,4})m(?:\s+(\S+))?"
    r"(?:\s+風\s+(?:([^\s\d]+)\s+)?(-?\d+)m)?(?:\s+波\s+(-?\d+)cm)?"
)
PAYOUT_ENTRY = r"(\d(?:-\d){0,2})\s+(\d+)(?:\s+人気\s+(\d+))?"
# --- end of fixed values --------------------------------------------------

#: Replacement character the decoder leaves for bytes that are not valid.
_UNDECODABLE = "\ufffd"


def decode_cp932(raw: Column) -> Column:
    """Decode, NULL where the bytes are not valid.

    Stays in the JVM; the session settings of :func:`wakeline.session.tune` allow the
    character set and keep one bad field from failing the query.
    """
    text = F.decode(raw, "windows-31j")
    return F.when(~text.contains(_UNDECODABLE), text)


def normalise_width(text: Column) -> Column:
    """Full-width digits, letters, colon, minus, point and space to ASCII."""
    wide = WIDE_DIGITS + WIDE_UPPER + WIDE_LOWER + "：－．　"
    return F.translate(text, wide, NARROW_DIGITS + NARROW_UPPER + NARROW_LOWER + ":-. ")


def normalise_digits(text: Column) -> Column:
    """Full-width digits, colon, minus and space to ASCII; letters stay as they are."""
    return F.translate(text, WIDE_DIGITS + "：－　", NARROW_DIGITS + ":- ")


def normalise_number(text: Column) -> Column:
    """Full-width digits and signs to ASCII, thousands separators removed."""
    return F.replace(
        F.translate(text, WIDE_DIGITS + "＋－．", NARROW_DIGITS + "+-."), F.lit(","), F.lit("")
    )


def strip_padding(text: Column) -> Column:
    """Trim ASCII and full-width blanks and NUL from both ends."""
    return F.btrim(text, F.lit(PADDING))


def squash_name(text: Column) -> Column:
    """Remove every ASCII and full-width space."""
    return F.translate(text, " 　", "")


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def group(text: Column, pattern: str, index: int) -> Column:
    """Regex group, NULL when the pattern or the optional group does not match."""
    return null_if_empty(F.regexp_extract(text, pattern, index))


def int_or_null(text: Column) -> Column:
    """Digits only; anything else is NULL."""
    flat = F.trim(normalise_digits(text))
    return F.when(flat.rlike("^[0-9]+$"), flat.try_cast("int"))


def float_or_null(text: Column) -> Column:
    return F.trim(normalise_digits(text)).try_cast("double")


def race_time_seconds(text: Column) -> Column:
    """``1.48.7`` is one minute 48.7 seconds."""
    flat = F.trim(normalise_digits(text))
    minutes, seconds, tenths = (group(flat, RACE_TIME, i).try_cast("int") for i in (1, 2, 3))
    return (minutes * 60 + seconds) + tenths / 10


def start_timing(text: Column) -> Column:
    """Struct (timing, flag): ``F.01`` crossed 0.01 s early, ``L`` started late."""
    flat = F.trim(normalise_digits(text))
    early = F.concat(F.lit("0."), F.regexp_replace(F.substr(flat, F.lit(2)), r"^\.+", ""))
    early_value = F.when(early != "0.", -early.try_cast("double"))
    late = flat.startswith("L")
    flying = flat.startswith("F")
    return F.struct(
        F.when(flying, early_value).when(late, None).otherwise(flat.try_cast("double"))
        .alias("timing"),
        F.when(flying, "F").when(late, "L").alias("flag"),
    )


def finish_code(text: Column) -> Column:
    """Struct (position, status): ``01``-``06`` is a position, the rest a status."""
    flat = F.trim(text)
    place = F.when(flat.rlike("^[0-9]+$"), flat.try_cast("int"))
    valid = place.between(1, 6)
    return F.struct(
        F.when(valid, place).alias("position"),
        F.when(F.coalesce(valid, F.lit(False)), None).otherwise(null_if_empty(flat)).alias("status"),
    )


def winning_move(tail: Column) -> Column:
    """Longest known move the text starts with, else the text itself."""
    flat = F.trim(F.translate(tail, "　", ""))
    found = F.lit(None).cast("string")
    for name in sorted(DECISIONS, key=len):
        found = F.when(flat.startswith(name), name).otherwise(found)
    return F.coalesce(found, null_if_empty(flat))


def canonical_combination(bet_type: Column, raw: Column) -> Column:
    """Ordered bets keep their order, unordered ones are sorted."""
    parts = F.split(raw, "-")
    ordered = F.when(bet_type.isin(*UNORDERED_BETS), F.array_sort(parts)).otherwise(parts)
    return F.array_join(ordered, "-")


def bet_type_of(line: Column) -> Column:
    """Bet type from the label a dividend line starts with."""
    found = F.lit(None).cast("string")
    for label, name in BET_LABELS.items():
        found = F.when(line.startswith(label), name).otherwise(found)
    return found


def strip_bet_label(line: Column) -> Column:
    return F.regexp_replace(line, "^(?:" + "|".join(BET_LABELS) + ")", "")


def payout_entries(line: Column) -> Column:
    """All ``combination yen [popularity]`` matches as an array of structs.

    The line is searched once; the short matches are split at their blanks.
    """
    whole = F.regexp_extract_all(line, F.lit(PAYOUT_ENTRY), F.lit(0))
    parts = F.transform(whole, lambda e: F.split(F.regexp_replace(e, "人気", " "), r"\s+"))
    return F.transform(parts, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("combo"),
        F.get(p, F.lit(1)).try_cast("int").alias("yen"),
        F.get(p, F.lit(2)).try_cast("int").alias("popularity"),
    ))


def venue_name(text: Column) -> Column:
    """A venue name without the usual prefix and suffixes."""
    flat = F.trim(text)
    for affix in VENUE_AFFIXES:
        flat = F.replace(flat, F.lit(affix), F.lit(""))
    return F.trim(flat)


def race_key_text(day: Column, venue: Column, number: Column) -> Column:
    """``date/venue/number`` with a two-digit venue."""
    return F.concat_ws(
        "/", F.date_format(day, "yyyy-MM-dd"), F.lpad(venue.cast("string"), 2, "0"),
        number.cast("string"),
    )


def period_key(year: Column, half: Column) -> Column:
    """Stem of a half-year file: first half ``{year-1}10``, second half ``{year}04``."""
    yy = F.when(half == 1, (year - 1) % 100).when(half == 2, year % 100).otherwise(
        F.raise_error(F.concat(F.lit("half must be 1 or 2, got "), half.cast("string")))
    )
    month = F.when(half == 1, "10").otherwise("04")
    return F.concat(F.lit("fan"), F.lpad(yy.cast("string"), 2, "0"), month)


def date_spine(first: Column, last: Column) -> Column:
    """All days from first to last as an array; a reversed range is an error."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    message = F.concat(F.lit("end "), last.cast("string"), F.lit(" is before start "),
                       first.cast("string"))
    return F.when(last < first, F.raise_error(message)).otherwise(days)
