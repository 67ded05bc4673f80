"""Fixed-width records sliced by byte, and the lines they come in.

A record type is an ordinary Spark schema whose fields say in their metadata which bytes they
take. Widths count bytes: a full-width character takes two, so a record is cut first and decoded
per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from wakeline.functions.text import decode_cp932, normalise_number, strip_padding
from wakeline.session import require_feed_charset

#: Column types a record may have; ``binary`` is left undecoded.
TYPES = {t.simpleString(): t for t in (StringType(), LongType(), DoubleType(), BinaryType())}


def record(*columns: tuple) -> StructType:
    """Schema of a record from tuples (name, first byte, bytes[, type[, {scale, required}]])."""
    fields = []
    for name, at, width, *more in columns:
        kind, options = [*more, *("string", {})[len(more):]]
        if kind not in TYPES:
            raise ValueError(f"{name}: type {kind} is none of {', '.join(TYPES)}")
        fields.append(StructField(name, TYPES[kind], not options.get("required", False),
                                  {"at": at, "width": width, "scale": float(options.get("scale", 1.0))}))
    schema = StructType(fields)
    byte_map(schema)
    return schema


def byte_map(schema: StructType) -> list[str | None]:
    """The field that owns each byte of a record, None where no field does."""
    owners: list[str | None] = []
    for field in schema:
        at, width = field.metadata["at"], field.metadata["width"]
        if at < 0 or width < 1 or not field.metadata["scale"]:
            raise ValueError(f"{field.name}: bytes {at}+{width}, scale {field.metadata['scale']}")
        owners += [None] * (at + width - len(owners))
        taken = {o for o in owners[at:at + width] if o}
        if taken:
            raise ValueError(f"{field.name} shares bytes with {', '.join(sorted(taken))}")
        owners[at:at + width] = [field.name] * width
    if not owners or len(set(schema.names)) < len(schema):
        raise ValueError("a record needs fields, each with a name of its own")
    return owners


def byte_slice(line: Column, start: int, length: int) -> Column:
    """Bytes of a line; a short line is padded with blanks."""
    padded = F.rpad(line, start + length, F.lit(b" "))
    return F.substring(padded, start + 1, length)


def split_lines(df: DataFrame, content: str, *, keep: Sequence[str]) -> DataFrame:
    """Non-blank lines of a binary column as (keep.., line_no, line).

    CRLF, lone CR and lone LF all end a line; leading blanks stay. The detour over
    ISO-8859-1 is exact for every byte.
    """
    text = F.decode(F.col(content), "ISO-8859-1")
    lines = df.select(*keep, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "latin"))
    return lines.filter(F.btrim("latin", F.lit(" \t\r\n\x0b\x0c")) != "").withColumn(
        "line", F.encode("latin", "ISO-8859-1")
    )


def _convert(field: StructField, line: Column) -> tuple[Column, Column]:
    """Value of one field, and a code for what is wrong with it (NULL when fine)."""
    chunk = F.substring(line, field.metadata["at"] + 1, field.metadata["width"])
    kind, nothing = field.dataType.simpleString(), F.lit(None).cast("string")
    if kind == "binary":
        return chunk, nothing
    decoded = decode_cp932(chunk)
    text = strip_padding(decoded)
    broken = F.when(decoded.isNull(), "bytes")
    if kind == "string":
        return text, broken
    number = normalise_number(text)
    value = number.try_cast(kind)
    if kind == "bigint":  # a fraction is refused even where the cast would cut it
        value = F.when(F.trim(number).rlike(r"^[+-]?\d+$"), value)
    elif field.metadata["scale"] != 1.0:
        value = value / F.lit(field.metadata["scale"])
    empty = nothing if field.nullable else F.lit("empty")
    return F.when(text != "", value), broken.when(text == "", empty).when(value.isNull(), kind)


def parse_fixed_width(df: DataFrame, line: str, schema: StructType) -> DataFrame:
    """Add the record's fields and ``errors`` (field, raw, reason) to each line.

    Reasons: ``bytes`` (undecodable), ``empty`` (but required), ``bigint`` or ``double`` (no such
    number). A bad field is NULL and listed, the rest of the record stays. A line with too few bytes
    has NULL fields and one error, reason ``short``, under the field name ``*``.
    """
    require_feed_charset(df.sparkSession)
    raw = F.col(line)
    whole = F.length(raw) >= len(byte_map(schema))
    values, problems = [], [F.when(~whole, F.struct(
        F.lit("*").alias("field"), raw.alias("raw"), F.lit("short").alias("reason")))]
    for field in schema:
        value, reason = _convert(field, raw)
        values.append(F.when(whole, value).alias(field.name))
        problems.append(F.when(whole & reason.isNotNull(), F.struct(
            F.lit(field.name).alias("field"),
            F.substring(raw, field.metadata["at"] + 1, field.metadata["width"]).alias("raw"),
            reason.alias("reason"))))
    return df.select("*", *values, F.array_compact(F.array(*problems)).alias("errors"))
