"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor turns each part
into text: text parts are escaped, the others become placeholders in order, and their references
and expanded token counts are recorded. Turns are then wrapped in marks and joined. Texts cannot
forge marks: ``&`` and ``<|`` are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
START, END = "<|im_start|>", "<|im_end|>"
#: Expanded tokens of one attachment: a base, and so many per unit of its size
#: (image: tile, audio: second, document: page).
EXPANSION = {"image": (85, 170), "audio": (4, 25), "document": (8, 600)}
#: Roles whose text bears loss.
LOSS_ROLES = ("assistant",)
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&a")), F.lit("<|"), F.lit("&l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&l"), F.lit("<|")), F.lit("&a"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A list of one text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def visit(part: Column) -> Column:
    """struct<out, kind, ref, tokens> of one part.

    Parts of an unknown or null kind are read as text; null texts are empty; an attachment
    without a size counts one unit.
    """
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    known = kind.isin(*EXPANSION)
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))
    tokens = F.lit(None).cast("bigint")
    for name, (base, each) in EXPANSION.items():
        tokens = F.when(kind == name, base + each * units).otherwise(tokens)
    return F.struct(
        F.when(known, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("out"),
        F.when(known, kind).alias("kind"), F.when(known, part["ref"]).alias("ref"), tokens.cast("bigint").alias("tokens"))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts array<PART>).

    Returns conv_id, formatted, mask and attachments. ``mask`` has, turn by turn, where text
    that bears loss begins after the turn's own start and how long it is (0: none), in code points.
    ``attachments`` are array<struct<turn, kind, ref, tokens>> in order. Turns go by turn, role and
    text, nulls first, and repeated rows stay; rows with a null conv_id form one conversation.
    A null list of parts is an empty text.
    """
    parts = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit)
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), parts.alias("visited"))
    role = _escape_role(F.col("role"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = F.array_join(F.transform("visited", lambda v: v["out"]), "")
    bears = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    rows = rows.select("conv_id", F.struct(
        "turn", "role", F.concat(head, body, F.lit(END)).alias("out"),
        F.struct(F.length(head).alias("skip"), F.when(bears, F.length(body)).otherwise(0).alias("take")).alias("mask"),
        F.transform(F.filter("visited", lambda v: v["kind"].isNotNull()), lambda v: F.struct(
            v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens"))).alias("attached")).alias("t"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    attachments = F.flatten(F.transform("ts", lambda t: F.transform(t["attached"], lambda a: F.struct(
        t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return joined.select(
        "conv_id",
        F.concat(F.array_join(F.transform("ts", lambda t: t["out"]), "\n"), F.lit("\n")).alias("formatted"),
        F.transform("ts", lambda t: t["mask"]).alias("mask"), attachments.alias("attachments"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read conversations back: conv_id, turns array<struct<role, text>>, loss_texts, formatted.

    Works on the formatted string and the mask alone. Placeholders stay in the text as marks.
    """
    pieces = F.split(F.col("formatted"), r"\Q" + END + r"\E\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last mark is empty
    rows = formatted.select("conv_id", "formatted", "mask", turns.alias("pieces"))

    def turn(piece: Column) -> Column:
        bare = F.substring(piece, len(START) + 1, F.length(piece))
        cut = F.locate("\n", bare)
        return F.struct(_unescape_role(F.substring(bare, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(bare, cut + 1, F.length(bare))).alias("text"))

    masked = F.filter(F.arrays_zip("pieces", "mask"), lambda z: z["mask"]["take"] > 0)
    loss = F.transform(masked, lambda z: unescape(F.substring(z["pieces"], z["mask"]["skip"] + 1, z["mask"]["take"])))
    return rows.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), loss.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what was read back, as counts (code points) and SHA-256."""
    read = parse(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
