"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.

Only DataFrame and SQL functions are used. Entities of the fixed kinds are seeds, as whole spans.
The two words before a seed or before another identifier-like value, with the value's rough shape,
form a lexical pattern; patterns and values make a bipartite graph. Scores go back and forth over
it: a pattern is as good as the mean of its values, a value is as good as its best pattern.
Patterns that stay confident mark values nobody listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_or_empty
from wakeline.session import staged

#: The kinds in their order, and what they match. Possessive quantifiers and the
#: look-behinds change no match; they keep the time linear on long runs. ``\G`` is the end of
#: the match before.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$"
#: Values that may be identifiers: runs of letters and digits with a digit or tied to another run,
#: and several runs with digits that single spaces, hyphens or brackets hold together.
_TIE = "[._@%+:/-]{1,3}+"
_RUN = rf"[\p{{L}}0-9]++(?:{_TIE}[\p{{L}}0-9]++)*+"
_NUMBER = rf"(?=[\p{{L}}._@%+:/-]*+[0-9]){_RUN}"
_TIED = rf"(?=\p{{L}}*+(?:[0-9]|{_TIE}[\p{{L}}0-9])){_RUN}"
_BEGIN = r"(?<![\p{L}0-9])\+?+\(?+"
CANDIDATE = rf"{_BEGIN}{_TIED}"
SPACED = rf"{_BEGIN}(?:{_NUMBER}(?:(?:\)?+[ -]\(?+|[()]){_NUMBER})*+|{_TIED})"
#: Characters a value needs, and digits if nothing ties letters to another run.
MIN_CHARS, MIN_DIGITS = 6, 3
#: Characters before a value in which its two words are looked for.
CONTEXT_CHARS = 64
#: The kind of values found by their contexts.
FOUND = "context"
#: Rounds of scoring, distinct values a pattern needs, and the score from which it is trusted.
ROUNDS, MIN_VALUES, TRUSTED = 3, 5, 0.8


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, value, before>> of ``found``; ``before`` is the gap that precedes it."""
    def starts(gaps: Column) -> Column:
        lengths = F.transform(found, lambda value, i: F.struct(
            F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(value).alias("own")))
        state = F.struct(F.lit(0).alias("at"), _none("int").alias("out"))
        return F.aggregate(lengths, state, lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["own"]).alias("at"),
            F.array_append(s["out"], s["at"] + x["gap"]).alias("out")), lambda s: s["out"])

    def build(gaps: Column) -> Column:
        def one(at: Column) -> Column:
            return F.transform(found, lambda value, i: F.struct(
                F.get(at, i).alias("start"), (F.get(at, i) + F.char_length(value)).alias("end"),
                value.alias("value"), F.get(gaps, i).alias("before")))

        return F.get(F.transform(F.array(starts(gaps)), one), F.lit(0))

    # gaps and starts are needed once per match: one-element lists bind them
    bound = F.transform(F.array(F.split(text, pattern, -1)), build)
    return F.when(F.size(found) > 0, F.get(bound, F.lit(0))).otherwise(
        _none("struct<start:int,end:int,value:string,before:string>"))


def _in_context(spans: Column) -> Column:
    """``spans`` of located(), with the text before the span's own start as ``before``.

    Contexts reach over earlier matches. A match has a character at least, so CONTEXT_CHARS
    matches back are enough, and the time is linear.
    """
    n = CONTEXT_CHARS
    ends = F.transform(spans, lambda s: F.right(F.concat(s["before"], s["value"]), F.lit(n)))

    def build(ends: Column) -> Column:
        return F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.right(F.concat(F.array_join(F.slice(ends, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))), ""), s["before"]),
                    F.lit(n)).alias("before")))

    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(ends), build), F.lit(0))).otherwise(
        _none("struct<start:int,end:int,value:string,before:string>"))


def _clear(spans: Column, others: Column) -> Column:
    """The ``spans`` (by start, apart from each other) that meet none of ``others``, in one pass each way."""
    def at(kind: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    def passed(events: Column, first: int, reach, hit) -> Column:
        state = F.struct(F.lit(first).alias("reach"), F.lit("").alias("out"))
        return F.aggregate(events, state, lambda t, e: F.struct(
            F.when(e["kind"] == 0, reach(t["reach"], e)).otherwise(t["reach"]).alias("reach"),
            F.when(e["kind"] == 0, t["out"]).otherwise(F.concat(t["out"], hit(t["reach"], e).cast("int").cast("string"))).alias("out")),
            lambda t: t["out"])

    def pick(events: Column) -> Column:
        left = passed(events, 0, lambda r, e: F.greatest(r, e["end"]), lambda r, e: r > e["start"])
        right = F.reverse(passed(F.reverse(events), (1 << 31) - 1, lambda r, e: F.least(r, e["start"]), lambda r, e: r < e["end"]))
        flags = F.array(F.struct(F.split(left, "").alias("left"), F.split(right, "").alias("right")))
        return F.get(F.transform(flags, lambda f: F.filter(
            spans, lambda s, i: (F.get(f["left"], i) == "0") & (F.get(f["right"], i) == "0"))), F.lit(0))

    events = F.sort_array(F.concat(F.transform(others, at(0)), F.transform(spans, at(1))))
    some = F.get(F.transform(F.array(events), pick), F.lit(0))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), some).otherwise(spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind stands its check."""
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(text: Column, kind: str) -> Column:
    found = F.col(f"_wk_{kind}")
    return F.when(F.exists(found, lambda v: _valid(kind, v)), located(text, KINDS[kind], found)).otherwise(
        _none("struct<start:int,end:int,value:string,before:string>"))


def _valid_spans(kind: str) -> Column:
    spans = _in_context(F.col(f"_wk_{kind}"))
    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        s["before"].alias("before")))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, value, before>>, kinds in order, then by start."""
    column = F.col(text)
    may = {"email": F.contains(column, F.lit("@")), "phone": F.contains(column, F.lit("+")),
           "ip": column.rlike(r"[0-9]\.[0-9]"), "card": column.rlike("[0-9]")}
    df = docs.withColumns({f"_wk_{k}": F.when(may[k], matches(column, p)).otherwise(_none("string"))
                           for k, p in KINDS.items()})
    # most candidates fail their check: look at positions only where one holds
    df = df.withColumns({f"_wk_{k}": _checked(column, k) for k in KINDS})
    df = df.withColumns({f"_wk_{k}": _valid_spans(k) for k in KINDS})
    return df.withColumn(out, F.concat(*[F.col(f"_wk_{k}") for k in KINDS])).drop(*[f"_wk_{k}" for k in KINDS])


def candidates(docs: DataFrame, text: str = "text", base: str = "base", out: str = "cands") -> DataFrame:
    """Add ``out``: seeds (the spans of ``base``) and other identifier-like values, with their patterns.

    A pattern is the two words of text before the value (one at the start of a text), in lower case
    and without the numbers' digits, and whether digits or letters prevail in the value. Where a
    spaced value would run into a seed, its parts are taken one by one.
    """
    column = F.col(text)
    wide, narrow = F.col("_wk_wide"), F.col("_wk_narrow")

    def letters(value: Column) -> Column:
        return F.regexp_replace(value, r"\P{L}", "")

    def fits(s: Column) -> Column:
        tied = s["value"].rlike(rf"\p{{L}}{_TIE}[\p{{L}}0-9]")
        return (F.length(s["value"]) >= MIN_CHARS) & (tied | (F.length(_digits(s["value"])) >= MIN_DIGITS))

    def describe(s: Column, seed: bool) -> Column:
        left = F.regexp_extract(F.lower(s["before"]), r"((?:\S+\s+)?\S+\s*)$", 1)
        left = F.regexp_replace(F.regexp_replace(left, r"\s+", " "), "[0-9]+", "0")
        shape = F.when(F.length(_digits(s["value"])) >= F.length(letters(s["value"])), "9").otherwise("a")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"),
                        F.concat(left, F.lit("\u0001"), shape).alias("pattern"),
                        (left != "").alias("placed"), F.lit(seed).alias("seed"))

    def ends(*spans: Column) -> Column:
        return F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for c in spans])

    df = docs.withColumn("_wk_wide", matches(column, SPACED))
    df = df.withColumn("_wk_wide", located(column, SPACED, wide))
    # contexts reach over matches that are left out, so they are taken first
    df = df.withColumn("_wk_wide", _in_context(wide))
    df = df.withColumn("_wk_free", _clear(wide, F.col(base)))
    cut = F.size("_wk_free") < F.size(wide)
    df = df.withColumn("_wk_narrow", F.when(cut, matches(column, CANDIDATE)).otherwise(_none("string")))
    df = df.withColumn("_wk_narrow", located(column, CANDIDATE, narrow))
    df = df.withColumn("_wk_narrow", _in_context(narrow))
    df = df.withColumn("_wk_narrow", _clear(narrow, ends(F.col(base), F.col("_wk_free"))))
    unseen = F.filter(F.concat("_wk_free", "_wk_narrow"), fits)
    described = F.concat(F.transform(F.col(base), lambda s: describe(s, True)), F.transform(unseen, lambda s: describe(s, False)))
    return (df.withColumn(out, F.filter(described, lambda c: c["placed"]))
            .drop("_wk_wide", "_wk_free", "_wk_narrow"))


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) of patterns to trust, from rows (pattern, value, seed).

    Each distinct value counts once per pattern, however many copies hold it.
    """
    links = staged(occurrences.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "links")
    values = links.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        scored = links.select("pattern", "value").join(values, "value")
        patterns = scored.groupBy("pattern").agg(
            F.avg("score").alias("mean"), F.count("*").alias("n"), F.sum("score").alias("mass"))
        # few values say little: one doubtful value is added to each pattern
        patterns = staged(patterns.select("pattern", "n", (F.col("mass") / (F.col("n") + 1)).alias("score")), "patterns")
        values = (links.join(patterns.filter(F.col("n") >= MIN_VALUES).select("pattern", "score"), "pattern", "left")
                  .groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).alias("score")))
    return patterns.filter((F.col("n") >= MIN_VALUES) & (F.col("score") >= TRUSTED)).select("pattern", "score")


def discovered(tagged: DataFrame) -> DataFrame:
    """(text_key, added): spans of unseen identifiers, from rows with text_key and cands."""
    rows = tagged.filter(F.size("cands") > 0).select("text_key", F.explode("cands").alias("c")).select("text_key", "c.*")
    rows = staged(rows, "occurrences")
    return (rows.filter(~F.col("seed")).join(trusted_patterns(rows).select("pattern"), "pattern")
            .groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct(
                F.lit(FOUND).alias("kind"), "start", "end"))).alias("added")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Spans of every text, one row for each row of ``docs`` (doc_id, text).

    Positions are code points, ends exclusive. Null text counts as empty and has no span; texts
    are never cut. Equal texts get equal spans; other columns are ignored.
    """
    rows = base_spans(docs.select("doc_id", text_or_empty().alias("text")))
    rows = candidates(rows).select(
        "doc_id", F.md5("text").alias("text_key"),
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                               s["end"].alias("end"))).alias("base"), "cands")
    tagged = staged(rows, "tagged")
    added = discovered(tagged)
    some = tagged.filter(F.exists("cands", lambda c: ~c["seed"])).select("doc_id", "text_key", "base")
    rest = tagged.filter(~F.exists("cands", lambda c: ~c["seed"])).select("doc_id", "base")
    none = _none("struct<kind:string,start:int,end:int>")
    result = (some.join(added, "text_key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
              .unionByName(rest.withColumn("added", none)))
    return result.select(
        "doc_id",
        *[_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; null texts stay null, other columns too.

    Spans that overlap are replaced as one, named after the first. Column names that begin with
    ``_wk_`` are reserved.
    """
    columns = docs.columns
    df = docs.withColumn("_wk_text", text_or_empty(text))
    df = candidates(base_spans(df, "_wk_text", "_wk_base"), "_wk_text", "_wk_base", "_wk_cands")
    key = "_wk_key"
    df = staged(df.withColumn(key, F.md5("_wk_text")), "located")
    doubtful = F.exists("_wk_cands", lambda c: ~c["seed"])
    tagged = df.select(F.col(key).alias("text_key"), F.col("_wk_cands").alias("cands"))
    added = discovered(tagged).select(F.col("text_key").alias(key), F.col("added").alias("_wk_added"))
    plain = F.transform("_wk_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = _none("struct<kind:string,start:int,end:int>")
    some = df.filter(doubtful).join(added, key, "left").withColumn("_wk_spans", F.concat(plain, F.coalesce("_wk_added", none)))
    rest = df.filter(~doubtful).withColumn("_wk_spans", plain)

    def masked(row_text: Column, spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(state: Column, s: Column) -> Column:
            inside = s["start"] < state["at"]
            gap = F.substring(row_text, state["at"] + 1, s["start"] - state["at"])
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(inside, state["out"]).otherwise(
                    F.concat(state["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("out"))

        return F.aggregate(ordered, start, step, lambda s: F.concat(
            s["out"], F.substring(row_text, s["at"] + 1, F.length(row_text))))

    both = some.select(*columns, "_wk_text", "_wk_spans").unionByName(rest.select(*columns, "_wk_text", "_wk_spans"))
    new = F.when(F.col(text).isNull(), F.lit(None)).when(
        F.size("_wk_spans") == 0, F.col("_wk_text")).otherwise(masked(F.col("_wk_text"), F.col("_wk_spans")))
    return both.withColumn(text, new).select(*columns)
