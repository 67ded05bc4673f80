"""Queries on text and record parsing, each next to its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings.tables import LINES_A_PARTITION, read
from wakeline.functions import text as tx
from wakeline.session import shared_dir, tune
from wakeline.sources.fixed_width import parse_fixed_width, record, split_lines
from wakeline.sources.pages import element_cells, is_unavailable
from wakeline.streaming import keyed_state

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_SUPPLIER = record(
    ("suppkey", 0, 8, "bigint", {"required": True}),
    ("name", 9, 28),
    ("nation", 37, 4, "bigint"),
    ("acctbal", 41, 12, "double", {"scale": 100.0}),
    ("status", 53, 4, "bigint"),
)


@query("fixed_width_parse", """SELECT s_suppkey AS suppkey, s_name AS name,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS nation,
  round(s_acctbal, 2) AS acctbal, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 1 END AS status,
  CASE WHEN s_suppkey % 5 = 0 THEN 'status:bigint' ELSE '' END AS problems
FROM supplier""")
def fixed_width(spark, sf):
    """Suppliers written as files of many byte records each, then split and read back.

    Some fields are blank, some broken; names are padded with full-width blanks and
    numbers are partly full-width.
    """
    rows = read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    cents = F.round(F.col("s_acctbal") * 100).cast("bigint").cast("string")
    wide = F.translate(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), "0123456789", tx.WIDE_DIGITS)
    line = F.concat(
        F.encode(F.concat(F.lpad(key.cast("string"), 8, " "), F.lit(" "), F.rpad("s_name", 22, " ")), "US-ASCII"),
        F.encode(F.lit("　　　"), "windows-31j"),
        F.when(key % 7 == 0, F.lit("    ").cast("binary")).otherwise(F.encode(wide, "windows-31j")),
        F.encode(F.concat(F.lpad(cents, 12, " "), F.when(key % 5 == 0, "x1  ").otherwise("  01")), "US-ASCII"),
    )
    tune(spark)
    # files of at most 64 records, so that no file grows with the data
    records = rows.select(F.floor(key / 64).alias("file"), F.base64(F.concat(line, F.lit(b"\r\n\r\n"))).alias("line"))
    whole = F.aggregate("lines", F.lit(b""), lambda a, x: F.concat(a, F.unbase64(x)))
    files = records.groupBy("file").agg(F.collect_list("line").alias("lines")).select("file", whole.alias("content"))
    lines = split_lines(files, "content", keep=["file"])
    parsed = parse_fixed_width(lines, "line", _SUPPLIER)
    problems = F.array_join(
        F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["reason"])), ";"
    )
    return parsed.select(
        "suppkey", "name", "nation", F.round("acctbal", 2).alias("acctbal"),
        F.col("status").cast("int").alias("status"), problems.alias("problems"),
    )


@query("parse_scalars", """SELECT o_orderkey,
  (1 + o_orderkey % 3) * 60 + o_orderkey % 60 + (o_orderkey % 10) / 10.0e0 AS seconds,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -(o_orderkey % 100) / 100.0e0 ELSE (o_orderkey % 100) / 100.0e0 END AS timing,
  CASE WHEN o_orderkey % 4 = 0 THEN 'L' WHEN o_orderkey % 4 = 1 THEN 'F' END AS flag,
  CASE WHEN o_orderkey % 9 BETWEEN 1 AND 6 THEN o_orderkey % 9 END AS position,
  CASE WHEN o_orderkey % 9 = 0 THEN 'K0' WHEN o_orderkey % 9 > 6 THEN concat('0', o_orderkey % 9) END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 1000 END AS number,
  o_orderkey % 12 + 1 AS race_no, 1000 + o_orderkey % 9 * 100 AS distance,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 20 END AS wind
FROM orders""")
def parse_scalars(spark, sf):
    """Feed-style texts are rendered from the order key and parsed back."""
    k = F.col("o_orderkey")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    rows = read(spark, sf, "orders").select(
        "o_orderkey",
        F.concat((1 + k % 3).cast("string"), F.lit("."), two(k % 60), F.lit("."), (k % 10).cast("string")).alias("t"),
        F.when(k % 4 == 0, "L ").when(k % 4 == 1, F.concat(F.lit("F."), two(k % 100)))
        .otherwise(F.concat(F.lit("0."), two(k % 100))).alias("s"),
        F.when(k % 9 == 0, "K0").otherwise(two(k % 9)).alias("f"),
        F.when(k % 6 == 0, "-").otherwise(F.translate((k % 1000).cast("string"), "0123456789", tx.WIDE_DIGITS)).alias("n"),
        F.concat(F.lpad((k % 12 + 1).cast("string"), 4, " "), F.lit("R   title   H"),
                 (1000 + k % 9 * 100).cast("string"), F.lit("m  晴"),
                 F.when(k % 8 != 0, F.concat(F.lit("  風  北  "), (k % 20).cast("string"), F.lit("m"))).otherwise("")).alias("h"),
    )
    timing, finish = tx.start_timing(F.col("s")), tx.finish_code(F.col("f"))

    def part(i):
        return tx.group(tx.normalise_digits(F.col("h")), tx.RESULT_HEADER, i).cast("bigint")

    return rows.select(
        "o_orderkey", tx.race_time_seconds(F.col("t")).alias("seconds"),
        timing["timing"].alias("timing"), timing["flag"].alias("flag"),
        finish["position"].cast("bigint").alias("position"), finish["status"].alias("status"),
        tx.int_or_null(F.col("n")).cast("bigint").alias("number"),
        part(1).alias("race_no"), part(3).alias("distance"), part(6).alias("wind"),
    )


@query("normalise_text", """SELECT p_partkey, upper(p_name) AS name, replace(p_name, ' ', '') AS squashed, p_size AS size FROM part""")
def normalise_text(spark, sf):
    name = F.upper("p_name")
    wide = F.translate(name, tx.NARROW_UPPER + " ", tx.WIDE_UPPER + "　")
    return read(spark, sf, "part").select(
        "p_partkey",
        tx.normalise_width(wide).alias("name"),
        tx.squash_name(F.replace(F.col("p_name"), F.lit(" "), F.lit("　 "))).alias("squashed"),
        tx.int_or_null(F.translate(F.col("p_size").cast("string"), "0123456789", tx.WIDE_DIGITS)).alias("size"),
    )


@query("canonical_combination", """SELECT l_orderkey, l_extendedprice,
  concat_ws('-', l_linenumber, l_suppkey % 7, l_partkey % 7) AS ordered,
  array_to_string(list_sort([CAST(x AS VARCHAR) FOR x IN [l_linenumber, l_suppkey % 7, l_partkey % 7]]), '-') AS unordered FROM lineitem""")
def canonical(spark, sf):
    raw = F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 7).cast("string"),
                      (F.col("l_partkey") % 7).cast("string"))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_extendedprice",
        tx.canonical_combination(F.lit("trifecta"), raw).alias("ordered"),
        tx.canonical_combination(F.lit("trio"), raw).alias("unordered"),
    )


@query("regexp_explode", """SELECT o_orderkey, CAST(i AS INT) AS i, concat(1 + (o_orderkey + i) % 6, '-', 1 + (o_orderkey + i + 1) % 6) AS combo,
  100 + (o_orderkey * (i + 1)) % 9000 AS yen, CASE WHEN i = 1 THEN NULL ELSE (o_orderkey + i) % 30 END AS popularity
FROM orders, range(0, 3) t(i)""")
def regexp_explode(spark, sf):
    """Three dividends on one line, the second without a popularity."""
    k = F.col("o_orderkey")

    def item(i):
        parts = [(1 + (k + i) % 6).cast("string"), F.lit("-"), (1 + (k + i + 1) % 6).cast("string"),
                 F.lit("      "), (100 + (k * (i + 1)) % 9000).cast("string")]
        if i != 1:
            parts += [F.lit("  人気  "), ((k + i) % 30).cast("string")]
        return F.concat(*parts)

    line = F.concat(F.lit("拡連複   "), item(0), F.lit("   "), item(1), F.lit("   "), item(2))
    lines = read(spark, sf, "orders").select(
        "o_orderkey", tx.normalise_digits(tx.strip_bet_label(line)).alias("paid")
    )
    entries = tx.payout_entries(F.col("paid"))
    return lines.select("o_orderkey", F.posexplode(entries).alias("i", "e")).select(
        "o_orderkey", "i", F.col("e.combo").alias("combo"), F.col("e.yen").cast("bigint").alias("yen"),
        F.col("e.popularity").cast("bigint").alias("popularity"),
    )


@query("period_key", """SELECT o_orderkey, concat('fan', CASE WHEN h = 1 THEN lpad(CAST((y - 1) % 100 AS VARCHAR), 2, '0') ELSE lpad(CAST(y % 100 AS VARCHAR), 2, '0') END,
  CASE WHEN h = 1 THEN '10' ELSE '04' END) AS stem
FROM (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS h FROM orders)""")
def period_key(spark, sf):
    half = F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)
    return read(spark, sf, "orders").select(
        "o_orderkey", tx.period_key(F.year("o_orderdate"), half).alias("stem")
    )


@query("date_spine", """SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS orders
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) s
LEFT JOIN (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) o ON o_orderdate = d""")
def date_spine_query(spark, sf):
    per_day = read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    ends = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select(F.explode(tx.date_spine(F.col("a"), F.col("b"))).alias("day"))
    return spine.join(per_day, "day", "left").select(
        "day", F.coalesce("orders", F.lit(0)).alias("orders")
    )


@query("html_cell_extract", r"""SELECT page_id, CAST(i - 1 AS INT) AS cell_no,
  regexp_extract(links[i], '<a href="([^"]*)"', 1) AS href,
  replace(replace(replace(replace(regexp_replace(regexp_replace(links[i], '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text, false AS unavailable
FROM (SELECT page_id, links, unnest(generate_series(1, len(links))) AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<li><a[^>]*>.*?</a>') AS links FROM pages))""")
def html_cells(spark, sf):
    pages = read(spark, sf, "pages").withColumn("unavailable", is_unavailable(F.col("html")))
    cells = element_cells(pages, "html", ["page_id", "unavailable"], r"(?s)<li><a([^>]*)>(.*?)</a>")
    return cells.select(
        "page_id", "cell_no", F.regexp_extract("attrs", 'href="([^"]*)"', 1).alias("href"), "text",
        "unavailable",
    )


def _stream_of_events(spark, sf):
    """The table as files that arrive in two halves, in no order of time; larger tables make more files."""
    events = read(spark, sf, "events")
    files = max(4, -(-events.count() // LINES_A_PARTITION))  # from the footers
    folder = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    events.repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(folder)


def _kept(spark, stream, merge):
    checkpoint = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    keyed_state.keep(stream, merge, checkpoint).awaitTermination()
    return keyed_state.read_state(spark, merge, checkpoint)


@query("stream_latest_record", """SELECT user_id, event_type, round(value, 6) AS value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_record(spark, sf):
    """The newest record of each key, kept in a state store over several batches."""
    merge = keyed_state.Merge(["user_id"], ["ts", "event_id"], ["event_type", "value", "props"], whole=True, salts=2)
    return _kept(spark, _stream_of_events(spark, sf), merge).withColumn("value", F.round("value", 6))


@query("stream_late_feed", """SELECT user_id,
  round(arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), 6) AS last_purchase,
  arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS last_error, bool_or(event_type = 'signup') AS signed_up
FROM events GROUP BY user_id""")
def stream_late_feed(spark, sf):
    """Columns that different feeds carry, each with its newest value, and a flag that any feed sets."""
    kind = F.col("event_type")
    feeds = _stream_of_events(spark, sf).select(
        "user_id", "ts", "event_id", F.when(kind == "purchase", F.col("value")).alias("last_purchase"),
        F.when(kind == "error", F.col("props")).alias("last_error"), (kind == "signup").alias("signed_up"))
    merge = keyed_state.Merge(["user_id"], ["ts", "event_id"], ["last_purchase", "last_error", "signed_up"], either=["signed_up"])
    return _kept(spark, feeds, merge).withColumn("last_purchase", F.round("last_purchase", 6))
