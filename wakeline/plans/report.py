"""Tables behind the daily report, and the report itself as ordered text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.numeric import implied_probability
from wakeline.schema import RACE_KEYS, TICKET_KEYS, VENUES
from wakeline.session import staged

PICKS_SHOWN = 80
FAVOURITES_SHOWN = 10


def top_picks(priced: DataFrame, threshold: float, shown: int = PICKS_SHOWN) -> DataFrame:
    """The best ``shown`` tickets by expected value, and the count of all picks.

    The picks are written once, so tickets are exploded and priced once.
    """
    picks = staged(priced.filter(F.col("ev") >= threshold), "picks")
    best = picks.orderBy(F.desc("ev"), *TICKET_KEYS).limit(shown)
    # at most ``shown`` rows from here on
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("ev"), *TICKET_KEYS))
    total = picks.agg(F.count(F.lit(1)).alias("picks")).withColumn("_k", F.lit(0))
    return best.withColumns({"place": place, "_k": F.lit(0)}).join(total, "_k").drop("_k")


def favourites(odds: DataFrame, shown: int = FAVOURITES_SHOWN) -> DataFrame:
    """Cheapest prices and the probability they imply."""
    return odds.orderBy("odds", *TICKET_KEYS).limit(shown).withColumn(
        "p_market", implied_probability(F.col("odds"))
    )


def member_lines(
    scored: DataFrame, pattern: str = "%d %.3f", keys: list[str] = RACE_KEYS
) -> DataFrame:
    """One text per group: its members and probabilities in member order.

    For complete groups, i.e. a handful of members each.
    """
    item = F.format_string(pattern, F.col("lane"), F.col("p_win"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("lane"), item.alias("text"))))
    return scored.groupBy(*keys).agg(entries.alias("_e")).select(
        *keys, F.array_join(F.transform("_e", lambda e: e["text"]), " ").alias("line")
    )


def _venue(column: str):
    names = F.create_map(*[F.lit(x) for item in VENUES.items() for x in item])
    return F.coalesce(names[F.col(column).cast("int")], F.col(column).cast("string"))


def daily_report(
    day: str, scored: DataFrame, priced: DataFrame, threshold: float, feature_set: str
) -> DataFrame:
    """The report as rows (section, a, b, c, text); sorted by these it reads in order."""
    spark = scored.sparkSession

    def fixed(section: int, *texts: str) -> DataFrame:
        rows = [(section, float(i), 0, 0, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "section INT, a DOUBLE, b INT, c INT, text STRING")

    groups = scored.select(*RACE_KEYS).distinct().agg(F.count(F.lit(1)).alias("groups"))
    counts = priced.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.coalesce(F.sum((F.col("ev") >= threshold).cast("long")), F.lit(0)).alias("picks"),
    )
    summary = groups.withColumn("_k", F.lit(0)).join(counts.withColumn("_k", F.lit(0)), "_k")
    share = F.coalesce(F.try_divide(F.col("picks") * 100.0, F.col("tickets")), F.lit(0.0))
    head = summary.select(
        F.inline(
            F.array(
                F.struct(F.lit(2), F.lit(0.0), F.lit(0), F.lit(0),
                         F.format_string("- 対象レース数: **%d**", "groups")),
                F.struct(F.lit(2), F.lit(1.0), F.lit(0), F.lit(0),
                         F.lit(f"- EV閾値: **{threshold:.2f}**")),
                F.struct(F.lit(2), F.lit(2.0), F.lit(0), F.lit(0),
                         F.format_string("- 期待値プラスの買い目: **%d** 点 (全 %d 点中 %.2f%%)",
                                         "picks", "tickets", share)),
                F.struct(F.lit(2), F.lit(3.0), F.lit(0), F.lit(0),
                         F.lit(f"- 特徴量セット: `{feature_set}`")),
            )
        ).alias("section", "a", "b", "c", "text")
    )
    best = top_picks(priced, threshold)
    pick_lines = best.select(
        F.lit(5).alias("section"), F.col("place").cast("double").alias("a"),
        F.lit(0).alias("b"), F.lit(0).alias("c"),
        F.concat(
            F.lit("| "), _venue("stadium_id"),
            F.format_string(" | %s | %s | %.3f%% | ", F.col("race_no").cast("string"),
                            F.col("combination"), F.col("p_model") * 100),
            F.format_number("expected_payout", 0),
            F.format_string("円 | %.2f |", "ev"),
        ).alias("text"),
    )
    table_head = counts.select(
        F.inline(
            F.when(
                F.col("picks") > 0,
                F.array(*[F.struct(F.lit(4), F.lit(float(i)), F.lit(0), F.lit(0), F.lit(t))
                          for i, t in enumerate((
                              "## 買い目（3連単）", "",
                              "| 場 | R | 組番 | モデル確率 | 想定払戻 | EV |",
                              "|---|---:|---|---:|---:|---:|"))]),
            ).otherwise(
                F.array(*[F.struct(F.lit(4), F.lit(float(i)), F.lit(0), F.lit(0), F.lit(t))
                          for i, t in enumerate((
                              "## 買い目なし", "",
                              "期待値が閾値を超える組み合わせはありませんでした。"))]),
            )
        ).alias("section", "a", "b", "c", "text")
    )
    rest = counts.filter(F.col("picks") > PICKS_SHOWN).select(
        F.lit(6).alias("section"), F.lit(0.0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"),
        F.format_string("| … | | 他 %d 点 | | | |", F.col("picks") - PICKS_SHOWN).alias("text"),
    )
    percent = scored.withColumn("p_win", F.col("p_win") * 100)
    lines = member_lines(percent, "%d号艇 %.1f%%").select(
        F.lit(8).alias("section"), F.col("stadium_id").cast("double").alias("a"),
        F.col("race_no").cast("int").alias("b"), F.lit(0).alias("c"),
        F.concat(F.lit("- **"), _venue("stadium_id"), F.lit(" "),
                 F.col("race_no").cast("string"), F.lit("R**: "), F.col("line")).alias("text"),
    )
    notes = []
    if feature_set == "morning":
        notes = [fixed(3, "", "> 朝の時点で確定している情報（番組表）のみで算出しています。", "")]
    else:
        notes = [fixed(3, "")]
    parts = [
        fixed(1, f"# 買い目レポート {day}", ""), head, *notes, table_head, pick_lines, rest,
        fixed(7, "", "## 各レースの1着確率", ""), lines,
        fixed(9, "", "---", "", "- 想定払戻は過去平均配当です。舟券の払戻率は75%です。"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
