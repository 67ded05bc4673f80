"""Queries on fitted models: trees, isotonic fit, and invariants that their SQL states as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.history import PREPARED_SQL
from bindings.scoring import COMPLETE_SQL, SCORED_SQL, complete, scored
from bindings.tables import members_in_passing
from wakeline.functions.encode import with_encodings, with_labels
from wakeline.operators import boosting, isotonic, models
from wakeline.operators.boosting import GRAIN, LEAF_GRAIN
from wakeline.operators.groups import complete_groups, group_softmax, renormalise_group
from wakeline.schema import RACE_KEYS
from wakeline.session import staged

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_PREDICTED: dict = {}


def _predicted(spark, sf):
    """Default trees on early years, calibrated on 2000, for all complete groups."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREDICTED:
        table = staged(complete_groups(with_encodings(with_labels(members_in_passing(spark, sf)))), "training")
        year = F.year("race_date")
        model = models.train_calibrated(table.filter(year < 2000), table.filter(year == 2000))
        _PREDICTED[key] = staged(model.predict(table, bounded=True), "predicted")
    return _PREDICTED[key]


#: Cut points of the features that the compared trees see.
CUTS = {
    "lane": [2.0, 3.0, 4.0, 5.0, 6.0],
    "national_win_rate": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0],
    "motor_top2_rate": [10.0, 20.0, 30.0, 40.0, 50.0, 60.0],
    "age": [22.0, 28.0, 34.0, 40.0, 46.0, 52.0],
    "wind_speed_m": [2.0, 4.0, 6.0, 8.0],
    "wave_height_cm": [2.0, 4.0, 6.0],
}
GROWTH = boosting.Params(trees=3, depth=3, rate=0.3, l2=1.0, min_rows=20)


def boosting_sql(rows: str, cuts, label: str, params: boosting.Params, keys) -> str:
    """The training on ``rows`` as a chain of SQL tables; the last, ``boosted``, has keys and margin."""
    names, carried = list(cuts), ", ".join(keys)
    bins = ", ".join("CASE WHEN {0} IS NULL THEN 0 ELSE 1 + {1} END AS b{2}".format(
        n, " + ".join(f"({n} >= {c!r}e0)::INT" for c in cuts[n]) or "0", i) for i, n in enumerate(names))
    tables = [f"step0 AS MATERIALIZED (SELECT {carried}, {label}::DOUBLE AS label, {bins}, 0e0 AS margin FROM {rows} WHERE {label} IS NOT NULL)"]
    last, every = "step0", ", ".join(f"b{i}" for i in range(len(names)))
    for tree in range(params.trees):
        at = f"(SELECT *, 1 AS node, 1e0 / (1e0 + exp(-margin)) AS chance FROM {last})"
        for level in range(params.depth + 1):
            name = f"t{tree}_{level}"
            cells = " UNION ALL ".join(
                f"SELECT node, {i} AS f, b{i} AS b, sum(floor((label - chance) * {GRAIN} + 0.5)::BIGINT)::BIGINT AS g, "
                f"sum(floor(chance * (1e0 - chance) * {GRAIN} + 0.5)::BIGINT)::BIGINT AS h, count(*) AS n FROM {name}_rows WHERE node > 0 GROUP BY ALL"
                for i in range(len(names)))
            sides = ", ".join(f"(low_{c} + CASE WHEN ml THEN none_{c} ELSE 0 END) AS left_{c}, (all_{c} - low_{c} - CASE WHEN ml THEN none_{c} ELSE 0 END) AS right_{c}" for c in "ghn")
            sums = ", ".join(f"(sum({c}) OVER w)::BIGINT AS all_{c}, (sum(CASE WHEN b > 0 THEN {c} ELSE 0 END) OVER (w ORDER BY b))::BIGINT AS low_{c}, "
                             f"(sum(CASE WHEN b = 0 THEN {c} ELSE 0 END) OVER w)::BIGINT AS none_{c}" for c in "ghn")
            worth = "{0}_g::DOUBLE * {0}_g::DOUBLE / ({0}_h::DOUBLE + {1}e0)"
            gain = " + ".join(worth.format(x, params.l2 * GRAIN) for x in ("left", "right")) + " - " + worth.format("all", params.l2 * GRAIN)
            usable = f"b > 0 AND left_n >= {params.min_rows} AND right_n >= {params.min_rows} AND gain > 0" if level < params.depth else "false"
            leaf = f"floor({params.rate!r}e0 * g / (h + {params.l2 * GRAIN}e0) * {LEAF_GRAIN} + 0.5) / {LEAF_GRAIN}"
            goes = "CASE s.f " + " ".join(f"WHEN {i} THEN r.b{i}" for i in range(len(names))) + " END"
            tables += [
                f"{name}_rows AS MATERIALIZED (SELECT * FROM {at})",
                f"{name}_cells AS ({cells})",
                f"{name}_sums AS (SELECT node, f, b, ml, {sums} FROM {name}_cells, (VALUES (false), (true)) v(ml) WINDOW w AS (PARTITION BY node, f, ml))",
                f"{name}_gains AS (SELECT *, {gain} AS gain FROM (SELECT *, {sides} FROM {name}_sums))",
                f"{name}_best AS MATERIALIZED (SELECT node, f, b, ml, ok, all_g AS g, all_h AS h FROM (SELECT *, {usable} AS ok FROM {name}_gains) "
                f"QUALIFY row_number() OVER (PARTITION BY node ORDER BY ok DESC, CASE WHEN ok THEN gain END DESC, f, b, ml) = 1)",
            ]
            # finished rows carry the negative of their node and their new margin
            at = (f"(SELECT r.* REPLACE (CASE WHEN s.node IS NULL THEN r.node WHEN NOT s.ok THEN -r.node "
                  f"WHEN CASE WHEN {goes} = 0 THEN s.ml ELSE {goes} <= s.b END THEN 2 * r.node ELSE 2 * r.node + 1 END AS node, "
                  f"CASE WHEN s.node IS NOT NULL AND NOT s.ok THEN r.margin + {leaf} ELSE r.margin END AS margin) "
                  f"FROM {name}_rows r LEFT JOIN {name}_best s ON r.node = s.node)")
        last = f"step{tree + 1}"
        tables.append(f"{last} AS MATERIALIZED (SELECT {carried}, label, {every}, margin FROM {at})")
    tables.append(f"boosted AS (SELECT {carried}, margin FROM {last})")
    return ",\n".join(tables)


@query("gbt_scores", f"""WITH {COMPLETE_SQL},
{boosting_sql("complete", CUTS, "won", GROWTH, ["race_no", "lane"])},
tops AS (SELECT race_no, max(margin) AS top FROM boosted GROUP BY race_no)
SELECT race_no, lane, round(margin, 9) AS score,
  round(exp(margin - top) / sum(exp(margin - top)) OVER (PARTITION BY race_no), 9) AS p_win
FROM boosted JOIN tops USING (race_no)""")
def gbt_scores(spark, sf):
    """Trees grown here on all complete groups, then walked as a table, and softmax in the group."""
    rows = complete(spark, sf)
    nodes = boosting.fit(rows, CUTS, "won", GROWTH)
    scores = group_softmax(rows.withColumn("score", boosting.margin(nodes)), bounded=True)
    return scores.select("race_no", "lane", *[F.round(c, 9).alias(c) for c in ("score", "p_win")])


@query("gbt_invariants", f"""WITH {PREPARED_SQL},
c AS (SELECT stadium_id, race_date, race_no, count(*) AS n FROM prepared GROUP BY ALL HAVING count(*) = 6 AND sum(won) = 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS races, 0 AS without_score, 0 AS outside, 0 AS wrong_totals, true AS better_than_even
FROM c""")
def gbt_invariants(spark, sf):
    """Every member of a complete group is scored, groups add up to one, winners stand out."""
    rows = _predicted(spark, sf)
    groups = rows.groupBy(*RACE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_win").alias("total"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("without"),
        F.count_if(~F.col("p_win").between(0.0, 1.0)).alias("outside"),
        F.sum(F.when(F.col("won") == 1, F.col("p_win"))).alias("p_winner"),
    )
    return groups.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("races"), F.sum("without").alias("without_score"),
        F.sum("outside").alias("outside"), F.count_if(F.abs(F.col("total") - 1) > 1e-9).alias("wrong_totals"),
        (F.avg("p_winner") > 1 / 6).alias("better_than_even"),
    )


ISOTONIC_SQL = SCORED_SQL + """,
points AS (SELECT round(p_win, 9) AS x, sum(won) AS s, count(*) AS w FROM scored GROUP BY 1),
summed AS (SELECT x, s, w, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM points),
means AS (
  SELECT b.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least
  FROM summed a JOIN summed b ON b.i >= a.i),
fitted AS (SELECT x, y FROM (SELECT i, max(least) AS y FROM means GROUP BY i) JOIN summed USING (i))"""


@query("isotonic_fit", f"""WITH {ISOTONIC_SQL}
SELECT race_no, lane, x AS raw, round(y, 9) AS calibrated,
  round(CASE WHEN sum(y) OVER (PARTITION BY race_no) > 0 THEN y / sum(y) OVER (PARTITION BY race_no) ELSE 1e0 / 6 END, 9) AS p_win
FROM scored JOIN fitted ON round(p_win, 9) = x""")
def isotonic_fit(spark, sf):
    """Every member's probability, what the isotonic fit maps it to, and that share of its group."""
    rows = scored(spark, sf).withColumn("raw", F.round("p_win", 9))
    calibrator = models.fit_calibrator(rows, p="raw")
    mapped = calibrator.map(rows.withColumn("calibrated", F.col("raw")), "calibrated")
    shares = renormalise_group(mapped.withColumn("p_win", F.col("calibrated")), bounded=True)
    return shares.select("race_no", "lane", "raw", *[F.round(c, 9).alias(c) for c in ("calibrated", "p_win")])


@query("isotonic_blocks", f"""WITH {ISOTONIC_SQL}
SELECT min(x) AS lo, max(x) AS hi, round(y, 9) AS y, CAST(sum(s) AS BIGINT) AS wins, CAST(sum(w) AS BIGINT) AS rows
FROM fitted JOIN summed USING (x) GROUP BY y""")
def isotonic_blocks(spark, sf):
    """The blocks of the fit; neighbours of one value are one block."""
    rows = scored(spark, sf).withColumn("raw", F.round("p_win", 9))
    blocks = isotonic.isotonic_blocks(rows, "raw", "won").withColumn("y", F.col("total") / F.col("weight"))
    return blocks.groupBy("y").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").cast("long").alias("wins"), F.sum("weight").cast("long").alias("rows"),
    ).select("lo", "hi", F.round("y", 9).alias("y"), "wins", "rows")


@query("isotonic_invariants", f"""WITH {PREPARED_SQL},
c AS (SELECT stadium_id, race_date, race_no, count(*) AS n, sum(won) AS w FROM prepared GROUP BY ALL HAVING count(*) = 6 AND sum(won) = 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(w) AS BIGINT) AS wins, 0 AS falls, 0 AS outside, true AS keeps_the_mean FROM c""")
def isotonic_invariants(spark, sf):
    """The fitted map never falls, stays in [0, 1] and keeps the mean of the labels."""
    rows = scored(spark, sf)
    calibrator = models.fit_calibrator(rows)
    fitted = calibrator.map(rows).select("won", F.col("p_win").alias("y"))
    return fitted.crossJoin(F.broadcast(isotonic.falls(calibrator.knots))).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("won").cast("long")).alias("wins"),
        F.coalesce(F.max("falls"), F.lit(0)).cast("int").alias("falls"),
        F.count_if(~F.col("y").between(0.0, 1.0)).alias("outside"),
        (F.abs(F.avg("y") - F.avg(F.col("won").cast("double"))) < 1e-9).alias("keeps_the_mean"),
    )
