"""Queries on scores and probabilities, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.history import PREPARED_SQL
from bindings.tables import members, members_in_passing
from wakeline.functions.encode import with_labels
from wakeline.functions.numeric import interp
from wakeline.operators import metrics, splits
from wakeline.operators.groups import complete_groups, group_softmax, renormalise_group, sum_to_one
from wakeline.operators.triples import race_tickets

QUERIES = {}
SQL = {}

COMPLETE_SQL = PREPARED_SQL + """,
complete AS (
  SELECT * FROM prepared
  QUALIFY count(*) OVER (PARTITION BY race_no) = 6 AND sum(won) OVER (PARTITION BY race_no) = 1)"""

SCORED_SQL = COMPLETE_SQL + """,
scored AS (
  SELECT *, e / sum(e) OVER (PARTITION BY race_no) AS p_win
  FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY race_no)) AS e FROM complete))"""

TICKETS_SQL = SCORED_SQL + """,
tickets AS (
  SELECT a.race_date, a.stadium_id, a.race_no, concat(a.lane, '-', b.lane, '-', c.lane) AS combination,
    a.p_win * (b.p_win / (1 - a.p_win)) * (c.p_win / (1 - a.p_win - b.p_win)) AS p_model
  FROM scored a JOIN scored b ON a.race_no = b.race_no AND a.lane <> b.lane
  JOIN scored c ON a.race_no = c.race_no AND c.lane <> a.lane AND c.lane <> b.lane)"""

KNOTS_X = [0.0, 0.05, 0.1, 0.2, 0.4, 0.8]
KNOTS_Y = [0.0, 0.04, 0.11, 0.19, 0.37, 0.66]
_SEGMENTS = "\n".join(
    f"    WHEN {{p}} < {x1} THEN ({y1 - y0!r}e0) / ({x1 - x0!r}e0) * ({{p}} - {x0}e0) + {y0}e0"
    for x0, x1, y0, y1 in zip(KNOTS_X, KNOTS_X[1:], KNOTS_Y, KNOTS_Y[1:])
)


def interp_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} <= {KNOTS_X[0]} THEN {KNOTS_Y[0]}e0\n{_SEGMENTS.format(p=p)}\n"
        f"    ELSE {KNOTS_Y[-1]}e0 END"
    )


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def complete(spark, sf):
    return complete_groups(with_labels(members_in_passing(spark, sf)))


def scored(spark, sf):
    return group_softmax(complete(spark, sf), bounded=True)


def tickets(spark, sf):
    return race_tickets(scored(spark, sf))


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("complete_groups", f"WITH {COMPLETE_SQL} SELECT race_no, lane, CAST(won AS BIGINT) AS won FROM complete")
def complete_groups_query(spark, sf):
    return complete(spark, sf).select("race_no", "lane", "won")


@query("group_softmax", f"""WITH {PREPARED_SQL}
SELECT race_no, lane, round(e / sum(e) OVER (PARTITION BY race_no), 6) AS p_win
FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY race_no)) AS e FROM prepared)""")
def softmax_query(spark, sf):
    """Groups of any size, so statistics are joined back."""
    return group_softmax(members(spark, sf)).select("race_no", "lane", *_r("p_win"))


@query("group_softmax_null_keys", f"""WITH {PREPARED_SQL},
k AS (SELECT race_no, lane, score, CASE WHEN race_no % 5 <> 0 THEN race_no END AS g FROM prepared)
SELECT race_no, lane, round(e / sum(e) OVER (PARTITION BY g), 9) AS p_win
FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY g)) AS e FROM k)""")
def softmax_null_keys(spark, sf):
    """Members without a group form a (large) group of their own."""
    rows = members(spark, sf).withColumn("g", F.when(F.col("race_no") % 5 != 0, F.col("race_no")))
    return group_softmax(rows, ["g"]).select("race_no", "lane", *_r("p_win", digits=9))


@query("interp_knots", f"WITH {SCORED_SQL} SELECT race_no, lane, round({interp_sql('p_win')}, 6) AS calibrated FROM scored")
def interp_query(spark, sf):
    rows = scored(spark, sf).withColumn("calibrated", interp(F.col("p_win"), KNOTS_X, KNOTS_Y))
    return rows.select("race_no", "lane", *_r("calibrated"))


@query("renormalise_group", f"""WITH {SCORED_SQL}, c AS (SELECT race_no, lane, {interp_sql('p_win')} AS v FROM scored)
SELECT race_no, lane, round(CASE WHEN sum(v) OVER (PARTITION BY race_no) > 0
  THEN v / sum(v) OVER (PARTITION BY race_no) ELSE 1.0e0 / 6 END, 6) AS p_win FROM c""")
def renormalise_query(spark, sf):
    calibrated = scored(spark, sf).withColumn("p_win", interp(F.col("p_win"), KNOTS_X, KNOTS_Y))
    return renormalise_group(calibrated, bounded=True).select("race_no", "lane", *_r("p_win"))


@query("plackett_luce_triples", f"WITH {TICKETS_SQL} SELECT race_no, combination, round(p_model, 9) AS p_model FROM tickets")
def triples_query(spark, sf):
    return tickets(spark, sf).select("race_no", "combination", *_r("p_model", digits=9))


@query("sum_to_one_check", f"""WITH {TICKETS_SQL}
SELECT count(*) AS groups, round(min(t), 6) AS min_total, round(max(t), 6) AS max_total
FROM (SELECT sum(p_model) AS t FROM tickets GROUP BY race_no)""")
def sum_to_one_query(spark, sf):
    return sum_to_one(tickets(spark, sf), column="p_model").select(
        "groups", *_r("min_total", "max_total")
    )


@query("brier_score", f"WITH {SCORED_SQL} SELECT round(avg((p_win - won) * (p_win - won)), 9) AS brier FROM scored")
def brier_query(spark, sf):
    return scored(spark, sf).agg(metrics.brier("p_win", "won").alias("brier")).select(
        *_r("brier", digits=9)
    )


_AUC_SQL = """(SELECT (sum(CASE WHEN won = 1 THEN rk END) - sum(won) * (sum(won) + 1) / 2.0e0)
    / (sum(won) * (count(*) - sum(won)))
  FROM (SELECT won, avg(rn) OVER (PARTITION BY p_win) AS rk
        FROM (SELECT won, p_win, row_number() OVER (ORDER BY p_win) AS rn FROM scored)))"""


@query("roc_auc", f"WITH {SCORED_SQL} SELECT round({_AUC_SQL}, 9) AS roc_auc")
def auc_query(spark, sf):
    return metrics.roc_auc(scored(spark, sf), "p_win", "won").select(*_r("roc_auc", digits=9))


@query("reliability_table", f"""WITH {SCORED_SQL}
SELECT concat(b / 10.0, '-', (b + 1) / 10.0) AS bin, count(*) AS n, round(avg(p_win), 6) AS mean_predicted,
  round(avg(won), 6) AS observed, round(avg(p_win) - avg(won), 6) AS gap
FROM (SELECT *, CASE WHEN p_win < 0.1e0 THEN 0 WHEN p_win < 0.2e0 THEN 1 WHEN p_win < 0.3e0 THEN 2
  WHEN p_win < 0.4e0 THEN 3 WHEN p_win < 0.5e0 THEN 4 WHEN p_win < 0.6e0 THEN 5
  WHEN p_win < 0.7e0 THEN 6 WHEN p_win < 0.8e0 THEN 7 WHEN p_win < 0.9e0 THEN 8 ELSE 9 END AS b FROM scored)
GROUP BY b""")
def reliability_query(spark, sf):
    table = metrics.reliability_table(scored(spark, sf), "p_win", "won")
    return table.select("bin", "n", *_r("mean_predicted", "observed", "gap"))


@query("evaluate_bundle", f"""WITH {SCORED_SQL}
SELECT count(*) AS rows, count(DISTINCT race_no) AS races, round(avg(won), 6) AS base_rate,
  round(avg((p_win - won) * (p_win - won)), 6) AS brier, round({_AUC_SQL}, 6) AS roc_auc,
  round(avg(p_win), 6) AS mean_predicted FROM scored""")
def evaluate_query(spark, sf):
    table = metrics.evaluate(scored(spark, sf), "p_win", "won")
    return table.select(
        "rows", "races", *_r("base_rate", "brier", "roc_auc", "mean_predicted")
    )


@query("constant_baseline", f"""WITH {SCORED_SQL}
SELECT round(avg((won - m) * (won - m)), 9) AS brier_constant, round(avg((won - 1.0e0 / 6) * (won - 1.0e0 / 6)), 9) AS brier_uniform
FROM scored, (SELECT avg(won) AS m FROM scored WHERE lane = 1) WHERE lane = 1""")
def baseline_query(spark, sf):
    first = scored(spark, sf).filter(F.col("lane") == 1)
    return metrics.constant_baseline(first, "won").select(
        *_r("brier_constant", "brier_uniform", digits=9)
    )


@query("year_split", f"""WITH {PREPARED_SQL}
SELECT race_no, lane, CASE WHEN race_date < DATE '1999-01-01' THEN 'train' ELSE 'valid' END AS part
FROM prepared WHERE race_date < DATE '2000-01-01'""")
def year_split_query(spark, sf):
    table = members(spark, sf)
    train = splits.years(table, 1995, 1998).withColumn("part", F.lit("train"))
    valid = splits.years(table, 1999, 1999).withColumn("part", F.lit("valid"))
    return train.unionByName(valid).select("race_no", "lane", "part")


@query("walk_forward_folds", f"""WITH {PREPARED_SQL},
counted AS (
  SELECT CAST(y AS INT) AS eval_year, count(*) FILTER (WHERE year(race_date) < y - 1) AS train_rows,
    count(*) FILTER (WHERE year(race_date) = y - 1) AS holdout_rows, count(*) FILTER (WHERE year(race_date) = y) AS rows
  FROM prepared, range(1991, 2002) t(y) GROUP BY y)
SELECT *, CASE WHEN rows = 0 THEN 'no rows to evaluate' WHEN holdout_rows = 0 THEN 'no rows to stop on'
  WHEN train_rows = 0 THEN 'no rows to fit' WHEN train_rows + holdout_rows < 10000 THEN 'fewer than 10000 past rows' END AS skipped
FROM counted""")
def walk_forward_query(spark, sf):
    return splits.walk_forward_folds(members(spark, sf), 1991, 2001)


@query("chrono_split", f"""WITH {PREPARED_SQL},
d AS (SELECT race_date, row_number() OVER (ORDER BY race_date) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT race_date FROM prepared)),
cuts AS (SELECT min(race_date) FILTER (WHERE i = CAST(floor(n * 0.7e0) AS BIGINT)) AS a,
                min(race_date) FILTER (WHERE i = CAST(floor(n * 0.85e0) AS BIGINT)) AS b FROM d)
SELECT CASE WHEN race_date < a THEN 'train' WHEN race_date < b THEN 'valid' ELSE 'test' END AS part,
  count(*) AS n, count(DISTINCT race_date) AS days
FROM prepared, cuts GROUP BY 1""")
def chrono_query(spark, sf):
    table = splits.chronological(members(spark, sf))
    return table.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("race_date").alias("days")
    )
