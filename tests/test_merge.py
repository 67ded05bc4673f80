"""Merges, unions and joins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.operators import merge, quality
from wakeline.operators.asof import asof_join


def as_set(df, *columns):
    return {tuple(r[c] for c in columns or df.columns) for r in df.collect()}


def test_two_feeds(rows):
    card = rows("k INT, title STRING, motor INT", (1, "a", 10), (2, None, None))
    result = rows("k INT, title STRING, motor INT, wind INT", (2, "b", 20, 3), (1, "z", None, 5), (3, "c", 30, 1))
    got = merge.two_feed_merge(card, result, ["k"], card_wins=["title"], result_wins=["motor"])
    assert as_set(got, "k", "title", "motor", "wind", "has_b", "has_k") == {
        (1, "a", 10, 5, True, True), (2, "b", 20, 3, True, True), (3, "c", 30, 1, False, True)}
    with pytest.raises(ValueError, match="no precedence"):
        merge.two_feed_merge(card, result, ["k"])


def test_upsert(rows):
    stored = rows("k INT, a INT, b INT, f BOOLEAN", (1, 1, 1, False), (2, 2, 2, True))
    fresh = rows("k INT, a INT, b INT, f BOOLEAN, n INT", (1, None, None, True, 1), (3, 3, 3, None, 1), (3, None, 4, None, 2))
    once = merge.keyed_merge(stored, fresh, ["k"], order=["n"], replace=["b"], either=["f"])
    want = {(1, 1, None, True), (2, 2, 2, True), (3, 3, 4, False)}
    assert as_set(once) == want
    assert as_set(merge.keyed_merge(once, fresh, ["k"], order=["n"], replace=["b"], either=["f"])) == want


def test_aligned_union(rows):
    history = rows("a INT, b DOUBLE, c STRING", (1, 1.0, "x"))
    got = merge.aligned_union(history, rows("c STRING, a BIGINT, z INT", ("y", 2, 9)))
    assert got.schema == history.schema and as_set(got) == {(1, 1.0, "x"), (2, None, "y")}


def test_latest_and_keys(rows):
    df = rows("k INT, n INT, v STRING", (1, 1, "old"), (1, 2, None), (2, 1, "only"))
    assert as_set(merge.latest_by(df, ["k"], ["n"])) == {(1, 2, None), (2, 1, "only")}
    known = merge.union_keys([df, df], ["k"])
    assert known.count() == 2
    assert as_set(merge.not_recorded(rows("k INT", (1,), (5,)), known, ["k"])) == {(5,)}


def test_visiting_order_is_fixed_and_spread(spark):
    keys = spark.range(2000).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    order = [r["k"] for r in merge.shuffled_prefix(keys, "k").collect()]
    again = [r["k"] for r in merge.shuffled_prefix(keys.orderBy(F.desc("k")), "k", 200).collect()]
    assert order[:200] == again and order != sorted(order)
    assert 700 < sum(int(k[1:]) for k in again) / 200 < 1300
    assert [r["k"] for r in merge.shuffled_prefix(keys, "k", 200, seed=1).collect()] != again


def test_join_guard_and_feed_checks(rows):
    left = rows("k INT, v INT", (1, 1), (2, None), (3, 3))
    right = rows("k INT, v INT", (1, 1), (2, 2), (4, 4))
    assert merge.join_preserving(left, right.withColumnRenamed("v", "w"), ["k"]).count() == 3
    with pytest.raises(ValueError, match="more than one row"):
        merge.join_preserving(left, right.unionByName(right), ["k"])
    assert as_set(merge.feed_disagreements(left, right, ["k"], ["v"])) == {(2, None, 2)}
    assert as_set(merge.key_differences(left, right, ["k"])) == {(3, "left"), (4, "right")}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_asof_join(spark, strict, hot_rows):
    t0 = datetime(2024, 1, 1)
    left = [(i, i % 3, t0 + timedelta(minutes=17 * i)) for i in range(80)]
    right = [(i % 2, t0 + timedelta(minutes=34 * i), i) for i in range(30)]
    ldf = spark.createDataFrame(left, "id INT, k INT, ts TIMESTAMP")
    rdf = spark.createDataFrame(right, "k INT, at TIMESTAMP, v INT")
    got = {r["id"]: r["v"] for r in asof_join(ldf, rdf, ["k"], "ts", "at", ["v"], strict=strict,
                                              hot_rows=hot_rows).collect()}
    for i, k, ts in left:
        seen = [v for rk, at, v in right if rk == k and (at < ts or (at == ts and not strict))]
        assert got[i] == (seen[-1] if seen else None)


def test_parse_accounting(rows):
    ddl = "source STRING, day DATE, records_ok BIGINT, records_failed BIGINT, fatal STRING, samples ARRAY<STRING>"
    from datetime import date

    df = rows(ddl, ("a", date(2015, 1, 1), 1000, 0, None, None), ("b", date(2016, 1, 1), 900, 100, None, ["x"] * 9),
              ("c", date(2017, 1, 1), 0, 0, "gone", None), ("d", None, 5, 0, None, None))
    table = [tuple(r)[:4] for r in quality.parse_stats_by_year(df).collect()]
    assert table == [(2015, False, 1, 0), (2016, False, 1, 0), (2017, False, 1, 1), (None, False, 1, 0), (None, True, 4, 1)]
    suspects = quality.layout_suspects(df).collect()
    assert [(r["year"], r["record_success_rate"], r["is_worst"]) for r in suspects] == [(2016, 0.9, True)]
    samples = quality.parse_samples(df).collect()
    assert sum(r["year"] == 2016 for r in samples) == 5
    assert {r["sample"] for r in samples if r["year"] == 2017} == {"c: gone"}


def test_row_rules(rows):
    df = rows("g INT, lane INT, c INT", (1, 1, 1), (1, 2, 1), (2, 1, None), (2, 2, 9))
    report = {r["rule"]: r["violations"] for r in quality.constraint_report(
        df, {"c": F.col("c").between(1, 6), "lane": F.col("lane") > 0}).collect()}
    assert report == {"c": 1, "lane": 0}
    assert as_set(quality.permutation_violations(df, ["g"], "c", 1, 6), "g") == {(1,), (2,)}
    assert as_set(quality.missing_types(df, ["g"], "lane", [1, 2, 3])) == {(1, "3"), (2, "3")}
    suite = quality.validation_suite({"dup": quality.duplicate_keys(df, ["g"]), "none": df.limit(0)}, hard=("dup",))
    assert as_set(suite) == {("dup", 2, True, False), ("none", 0, False, True)}
    shares = {r["column"]: r["null_share"] for r in quality.null_share(df, ["c", "lane"], 0.01).collect()}
    assert shares == {"c": 0.25}
    steps = quality.decreasing_steps(
        rows("g INT, i INT, v INT, b INT", (1, 1, 5, 0), (1, 2, None, 0), (1, 3, 4, 1), (1, 4, 4, 1)), ["g"], "i", "v", [["b"]], hot_rows=1)
    assert as_set(steps, "i") == {(3,)}


def test_type_counts(rows):
    from wakeline.operators import rules

    paid = rows("race_date DATE, stadium_id INT, race_no INT, bet_type STRING",
                *[(None, 1, n, t) for n, types in ((1, "wwwp"), (2, "wwpp"), (3, "wwwppp")) for t in
                  ({"w": "wide", "p": "place"}[c] for c in types)])
    assert as_set(rules.type_counts(paid), "race_no", "bet_type", "rows") == {(2, "wide", 2), (3, "place", 3)}
