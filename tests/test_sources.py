"""Fixed-width records, feeds, pages and logs on synthetic input."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from wakeline.functions import text as tx
from wakeline.plans.daily import resolve_venue
from wakeline.plans.ingest import ingest, upsert
from wakeline.schema import PAYOUTS
from wakeline.sources import pages as pg
from wakeline.sources.feeds import parse_card_feed, parse_result_feed, read_feed_files
from wakeline.sources.fixed_width import byte_map, parse_fixed_width, record as record_of, split_lines
from wakeline.sources.price_log import LOG_ORDER, coverage_by_month, log_prices, read_price_logs, recorded_keys
from wakeline.sources.tables import conform, read_table, write_by_year, write_csv

DAY = date(2020, 1, 1)


def cp(text):
    return text.encode("cp932")


# --- fixed width ---------------------------------------------------------------


def test_record_checks():
    assert byte_map(record_of(("b", 4, 2), ("a", 0, 2))) == ["a", "a", None, None, "b", "b"]
    for bad in ([], [("a", 0, 3), ("b", 2, 1)], [("a", 0, 1), ("a", 1, 1)], [("a", -1, 1)], [("a", 0, 0)],
                [("a", 0, 1, "double", {"scale": 0})], [("a", 0, 1, "blob")]):
        with pytest.raises(ValueError):
            record_of(*bad)


LAYOUT = record_of(("lane", 0, 1, "bigint", {"required": True}), ("name", 2, 12),
                   ("rate", 14, 5, "double", {"scale": 100.0}), ("code", 19, 2, "binary"))


def parse(spark, *records):
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(records)], "i INT, line BINARY")
    return parse_fixed_width(df, "line", LAYOUT).orderBy("i").collect()


def test_bytes_not_characters(spark):
    good = b"1 " + cp("山田太郎　　") + b"  612" + b"\x00\xff"
    wide = cp("３") [:2] + cp("木　場　　　") + b"1,200xx"
    a, b = parse(spark, good, wide)
    assert (a["lane"], a["name"], a["rate"], bytes(a["code"])) == (1, "山田太郎", 6.12, b"\x00\xff")
    assert a["errors"] == [] and b["rate"] == 12.0 and b["errors"][0]["field"] == "lane"


def test_bad_fields_are_listed_and_the_rest_kept(spark):
    blank, text, broken, short = parse(
        spark, b"  " + b" " * 12 + b"     zz", b"2 abc         x61 2zz",
        b"3 \x81" + b" " * 10 + b"\x81" + b"  100zz", b"4 tiny",
    )
    assert [(e["field"], e["reason"]) for e in blank["errors"]] == [("lane", "empty")]
    assert blank["rate"] is None and blank["name"] == ""
    assert (text["lane"], text["name"], text["errors"][0]["reason"]) == (2, "abc", "double")
    assert broken["name"] is None and broken["errors"][0]["reason"] == "bytes" and broken["rate"] == 1.0
    assert short["lane"] is None and short["errors"][0]["reason"] == "short"


def test_line_ends(spark):
    payload = b"a\r\nb\rc\n\n   \n  d\xff"
    df = spark.createDataFrame([("f", bytearray(payload))], "source STRING, content BINARY")
    got = [bytes(r["line"]) for r in split_lines(df, "content", keep=["source"]).orderBy("line_no").collect()]
    assert got == [b"a", b"b", b"c", b"  d\xff"]


# --- scalars -------------------------------------------------------------------


def test_scalars(rows):
    df = rows("t STRING", ("1.48.7",), (" .  . ",), ("１.０２.３",))
    assert [r[0] for r in df.select(tx.race_time_seconds(F.col("t"))).collect()] == [108.7, None, 62.3]
    df = rows("t STRING", ("F.01",), ("L.05",), ("0.14",), ("",), ("F",), ("?",))
    got = [tuple(r[0]) for r in df.select(tx.start_timing(F.col("t"))).collect()]
    assert got == [(-0.01, "F"), (None, "L"), (0.14, None), (None, None), (None, "F"), (None, None)]
    df = rows("t STRING", ("01",), ("06",), ("07",), ("K0",), ("",))
    got = [tuple(r[0]) for r in df.select(tx.finish_code(F.col("t"))).collect()]
    assert got == [(1, None), (6, None), (None, "07"), (None, "K0"), (None, None)]
    df = rows("t STRING", ("まくり差し　",), ("まくり",), ("　逃げ",), ("その他",), ("",))
    assert [r[0] for r in df.select(tx.winning_move(F.col("t"))).collect()] == [
        "まくり差し", "まくり", "逃げ", "その他", None]


def test_spine_and_period(spark, rows):
    df = rows("a DATE, b DATE", (DAY, date(2020, 1, 3)))
    assert len(df.select(tx.date_spine(F.col("a"), F.col("b"))).first()[0]) == 3
    with pytest.raises(Exception, match="is before start"):
        df.select(tx.date_spine(F.col("b"), F.col("a"))).collect()
    df = rows("y INT, h INT", (2015, 1), (2015, 2), (2000, 1))
    assert [r[0] for r in df.select(tx.period_key(F.col("y"), F.col("h"))).collect()] == ["fan1410", "fan1504", "fan9910"]


def test_venues(spark):
    assert [resolve_venue(spark, v) for v in ("24", "大村", "ボートレース大村", "大村競艇", "住之江競艇場")] == [24, 24, 24, 24, 12]
    with pytest.raises(ValueError, match="unknown venue"):
        resolve_venue(spark, "25")


# --- feeds -----------------------------------------------------------------------


def card_entry(lane, racer, name="山田太郎", motor=36, boat=37):
    row = (f"{lane} {racer}".encode() + cp(name) + b"37" + cp("長崎") + b"51B1" + b" 5.12" + b" 30.10"
           + b" 4.50" + b" 25.00" + f"{motor:3d}".encode() + b" 33.33" + f"{boat:3d}".encode() + b" 40.00" + b"1 2 3       ")
    return row.ljust(79, b" ")


CARD = b"\r\n".join([
    b"STARTB", b"24BBGN", cp("ボートレース　第　３日"),
    cp("　１Ｒ  一般（Ｂ組）          Ｈ１８００ｍ  電話投票締切予定１５：１５"),
    b"-" * 79, *[card_entry(i, 4000 + i, "林　恵祐" if i == 1 else "山田太郎", motor=30 + i) for i in range(1, 7)],
    cp("　２Ｒ  予選        進入固定  Ｈ１２００ｍ  電話投票締切予定１６：００"),
    card_entry(1, 4100), card_entry(2, 4101)[:46] + b" x5" + card_entry(2, 4101)[49:], card_entry(3, 4102)[:78],
    b"24BEND", b"12BBGN", card_entry(1, 4200), b"12BEND", b"FINALB",
])


def files(spark, **content):
    return spark.createDataFrame([(n, DAY, bytearray(c)) for n, c in content.items()],
                                 "source STRING, day DATE, content BINARY")


def test_card_feed(spark):
    feed = parse_card_feed(files(spark, b200101=CARD, b200102=b""))
    races = {r["race_no"]: r for r in feed.races.collect()}
    assert (races[1]["stadium_id"], races[1]["distance_m"], races[1]["deadline_time"], races[1]["series_day"],
            races[1]["fixed_course"]) == (24, 1800, "15:15:00", 3, False)
    assert races[2]["fixed_course"] and races[2]["distance_m"] == 1200
    entries = {(r["race_no"], r["lane"]): r for r in feed.entries.collect()}
    assert len(entries) == 8
    assert (entries[1, 1]["racer_name"], entries[1, 1]["racer_id"], entries[1, 1]["grade"]) == ("林恵祐", 4001, "B1")
    assert (entries[1, 2]["branch"], entries[1, 2]["weight_kg"], entries[1, 2]["boat_top2_rate"]) == ("長崎", 51.0, 40.0)
    assert entries[2, 2]["motor_no"] is None and entries[2, 2]["racer_id"] == 4101
    out = {r["source"]: r for r in feed.outcomes.collect()}
    assert (out["b200101"]["records_ok"], out["b200101"]["records_failed"]) == (8, 3)
    assert (out["b200101"]["fatal"], out["b200102"]["fatal"]) == (None, "no section")
    assert (out["b200102"]["records_ok"], out["b200102"]["samples"]) == (0, None)
    errors = {(r["code"], r["field"], r["line"][:6]) for r in feed.errors.collect()}
    assert errors == {("no group", None, "1 4200"), ("bigint", "motor_no", "2 4101"), ("short", None, "3 4102")}


def result_row(pos, lane, racer, course, start="  0.14  ", motor=36):
    return (f"  {pos}  {lane} {racer} ".encode() + cp("木　場　　悠　介") + f"{motor:4d}{37:4d}".encode()
            + b"  6.75" + f"{course:>4}".encode() + start.encode() + b"    1.48.7 ")


RESULT = b"\r\n".join([
    b"STARTK", b"24KBGN", cp("   1R       一般（Ｂ組）                 H1800m  晴　  風  北　　 2m  波　  1cm"),
    cp("  着 艇 登番 　選　手　名　　ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸ ﾚｰｽﾀｲﾑ まくり差し"), b"-" * 70,
    *[result_row(f"{i:02d}", lane, 4000 + lane, i, motor=30 + lane) for i, lane in enumerate((4, 1, 2, 3, 5), 1)],
    result_row("F ", 6, 4006, "", "  F.01  "), result_row("06", 6, 4006, 6)[:50], b"",
    cp("        単勝     4          490  "), cp("        複勝     4          200  1          180  "),
    cp("        ２連単   4-1       1210  人気     3 "), cp("        ２連複   4-1        800  人気     2 "),
    cp("        拡連複   4-1        300  人気     1 "), cp("                 2-4        510  人気     7 "),
    cp("                 1-2        420  人気     4 "),
    cp("        ３連単   4-1-2     1730  人気     5 "), cp("        ３連複   4-1-2      990  人気     6 "),
    b"24KEND", b"FINALK",
])


def test_result_feed(spark):
    feed = parse_result_feed(files(spark, k200101=RESULT))
    race = feed.races.first()
    assert (race["race_no"], race["distance_m"], race["weather"], race["wind_direction"], race["wind_speed_m"],
            race["wave_height_cm"], race["decision"]) == (1, 1800, "晴", "北", 2, 1, "まくり差し")
    entries = {r["lane"]: r for r in feed.entries.collect()}
    assert (entries[4]["finish_position"], entries[4]["course"], entries[4]["race_time_sec"],
            entries[4]["exhibition_time"], entries[4]["racer_name"]) == (1, 1, 108.7, 6.75, "木場悠介")
    assert (entries[6]["finish_position"], entries[6]["finish_status"], entries[6]["course"],
            entries[6]["start_timing"]) == (None, "F", None, -0.01)
    paid = {(r["bet_type"], r["combination"]): (r["payout_yen"], r["popularity"]) for r in feed.payouts.collect()}
    assert paid == {
        ("win", "4"): (490, None), ("place", "4"): (200, None), ("place", "1"): (180, None),
        ("exacta", "4-1"): (1210, 3), ("quinella", "1-4"): (800, 2), ("wide", "1-4"): (300, 1),
        ("wide", "2-4"): (510, 7), ("wide", "1-2"): (420, 4), ("trifecta", "4-1-2"): (1730, 5),
        ("trio", "1-2-4"): (990, 6)}
    out = feed.outcomes.first()
    assert (out["records_ok"], out["records_failed"]) == (6, 1)
    assert [(r["code"], r["line"][:13]) for r in feed.errors.collect()] == [("short", "  06  6 4006 ")]


def test_both_feeds_merge_and_replay(spark, tmp_path):
    (tmp_path / "b").mkdir(), (tmp_path / "k").mkdir()
    (tmp_path / "b" / "b200101.txt").write_bytes(CARD)
    (tmp_path / "k" / "k200101.txt").write_bytes(RESULT)
    card, result = (read_feed_files(spark, str(tmp_path / d)) for d in "bk")
    assert card.first()["source"] == "b200101" and card.first()["day"] == DAY
    day = ingest(card, result)
    races = {r["race_no"]: r for r in day.races.collect()}
    assert (races[1]["has_b"], races[1]["has_k"], races[1]["wind_speed_m"]) == (True, True, 2)
    assert (races[2]["has_b"], races[2]["has_k"]) == (True, False)
    first = day.entries.filter("race_no = 1 and lane = 1").first()
    assert (first["racer_name"], first["grade"], first["course"], first["finish_position"]) == ("木場悠介", "B1", 2, 2)
    again = upsert(day, day)
    for name in ("races", "entries", "payouts"):
        a, b = getattr(day, name), getattr(again, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --- pages -------------------------------------------------------------------------


def odds_page(skip=()):
    rows = []
    for second_i in range(5):
        for third_i in range(4):
            cells = ""
            for first in range(1, 7):
                seconds = [x for x in range(1, 7) if x != first]
                second = seconds[second_i]
                third = [x for x in seconds if x != second][third_i]
                if third_i == 0:
                    cells += f'<td class="is-fs14 is-boatColor{second} boatColor" rowspan="4">{second}</td>'
                price = "欠場" if (first, second, third) in skip else f"{first * 100 + second * 10 + third}.5"
                cells += f'<td class="is-boatColor{third} boatColor">{third}</td><td class="oddsPoint">{price}</td>'
            rows.append(f"<tr>{cells}</tr>")
    return "<script>var x='<td class=\"oddsPoint\">9</td>'</script><table><tr><td>1</td></tr>" + "".join(rows) + "</table>"


def test_price_grid(rows):
    df = rows("page STRING, html STRING", ("a", odds_page()), ("b", odds_page({(1, 2, 3)})),
              ("c", "<p>該当するデータがありません</p>"), ("d", "<table><tr><td>x</td></tr></table>"))
    got = pg.price_grid(df, "html", ["page"]).collect()
    a = {r["combination"]: r["odds"] for r in got if r["page"] == "a"}
    assert len(a) == 120 and all(v == int(k.replace("-", "")) + 0.5 for k, v in a.items())
    b = {r["combination"]: r["odds"] for r in got if r["page"] == "b"}
    assert len(b) == 119 and b == {k: v for k, v in a.items() if k != "1-2-3"}
    status = {r["page"]: (r["status"], r["prices"]) for r in pg.page_status(df, "html", ["page"]).collect()}
    assert status == {"a": ("ok", 120), "b": ("ok", 119), "c": ("unavailable", 0), "d": ("empty", 0)}


def test_pre_race_page(rows):
    body = "".join(
        f"<tr><td>{i}</td><td>name</td><td>5{i}.0kg</td><td>6.7{i}</td><td>-0.5</td></tr>" for i in range(1, 7))
    html = (f"<table>{body}</table><h2>スタート展示</h2><span>2</span><span>.27</span> 1 .04 3 .10 4 .11 5 .12 6 .13"
            "<h2>水面気象情報</h2>気温<b>31.0℃</b> 曇り 風速 2m 水温 33.0℃ 波高 1cm")
    df = rows("page INT, html STRING", (1, html), (2, "指定されたレースはありません"))
    c = pg.pre_race_conditions(df, "html", ["page"]).collect()
    assert len(c) == 1 and tuple(c[0])[1:] == (31.0, 33.0, 2.0, 1.0, "曇り")
    m = {r["lane"]: r for r in pg.pre_race_members(df, "html", ["page"]).collect()}
    assert len(m) == 6 and all(r["complete"] for r in m.values())
    assert (m[1]["weight_kg"], m[1]["exhibition_time"], m[1]["tilt"]) == (51.0, 6.71, -0.5)
    assert (m[2]["exhibition_course"], m[2]["exhibition_start"], m[1]["exhibition_course"]) == (1, 0.27, 2)


# --- logs and tables ---------------------------------------------------------------------


def record(n, price=None, **more):
    out = {"k": f"2024-0{1 + n % 2}-05/01/{n}", "d": f"2024-0{1 + n % 2}-05", "j": 1, "r": n, **more}
    if price:
        out["o"] = {"1-2-3": price, "1-3-2": price + 1}
    return json.dumps(out)


def test_price_log(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\n".join([record(1, 10.0), record(1, 11.0), record(2, unavailable="x"), record(3, error="y"), '{"k": "2024', ""]))
    b.write_text("\n".join([record(1, 12.0), record(4, 40.0)]))
    log = read_price_logs(spark, [str(a), str(b)])
    prices = {(r["race_no"], r["combination"]): r["odds"] for r in log_prices(log.records, LOG_ORDER).collect()}
    assert prices == {(1, "1-2-3"): 12.0, (1, "1-3-2"): 13.0, (4, "1-2-3"): 40.0, (4, "1-3-2"): 41.0}
    assert log.quarantine.count() == 1 and recorded_keys(log).count() == 4
    flipped = read_price_logs(spark, [str(b), str(a)])
    assert log_prices(flipped.records, LOG_ORDER).filter("race_no = 1 and combination = '1-2-3'").first()["odds"] == 11.0
    months = coverage_by_month(log_prices(log.records, LOG_ORDER)).collect()
    assert [tuple(r) for r in months] == [(1, 1), (2, 1)]


def test_table_writers(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    write_by_year(rows("race_date DATE, x INT", (date(2020, 1, 1), 1), (date(2021, 1, 1), 2)), path)
    write_by_year(rows("race_date DATE, x INT", (date(2021, 5, 1), 3)), path)
    assert {(r["year"], r["x"]) for r in read_table(spark, path).collect()} == {(2020, 1), (2021, 3)}
    write_csv(rows("a INT, b STRING", (1, "x")), str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("1", "x")]
    typed = conform(rows("race_no BIGINT, combination STRING", (1, "1")), PAYOUTS)
    assert typed.schema["payout_yen"].dataType.simpleString() == "int" and typed.first()["race_no"] == 1
