"""Streams against the batch result."""

import json

from wakeline.sources.price_log import LOG_ORDER, log_prices, read_price_logs
from wakeline.streaming.merge_stream import feed_stream, price_log_stream, read_snapshot


def line(n, price):
    return json.dumps({"k": str(n), "d": "2024-05-01", "j": 1, "r": n, "o": {"1-2-3": price}})


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_price_stream_equals_batch(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.jsonl").write_text(line(1, 1.0) + "\n" + line(2, 2.0) + "\n{broken")
    price_log_stream(spark, str(source), out, mark).awaitTermination()
    assert as_set(read_snapshot(spark, out), "race_no", "odds") == {(1, 1.0), (2, 2.0)}
    (source / "b.jsonl").write_text(line(1, 9.0) + "\n" + line(3, 3.0))
    price_log_stream(spark, str(source), out, mark).awaitTermination()
    price_log_stream(spark, str(source), out, mark).awaitTermination()  # nothing new
    log = read_price_logs(spark, [str(source / "a.jsonl"), str(source / "b.jsonl")])
    batch = log_prices(log.records, LOG_ORDER)
    keys = ("race_date", "stadium_id", "race_no", "combination", "odds")
    assert as_set(read_snapshot(spark, out), *keys) == as_set(batch, *keys)
    assert as_set(batch, "race_no", "odds") == {(1, 9.0), (2, 2.0), (3, 3.0)}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    source.mkdir()

    def day(n, d, price):
        return json.dumps({"k": str(n), "d": f"2024-05-0{d}", "j": 1, "r": n, "o": {"1-2-3": price}})

    def versions(d):
        return sorted(p.name for p in (out / f"_part=2024-05-0{d}").iterdir())

    for i, texts in enumerate([[day(1, 1, 1.0), day(1, 2, 2.0)], [day(2, 2, 3.0)], [day(3, 2, 4.0)], [day(1, 2, 5.0)]]):
        (source / f"{i}.jsonl").write_text("\n".join(texts))
        price_log_stream(spark, str(source), str(out), mark).awaitTermination()
    assert versions(1) == ["_v=0"] and versions(2) == ["_v=2", "_v=3"]
    assert as_set(read_snapshot(spark, str(out)), "race_no", "odds") == {(1, 1.0), (1, 5.0), (2, 3.0), (3, 4.0)}
    assert as_set(read_snapshot(spark, str(out), before=3), "race_no", "odds") == {(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)}


DDL = "k INT, title STRING, wind INT, has_b BOOLEAN, has_k BOOLEAN, seq BIGINT"


def feed_result(spark, tmp_path, name, files):
    source = tmp_path / f"{name}-in"
    source.mkdir()
    out, mark = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-mark")
    for i, rows in enumerate(files):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(DDL).json(str(source))
        feed_stream(stream, out, mark, ["k"], order=["seq"]).awaitTermination()
    return as_set(read_snapshot(spark, out), "k", "title", "wind", "has_b", "has_k")


def test_late_result_feed_in_either_order(spark, tmp_path):
    card = [{"k": 1, "title": "a", "has_b": True, "seq": 1}, {"k": 2, "title": "b", "has_b": True, "seq": 1}]
    result = [{"k": 1, "wind": 3, "has_k": True, "seq": 2}]
    want = {(1, "a", 3, True, True), (2, "b", None, True, False)}
    assert feed_result(spark, tmp_path, "x", [card, result]) == want
    assert feed_result(spark, tmp_path, "y", [result, card]) == want
