"""The merge is an aggregate of Spark's own: no call of Python per key, no dependence on arrival."""

import json

import pytest

from wakeline.streaming.keyed_state import Merge, keep, merged_stream, read_state

DDL = "k INT, name STRING, price DOUBLE, seen BOOLEAN, seq BIGINT"


@pytest.mark.parametrize("whole", [True, False])
def test_no_python_runs_per_key(spark, tmp_path, whole):
    stream = spark.readStream.schema(DDL).json(str(tmp_path))
    merge = Merge(["k"], ["seq"], ["name", "price", "seen"], either=[] if whole else ["seen"], whole=whole)
    plan = merged_stream(stream, merge)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "TransformWithState" not in plan


@pytest.mark.parametrize("whole", [True, False])
def test_ties_and_missing_numbers_do_not_depend_on_arrival(spark, tmp_path, whole):
    a = {"k": 1, "name": "a", "price": 2.0, "seen": False, "seq": 1}
    b = {"k": 1, "name": "b", "price": None, "seen": True, "seq": 1}
    nan = {"k": 2, "name": "n", "price": float("nan"), "seen": None, "seq": None}
    merge = Merge(["k"], ["seq"], ["name", "price", "seen"], either=[] if whole else ["seen"], whole=whole)
    for n, order in enumerate(([a, b, nan], [b, nan, a])):
        source, mark = tmp_path / f"in{n}", str(tmp_path / f"mark{n}")
        source.mkdir()
        for i, record in enumerate(order):
            (source / f"{i}.json").write_text(json.dumps(record))
        reader = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("allowNonNumericNumbers", True)
        keep(reader.json(str(source)), merge, mark).awaitTermination()
        found = {tuple(r) for r in read_state(spark, merge, mark).collect()}
        assert found == {(1, "b", None if whole else 2.0, True), (2, "n", None, None)}
