"""Streams that keep their rows in a state store, against the batch result."""

import json
import random

from wakeline.streaming.keyed_state import Merge, keep, read_state

DDL = "k INT, name STRING, price DOUBLE, seen BOOLEAN, seq BIGINT"


def records(n, seed):
    rng = random.Random(seed)
    return [{"k": rng.choice([None, 1, 1, 1, 2, 3]), "name": rng.choice([None, "a", "b"]), "price": rng.choice([None, 1.5, 2.5]),
             "seen": rng.choice([None, True, False]), "seq": seed * 1000 + i} for i in range(n)]


def write(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def newest(rows, whole):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        held = out.setdefault(r["k"], {"name": None, "price": None, "seen": None})
        for c in held:
            if whole:
                held[c] = r[c]
            elif c == "seen":
                held[c] = held[c] if r[c] is None else bool(held[c]) or r[c]
            elif r[c] is not None:
                held[c] = r[c]
    return {(k, *v.values()) for k, v in out.items()}


def run(spark, source, mark, merge):
    keep(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(str(source)), merge, mark).awaitTermination()
    return {(r["k"], r["name"], r["price"], r["seen"]) for r in read_state(spark, merge, mark).collect()}


def test_a_restart_goes_on_from_the_state(spark, tmp_path):
    for whole in (True, False):
        source, mark = tmp_path / f"in{whole}", str(tmp_path / f"mark{whole}")
        source.mkdir()
        merge = Merge(["k"], ["seq"], ["name", "price", "seen"], either=[] if whole else ["seen"], whole=whole, salts=3)
        late, early = records(20, 2), records(20, 1)
        write(source, "a", late)  # what is newest arrives first
        assert run(spark, source, mark, merge) == newest(late, whole)
        write(source, "b", early)
        write(source, "c", [{"k": 9, "name": "x", "seq": 1}])
        everything = [*late, *early, {"k": 9, "name": "x", "price": None, "seen": None, "seq": 1}]
        assert run(spark, source, mark, merge) == newest(everything, whole)
        assert run(spark, source, mark, merge) == newest(everything, whole)  # nothing new
