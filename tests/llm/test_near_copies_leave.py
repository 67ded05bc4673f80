"""Removing near copies: texts that stay are not shuffled, and no collision of the bit table removes one."""

from contextlib import contextmanager

import pytest

from wakeline.llm import minhash


@contextmanager
def no_broadcast_by_size(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("bits", [64, minhash.FILTER_BITS])
def test_only_doubtful_texts_are_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    texts = [(i, " ".join(f"w{i // 2 if i < 40 else i}x{k}" for k in range(30)), i) for i in range(120)]
    docs = spark.createDataFrame([*texts, (None, "no id", 1), (7, None, 2)], "doc_id long, text string, word long")
    with no_broadcast_by_size(spark):
        out = minhash.deduplicate(docs)
        shuffles = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines()
                    if "Exchange hashpartitioning(doc_id" in line]
        rows = out.collect()
    gone = set(range(1, 40, 2))
    # 7 is a copy of 6 in one of its rows, which removes the id
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(
        [(False, i) for i in range(120) if i not in gone] + [(True, 0)])
    # the left side of the join lies behind the table's filter
    assert shuffles and "_bits" in out._jdf.queryExecution().executedPlan().toString()
