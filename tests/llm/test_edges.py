"""Every operator on nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import bpe, chat, counting, minhash, neighbours, packing, pii, quality, toxicity, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "one two three four " * 6_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, doc string, bucket int, _found string"
ROWS = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (5, LONG),
        (None, "a text without id, call +1 (743) 555-3824"), (7, "alpha beta gamma delta epsilon zeta"), (8, "x" * 30_000),
        (None, None), (9, "me@example.com 10.0.0.1, 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, None, None, None, 1, "d", 2, None) for i, t in ROWS]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, toxic int, quality int"
OPERATORS = {
    "count": lambda d: counting.count_tokens(d.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>")), BYTE),
    "assess": quality.assess,
    "near": minhash.near_duplicates,
    "codec": lambda d: bpe.encode_decode(d, WORD),
    "toxic": lambda d: toxicity.score(d, toxicity.train(d, d.sparkSession.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1)], LABELS))),
    "pii": pii.find,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_for_each_row_in(docs, name):
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


def test_packing_holds_every_id_once(docs, none):
    got = packing.pack_documents(docs, BYTE).toPandas()
    tokens = got.groupby(got["doc_id"].fillna(-1))["length"].sum()
    assert tokens[2] == tokens[3] == 1 and tokens[5] == 2 * got[got.doc_id == 5]["doc_tokens"].iloc[0]
    filled = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (filled["length"].sum() <= 1024).all()
    assert all((g["offset"].to_numpy() == g["length"].cumsum().to_numpy() - g["length"].to_numpy()).all() for _, g in filled)
    assert packing.pack_documents(none, BYTE).collect() == []


def test_filters_keep_the_columns(docs, none):
    labels = docs.sparkSession.createDataFrame([(1, 0, 0), (9, 0, 0)], LABELS)
    for made, empty in ((toxicity.remove_toxic(docs, labels), toxicity.remove_toxic(none, labels)),
                        (quality.select(docs), quality.select(none)),
                        (minhash.deduplicate(docs), minhash.deduplicate(none)),
                        (pii.redact(docs), pii.redact(none))):
        assert made.schema.names == docs.schema.names and empty.collect() == []
        made.collect()


def test_deduplicate(docs):
    kept = [r["doc_id"] for r in minhash.deduplicate(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 5, None, 8, None, 9]))


def test_redaction(docs):
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["doc_id"]}
    assert text[9] == "<EMAIL> <IP>, <CARD>" and text[2] is None and text[5] == LONG


def test_many_values_in_one_text(spark):
    text = "id 4711-0815 x " * 6_000 + "a@b.cd " * 4_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(docs).first()
    assert row["n_email"] == 4_000 and row["spans"].endswith(f"email:{len(text) - 7}:{len(text) - 1}")


def test_chat_edges(spark):
    turns = spark.createDataFrame(
        [(1, None, None, None), (1, 0, "assistant", None), (None, 3, "user", "q"), (2, 1, "a\nb<|", "x&a&l\n<|im_end|>\n"),
         (2, 1, "a\nb<|", "x&a&l\n<|im_end|>\n")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.parse(chat.format_turns(turns.withColumn("parts", chat.text_part(F.col("text"))))).collect()}
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == 2 * [("a\nb<|", "x&a&l\n<|im_end|>\n")]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("assistant", "")]
    assert got[None]["loss_texts"] == []


def test_chat_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 3), (None, "and", None, None), ("audio", None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                                  f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_turns(turns).first()
    assert row["formatted"] == "<|im_start|>user\nsee &limage|> <|image|>and<|audio|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 595), ("audio", None, 29)]


def test_warc_edges(spark, tmp_path):
    html = "<p>" + "é" * 60 + "\r\n\r\nWARC/1.0\r\n"
    pages = spark.createDataFrame([(3, "http://a b/ü", html), (2, None, html), (5, "u", "short"), (6, "u", "short"), (7, "u", None),
                                   (None, "u", html), (2, "u", html)], "page_id long, url string, html string")
    warc.write_warc(warc.revisits(warc.convert(warc.to_archives(pages))), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((str(r["source"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted([
        ("3", len(html.encode()), "revisit", 2), ("2", len(html.encode()), "response", None), ("2", len(html.encode()), "response", None),
        ("None", len(html.encode()), "revisit", 2), ("5", 5, "response", None), ("6", 5, "response", None), ("7", 0, "response", None)])
    assert {r["url"] for r in got} >= {"http://a b/ü", "urn:unknown", "u"}
    empty = warc.to_archives(pages.limit(0))
    assert warc.convert(empty).collect() == [] and warc.revisits(warc.convert(empty)).collect() == []


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.5]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 8, 0.5)]
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_pipeline_stages_chain(docs, none, spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (8, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.schema.names == docs.schema.names, name
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
