"""Operators on the bundled tables against plain Python over the same rows."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wakeline.llm import bindings, bpe, counting, minhash, neighbours, packing, pii, tokens, toxicity, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the bundled tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def odd_texts(n):
    rng = random.Random(5)
    letters = "abcdefgh ee's th\n  \t.,12é'ñΣİ"
    wild = [chr(c) for c in range(1, 0x500)] + list("日本語テ🙂한ก")
    return ["".join(rng.choice(letters if i % 3 else wild) for _ in range(rng.randint(0, 90))) for i in range(n)] + [
        "<|endoftext|>a <|startoftext|>", "a" * 5000, "ab" * 3000, "x\x1cy\x85z\xa0w", "é 각"]


def test_codec_equals_library(spark, texts):
    library = Tokenizer.from_file(WORD)
    rows = [*texts.items(), *enumerate(odd_texts(600), 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, WORD).collect()}
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), text
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stream_needs_only_the_lookahead():
    codec = bpe.WordBpe(WORD)
    word = "".join(random.Random(2).choice("theingation") for _ in range(5_000))
    taken, ids = 0, []

    def feed():
        nonlocal taken
        for taken, symbol in enumerate(word):
            yield symbol

    late = 0
    for token in codec.transducer.stream(feed()):
        ids.append(token)
        late = max(late, taken - sum(len(codec.tokens[i]) for i in ids))
    assert tuple(ids) == codec.transducer.encode(word)
    assert late < 6 * codec.transducer.lookahead


def test_byte_text_machine():
    machine, letters = bpe.ByteText(), bpe.byte_symbols()
    data = "é🙂x".encode()
    got = "".join(machine.feed(letters[b]) for b in data) + machine.feed(letters[0xC3]) + machine.feed("a</w>", "</w>") + machine.finish()
    assert got == "é🙂x�a "


def test_byte_ids_equal_library():
    library, ours = Tokenizer.from_file(BYTE), tokens.ByteBpe(BYTE)
    for text in odd_texts(1500):
        assert library.encode(text, add_special_tokens=False).ids == ours.ids(text).tolist()


def test_edited_counts():
    count = tokens.ByteBpe(BYTE).count
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice("abc de's\n \t.,12é") for _ in range(rng.randint(0, 300)))
        tree = counting.CountTree(text, count, rng.choice([1, 4, 16]))
        at = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 4)))
        edits = [(a, b, "".join(rng.choice("ab \n1") for _ in range(rng.randint(0, 4)))) for a, b in zip(at[::2], at[1::2])]
        edited = text
        for a, b, new in reversed(edits):
            edited = edited[:a] + new + edited[b:]
        assert tree.total == count(text)
        tree.apply(edits)
        assert tree.total == count(edited) and "".join(tree.leaves) == edited


def test_packing_equals_library(spark, texts):
    library = Tokenizer.from_file(BYTE)
    got = bindings.op6_packing(spark, SMALL).toPandas()
    for doc_id, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 1024 and sizes.sum() / (1024 * len(sizes)) > 0.97


def test_packing_limits():
    rng = np.random.default_rng(1)
    length, loss = rng.integers(1, 900, 800), rng.integers(0, 400, 800)
    limits = packing.Limits(1024, 3, 450)
    loss = np.minimum(loss, length)
    seen = []
    for rows in packing.fill(length, loss, limits):
        assert length[rows].sum() <= 1024 and loss[rows].sum() <= 450 and len(rows) <= 3
        seen += rows
    assert sorted(seen) == list(range(800))


def brute_groups(texts):
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in bindings.op4_near_duplicates(spark, MIDDLE).collect()}
    expected = brute_groups(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_copies_of_one_text(spark, monkeypatch):
    """A large bucket, cut into pieces, of copies that differ in a few words each."""
    monkeypatch.setattr(minhash, "PIECE", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"n{rng.random()}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_groups(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[100:])
        sig = minhash.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.25 / minhash.PLACES) ** 0.5 * 1.15


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 900), (900, 6), (7, 7)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 900: 5, 6: 5}


def brute_spans(text):
    out = []

    def keep(kind, pattern, good):
        out.extend((kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group()))

    def luhn(s):
        d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
        return 13 <= len(d) <= 19 and sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10

    keep("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    keep("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
    keep("card", r"[0-9]([\x20-]?[0-9])+", luhn)
    keep("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15)
    return out


def test_personal_data(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rng = random.Random(4)
    parts = ["a@b.c", "_x@y.z-1.q", "1.2.3.4", "256.1.1.1", "0010.0.0.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111 1111",
             "+1 (743) 555-3824", "+49..", " ", "@", "é", "\n", "12", "--", "+", "."]
    for i in range(400):
        texts[100_000 + i] = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        spans = brute_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), text
        assert got[i]["n_card"] == sum(k == "card" for k, _, _ in spans)
        assert got[i]["spans"].startswith(line)


def test_contexts_find_unlisted_values(spark):
    rows = [(i, f"thing {i} please call the office: +1 (743) 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "so please call the office: +1 (7x) 555-0000 today"), (51, "an account number: 4512-XK-9981 here")]
    rows += [(60 + i, f"card on file: 41111111111111{n}") for i, n in enumerate(("11", "29", "37", "45", "52", "60", "78"))]
    rows += [(80, "card on file: 4111111111111112"), (81, "lot of file 4111111111111112")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[80] == "context:14:30" and got[51] == ""


def test_contexts_before_whole_values(spark):
    """Seeds of several pieces or without digits teach their contexts; so are unseen values taken whole."""
    rows = [(i, f"thing {i} please call the office: +1 ({300 + i}) 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "so please call the office: +1 (7x) 555-0000 today"), (51, "an account number: 4512-XK-9981 here")]
    rows += [(60 + i, f"so write to our desk: {name}@mail.example or wait") for i, name in enumerate(("ann", "bob", "cy", "di", "ed", "flo", "gus"))]
    rows += [(80, "or write to our desk: jane@localhost now"), (81, "we walked to our desk: slowly and well-known")]
    rows += [(82, "so please call the office: 5550001 10.0.0.1 today")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "context:27:43" and got[51] == "" and got[80] == "context:22:36" and got[81] == ""
    assert got[82] == "ip:35:43,context:27:34"


def test_toxicity_on_held_out(spark):
    got = bindings.op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / (n.get((0, 1), 0) + n.get((0, 0), 0)) < 0.02


def test_swapped_groups_score_alike():
    rng = random.Random(1)
    neutral = [" ".join(rng.choice("ab cd ef gh ij kl mn women".split()) for _ in range(30)) for _ in range(60)]
    toxic = [" ".join(rng.choice("ab cd ef gh ij muslims idiot idiot".split()) for _ in range(30)) for _ in range(60)]
    model = toxicity.fit(neutral + toxic, [0] * 60 + [1] * 60)
    plain = model.score("muslims ab cd")
    assert abs(plain - model.score("christians ab cd")) < 0.1 and plain < 0.5 and model.score("you idiot") > 0.5


def test_late_words_of_long_texts_are_learned():
    many = " ".join(f"a{i}" for i in range(5_000))
    model = toxicity.fit([many] * 30 + [f"{many} zzidiot дурак"] * 30, [0] * 30 + [1] * 30)
    assert model.weights["zzidiot"] > 0 and model.weights["дурак"] > 0


def test_recall_of_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in bindings.op1_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits, total = hits + len(best & {m[1] for m in mine}), total + 20
    assert hits / total >= 0.9


def test_neighbours_of_unequal_lengths_and_many_parts(spark, monkeypatch):
    for name, value in (("PART_ROWS", 64), ("QUERY_ROWS", 8), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8)) * rng.uniform(0.1, 3, (900, 1))
    x[300:600] = x[300]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(docs, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = 0
    for i in range(0, 900, 20):
        scores = (x * x[i]).sum(axis=1)
        scores[i] = -np.inf
        hits += len(set(np.lexsort((np.arange(900), -scores))[:5].tolist()) & {v for _, v in got[i]})
    assert hits / (45 * 5) >= 0.9


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_round_trip(version):
    rows = [(1, "http://a/", b"x\n\nURL 1 2 3 4\n"), (None, None, b""), (3, "http://b c", "é".encode() * 50)]
    records = list(warc.read_arc(warc.write_arc(rows, version)))
    assert [warc.split_http(c)[2] for _, c in records] == [p for _, _, p in rows]
    assert records[0][0]["URL"] == "http://a/" and records[0][0]["Archive-date"] == "20000101000000"
    assert list(warc.read_arc(b"")) == [] and list(warc.read_arc(b"no archive\n")) == []
    assert warc.warc_date("19961231235959") == "1996-12-31T23:59:59Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    state = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in state.collect()}
        out = stage(spark, state, MIDDLE)
        out.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert set(r["doc_id"] for r in state.collect()) == set(before)
            continue
        assert state.schema.names == docs.schema.names
        after = {r["doc_id"]: r["text"] for r in state.collect()}
        if name == "near_duplicates":
            groups = brute_groups(before)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "personal_data":
            assert set(after) == set(before)
            assert all((after[i] == t) or brute_spans(t) or "<CONTEXT>" in after[i] for i, t in before.items())
            assert not any(re.search(r"<EMAIL>@|[a-z]@mail", t) for t in after.values())
        if name == "quality":
            assert all(len(t.split()) >= 50 for t in after.values()) and len(after) > 0.5 * len(before)
    whole = corpus_pipeline.run(spark, MIDDLE)
    assert whole.select(F.sum("length"), F.count("*")).first() == state.select(F.sum("length"), F.count("*")).first()
