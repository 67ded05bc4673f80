"""Exact top-k, filter audit and conversation repair against plain Python, and their edge cases."""

import hashlib
import heapq
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import audit, pivots, repair

def search(df, **options):
    return pivots.search(df, F.col("vec_id") % 20 == 0, **options)


def best_by_hand(vectors, k=20):
    """(query_id, rank, vec_id, score) over all pairs, in Python integers."""
    whole = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in vectors.items()}
    out = []
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(spark, vectors):
    data = [(i, [float(x) for x in v], "v", 1.0, [1.0]) for i, v in vectors.items()]
    # names that the operator uses inside
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, v string, far double, x array<double>")


def result(df):
    return sorted(map(tuple, df.collect()))


def test_topk_is_exact_whatever_the_rings(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8)) * 3
    vectors = {i: centres[i % 6] + 0.1 * rng.standard_normal(8) for i in range(400)}
    vectors |= {i: [1, 2, 3, 0, 0, 0, 0, 0] for i in range(400, 500)}  # ties
    vectors |= {500: [-1.5], 501: [], 520: [0.0] * 8}
    df = vectors_of(spark, vectors)
    want = best_by_hand(vectors)
    assert result(search(df)) == want
    assert result(search(df, ring_rows=100, query_rows=9)) == want


def test_topk_stops_early_where_the_data_allow_it():
    """Far clusters are ruled out, and nothing that belongs to the answer is."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 6))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(np.repeat(centres, 600, axis=0) + 2 * rng.standard_normal((4800, 6)))
    ids, largest = np.arange(len(x)), float((x * x).sum(axis=1).max())
    pivot = pivots.lifted(x, largest)[:1]
    far = pivots.distances(pivots.lifted(x, largest), pivot)[:, 0]
    queries = x[:10] * 1.0
    from_pivot = pivots.distances(np.column_stack([queries, np.zeros(10)]), pivot)[:, 0]
    floors, met = np.full(10, pivots.LONG_MIN), []
    q, v, s = pivots.search_part(ids, x, far, ids[:10], queries, from_pivot, floors, 5, largest, met)
    scores = (queries @ x.T).astype(int)
    for i in range(10):
        scores[i, i] = -10 ** 12
        order = np.lexsort((ids, -scores[i]))[:5]
        assert list(v[q == i]) == list(order) and list(s[q == i]) == list(scores[i][order])
    assert sum(met) < 0.7 * 10 * len(x)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.5]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, []), (10, [-0.001, 0.0]), (11, [1e308, 1.0])]  # the last is not finite times 64
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(search(df))
    assert got == [(20, r + 1, i, s) for r, (i, s) in enumerate(
        [(1, 4096), (2, 4096), (8, 2048), (3, 0), (9, 0), (10, -64)])]
    assert search(df.limit(0)).collect() == []
    assert search(df.filter("vec_id = 20")).collect() == []
    # beyond exact doubles, and beyond a long, where scores stop
    big = spark.createDataFrame([(0, [2.0 ** 21, 1.0]), (1, [2.0 ** 21, 3.0]), (2, [2.0 ** 20, 1.0]), (3, [1e200]), (4, [-1e200])],
                                "vec_id long, embedding array<double>")
    assert [r[2:] for r in result(search(big))] == [
        (3, 2 ** 63 - 1), (1, 2 ** 54 + 3 * 4096), (2, 2 ** 53 + 4096), (4, -2 ** 63)]


WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def audit_by_hand(documents, labels):
    """Every order applied to every document, one filter after another."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    texts = {}
    for d, text, _ in documents:
        texts.setdefault(text or "", []).append(d)
    rows = []
    for d, text, source in documents:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": d is not None and any(o is not None and o < d for o in texts[text])}
        rows.append((source or "", {f for f, bad in fails.items() if bad}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = [next((i for i, f in enumerate(order) if f in r[1]), 9) for r in mine]
            for i, f in enumerate(order):
                here = [r for r, g in zip(mine, gone) if g == i]
                total[f] += len(here)
                out[part, "".join(order), i + 1] = [
                    sum(g > i for g in gone), len(here), sum(g < i and f in r[1] for r, g in zip(mine, gone)),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_against_all_orders(spark):
    rng = random.Random(4)
    shared = ["same", "", " ".join(WORDS * 20)]
    documents = [(i, rng.choice([None, *shared]) if rng.random() < 0.3 else
                  " ".join(rng.choice([*WORDS[:rng.randint(1, 13)], f"x{rng.random()}", "A" * rng.randint(1, 9), "50%\x1cz"][: rng.randint(1, 16)])
                           for _ in range(rng.choice([3, 199, 200, 300]))), rng.choice(["a", "b", "b", None, ""])) for i in range(120)]
    documents += [(None, "same", "a"), (None, "only here", "c"), (7, documents[7][1], "b"), (200, "y " * 40_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "p", 3) for d in documents], "doc_id long, text string, source string, mask int, part string, good int")
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()}
    assert got == audit_by_hand(documents, labels)
    assert audit.audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shapley_solves_the_game(n):
    """The least-squares solution is the mean gain over all orders."""
    weights, rng = audit.shapley_weights(n), random.Random(n)
    value = [0] + [rng.randint(-99, 99) for _ in range((1 << n) - 1)]
    orders = list(itertools.permutations(range(n)))
    for i in range(n):
        gains = [value[(b := sum(1 << f for f in o[:o.index(i)])) | 1 << i] - value[b] for o in orders]
        assert sum(w * v for w, v in zip(weights[i], value)) == Fraction(sum(gains), len(orders))


MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repair_by_hand(rows, insert=5):
    """Cheapest edits by Dijkstra's algorithm over (cost, edits) from the front."""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, edits, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        for role in ("user", "assistant"):
            if role[0] in MOVES[state]:
                heapq.heappush(heap, (cost + insert, edits + "I", i, MOVES[state][role[0]], (*lines, role + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, lines))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] else 0
                to = state if not role else MOVES[state].get(role[0])
                if to is not None:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, to, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in MOVES[state]:
                        heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, MOVES[state][new[0]], (*lines, f"{new}:{text}")))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TURN = "conv_id long, turn long, role string, text string, copies int, block long, fault int, edits string"


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_repair_against_dijkstra(spark, block_rows):
    rng = random.Random(block_rows)
    data = []
    for conv in range(250):
        for _ in range(rng.randint(1, 12)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", "", None, "useless"])
            text = rng.choice(["", " \t", "a.", "b", "c!\n", None, f"{rng.random()}.", f"{rng.random()}?", f"{rng.random()}."])
            data.append((conv, rng.choice([None, *range(9)]), role, text, rng.choice([1, 1, 1, 1, 2, 3, 0])))
    data += [(None, 1, "user", "hi.", 1), (None, 2, "assistant", "x" * 200_000 + ".", 1), (-1, 0, "user", "gone", 0)]
    data += [(-2, t, "user", "said often.", 1) for t in range(60)]
    df = spark.createDataFrame([(*r, 5, 6, "e") for r in data], TURN)
    want = {}
    for conv, turn, role, text, copies in data:
        want.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    want = {c: repair_by_hand(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, rows in want.items()}
    made = repair.repair(df, block_rows)
    got = {r[0]: tuple(r)[1:] for r in repair.digests(df, made).collect()}
    assert got == want
    assert got[-1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    # the repaired rows themselves give the digest
    lines = {}
    for r in sorted(repair.repaired_turns(df, made).collect(), key=lambda r: (r["block"], r["position"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in lines.items()} == {
        c: w[7] for c, w in want.items() if c in lines}


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], TURN)
    assert repair.digests(none, repair.repair(none)).collect() == []
    assert repair.repair(repair.damaged(none)).collect() == []


def test_walk_keeps_only_checkpoints():
    rng = random.Random(1)
    rows = [(rng.randint(0, 4), rng.choice([0, 0, 3]), 1) for _ in range(1000)]
    kept = repair.checkpoints(rows, list(repair.END))
    assert len(kept) <= 34
    edits, state, cost = repair.walk(rows, list(repair.END), 0, kept, True)
    assert state in repair.ACCEPTED and cost == kept[0][0]
    through = repair.costs_through(rows[:400]), repair.costs_through(rows[400:])
    assert repair._ends(through[0], repair._ends(through[1], list(repair.END))) == kept[0]


def test_insertions_where_they_are_cheap(monkeypatch):
    """At the given costs a deletion is always cheaper; at these it is not."""
    monkeypatch.setattr(repair, "INSERT", 1)
    end, rng, all_edits = [0, 2, 1, 0], random.Random(8), ""
    for _ in range(300):
        rows = [(0, rng.choice(["system", "user", "assistant", "x", ""]), f"{i}" + rng.choice(["", "."])) for i in range(rng.randint(0, 6))]
        codes = [(repair.INITIAL.get(r[:1], 0), 0 if text[-1] == "." else repair.CUT_OFF, 1) for _, r, text in rows]
        kept = repair.checkpoints(codes, end)
        edits, _, cost = repair.walk(codes, end, 0, kept, True)
        assert (cost, edits) == repair_by_hand(rows, insert=1)[5:7]
        all_edits += edits
    assert set(all_edits) == set("DIKR")
