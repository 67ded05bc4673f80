"""Near-duplicate groups of texts: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives every element one random permutation of the signature's places and one random
number per rank; place i keeps the smallest rank + number that meets it. The ranks of one element
are correlated (each is used once), which lowers the variance, and once every place holds a value
below rank j no later rank can matter, so the work stops early. Here all elements of a batch of
documents go through rank 0, then rank 1 and so on together, and a document leaves when it is done.

Texts with equal shingle sets are merged first. Distinct sets that agree in a band share a bucket.
Inside a bucket, signatures choose a spanning forest of likely pairs, which is verified on full
shingle sets; in buckets whose members then lie in different groups, the likely pairs between
groups are verified in place, and only links that join groups come out. So a bucket of n near
copies gives about n pairs, and no link that the bucket shows is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_batches, map_rows, text_or_empty
from wakeline.session import staged

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Places of a signature. 32 bands of 4 miss a pair at similarity 0.75 with 5 in a million.
PLACES, BAND_ROWS = 128, 4
BANDS = PLACES // BAND_ROWS
#: Share of equal places from which a pair is worth verifying; 5 standard deviations below 0.75.
LIKELY = 0.55
#: Members of a bucket compared in one piece; larger buckets are cut and meet piece by piece.
PIECE = 512
#: Shingles hashed together.
BATCH_SHINGLES = 40_000
#: Size of the table that keeps most unneeded texts from being hashed again (bits, fixed).
FILTER_BITS = 1 << 23

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole, if it has fewer words."""
    parts = text.encode("utf-8").translate(_LOWER).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    rolled = np.full(n, width, dtype=np.uint64)  # the width keeps short wholes apart
    for k in range(width):
        rolled = _mix(rolled * _GOLDEN + hashes[k:k + n])
    return np.unique(rolled)


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each (non-empty) set: rank in the high byte, 24 random bits below."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    best = np.full((len(sets), places), np.uint32(0xFFFFFFFF))
    steps = np.arange(1, places + 1, dtype=np.uint64) * _GOLDEN
    order = np.tile(np.arange(places, dtype=np.uint8), (len(seed), 1))  # the permutations so far
    for rank in range(places):
        # documents whose places all hold smaller ranks are done
        active = (best >> np.uint32(24)).max(axis=1) >= rank
        keep = active[owner]
        if not keep.all():
            owner, seed, order = owner[keep], seed[keep], order[keep]
        if not len(seed):
            break
        number = _mix(seed + steps[rank])
        rows = np.arange(len(seed))
        # step of a Fisher-Yates shuffle: a place not used yet
        other = rank + ((number >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        place = order[rows, other]
        order[rows, other] = order[:, rank]
        value = np.uint32(rank << 24) | (number & np.uint64(0xFFFFFF)).astype(np.uint32)
        np.minimum.at(best.reshape(-1), owner * places + place, value)
    return best


def _batches(sets: list[np.ndarray]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, s in enumerate(sets):
        if len(s):
            if part and size + len(s) > BATCH_SHINGLES:
                yield part
                part, size = [], 0
            part.append(i)
            size += len(s)
    if part:
        yield part


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (one byte per place), bands (hash of each band).

    Null and blank texts have no shingles, and null set_key, sig and bands.
    """

    def make():
        def work(columns):
            sets = [shingles(t) for t in columns[1]]
            keys: list = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            sigs: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            for part in _batches(sets):
                found = signatures([sets[i] for i in part])
                grouped = found.reshape(len(part), BANDS, BAND_ROWS).astype(np.uint64)
                folded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(part), BANDS))
                for k in range(BAND_ROWS):
                    folded = _mix(folded * _GOLDEN + grouped[:, :, k])
                for i, sig, band in zip(part, found.astype(np.uint8), folded.view(np.int64)):
                    sigs[i], bands[i] = sig.tobytes(), band
            return [columns[0], [len(s) for s in sets], keys, sigs, bands]

        return work

    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), make,
                    "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _agreement(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sig == one).sum(axis=1)


def _forest(sig: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs that are likely enough (Prim's method)."""
    n, least = len(sig), LIKELY * sig.shape[1]
    waiting = np.ones(n, dtype=bool)
    best, via = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    edges, at = [], 0
    for _ in range(n):
        waiting[at] = False
        near = _agreement(sig, sig[at])
        closer = waiting & (near > best)
        best[closer], via[closer] = near[closer], at
        rest = np.where(waiting, best, -1)
        at = int(np.argmax(rest))
        if rest[at] >= least:
            edges.append((int(via[at]), at))
        if rest[at] < 0:
            break
    return edges


def _similar_sets(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, by their full contents."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _bridges(sig: np.ndarray, group: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different groups, verified; one for each two groups that become one.

    Every likely pair is either verified or already in one group.
    """
    root = {g: g for g in group}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    least, links = LIKELY * sig.shape[1], []
    for i in range(len(sig) - 1):
        near = _agreement(sig[i + 1:], sig[i])
        likely = np.flatnonzero(near >= least)
        for j in likely[np.argsort(-near[likely], kind="stable")] + i + 1:
            a, b = find(group[i]), find(group[j])
            if a != b and _similar_sets(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def _crossing(sig: np.ndarray, group: list[int]) -> np.ndarray:
    """Which members have a likely partner in another group."""
    groups, least = np.asarray(group), LIKELY * sig.shape[1]
    crossing = np.zeros(len(sig), dtype=bool)
    for i in range(len(sig) - 1):
        likely = (_agreement(sig[i + 1:], sig[i]) >= least) & (groups[i + 1:] != groups[i])
        crossing[i + 1:] |= likely
        crossing[i] |= likely.any()
    return crossing


def _in_buckets(members: DataFrame, columns: list[str], judge: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``judge(key, ids, *columns)`` of every (bucket, piece) of rows (bucket, piece, doc, columns).

    A (bucket, piece) holds at most about 2 * PIECE rows; rows stream through, sorted, and one
    (bucket, piece) is held at a time. The first column is the signature.
    """
    out = pa.schema([(field.split()[0], pa.int64()) for field in schema.split(",")])
    names = ["bucket", "piece", "doc", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, found = None, []

        def close() -> None:
            if len(held) > 1:
                ids, sig, *more = zip(*held)
                found.extend(judge(key, ids, np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(held), -1), *more))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(out))], schema=out)

        for batch in batches:
            rows = [[x.values.to_numpy() for x in batch.column(i)] if name == "shingles" else batch.column(i).to_pylist()
                    for i, name in enumerate(names)]
            for bucket, piece, *rest in zip(*rows):
                if key != (bucket, piece):
                    close()
                    held, key = [], (bucket, piece)
                    if len(found) > 10_000:
                        yield batch_of(found)
                        found = []
                held.append(rest)
        close()
        yield batch_of(found)

    dealt = members.select(names).repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "doc")
    return map_batches(dealt, run, schema)


def _pairs_of(ids: tuple, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs if ids[i] != ids[j]]


def _likely_forest(members: DataFrame) -> DataFrame:
    """(a, b): a forest of likely pairs of each bucket."""
    return _in_buckets(members, ["sig"], lambda key, ids, sig: _pairs_of(ids, _forest(sig)), "a long, b long").distinct()


def _links_between(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links between groups, from rows with their group.

    Signatures alone tell which members have a likely partner in another group; only these are
    met again with their shingles.
    """
    crossing = _in_buckets(
        members, ["sig", "group"],
        lambda key, ids, sig, group: [(*key, ids[i]) for i in np.flatnonzero(_crossing(sig, group))],
        "bucket long, piece long, doc long")
    place = ["bucket", "piece", "doc"]
    met = members.join(crossing.distinct(), place, "left_semi").join(texts, "doc")
    return _in_buckets(met, ["sig", "group", "shingles"],
                       lambda key, ids, sig, group, sets: _pairs_of(ids, _bridges(sig, list(group), list(sets))),
                       "a long, b long").distinct()


def _buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of two-member buckets, and (bucket, doc, size) of larger ones.

    Equal sets of members that several bands show are kept once.
    """
    rows = reps.select("doc", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("doc").alias("a"), F.max("doc").alias("b"),
        F.expr("bit_xor(xxhash64(doc))").alias("print"), F.expr("bit_xor(xxhash64(doc, 7))").alias("print2"))
    sizes = staged(sizes.filter("size > 1"), "buckets")
    pairs = sizes.filter("size = 2").select("a", "b").distinct()
    larger = sizes.filter("size > 2").groupBy("size", "print", "print2").agg(F.min("bucket").alias("bucket"))
    return pairs, rows.join(larger.select("bucket", "size"), "bucket")


def _pieces(members: DataFrame) -> DataFrame:
    """Cut buckets of more than PIECE members into parts and let every two parts meet."""
    parts = F.ceil(F.col("size") / PIECE).cast("int")
    mine = F.pmod(F.xxhash64("doc", "bucket"), parts).cast("int")
    other = F.explode(F.when(parts == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda o: o != F.col("mine"))))
    return (members.withColumn("mine", mine).withColumn("other", other)
            .withColumn("piece", F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")))


def _table_of(ids: DataFrame) -> DataFrame:
    """(word, bits): a bit table of fixed size in which the slot of each id (column doc) is set."""
    slots = ids.select(F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)).alias("slot"))
    return slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone`` (column doc); rows with a null doc_id leave as well.

    Texts whose slot of the bit table is clear stay where they are. Only the others, the texts to
    be removed and a few more, are shuffled to meet the ids.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    # at most FILTER_BITS / 64 rows are sent
    table = F.broadcast(staged(_table_of(gone).toDF("_word", "_bits"), "table"))
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn("_slot", slot)
    tested = known.join(table, F.floor(F.col("_slot") / 64) == F.col("_word"), "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_slot % 64 as int)) & 1L, 0L) = 1L")
    doubtful = tested.filter(hit).join(gone.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti")
    return tested.filter(~hit).select(docs.columns).unionByName(doubtful.select(docs.columns))


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, shingles) of the rows whose id is in ``ids`` (column doc).

    A bit table of fixed size spares most other texts; the join that follows makes it exact.
    """
    words = _table_of(ids)
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        table[row["word"]] = row["bits"]
    held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    def make():
        bits = held.value

        def work(columns):
            out = [[], []]
            for doc, slot, text in zip(*columns):
                if bits[slot >> 3] >> (slot & 7) & 1:
                    out[0].append(doc)
                    out[1].append(shingles(text).view(np.int64))
            return out

        return work

    rows = docs.select(F.col("doc_id").alias("doc"), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot"),
                       text_or_empty().alias("text")).filter(F.col("doc").isNotNull())
    return map_rows(rows, make, "doc long, shingles array<long>").join(ids, "doc", "left_semi")


def _similar(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= PERCENT * (F.size(a) + F.size(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.filter(_similar(F.col("sa"), F.col("sb"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): smallest id reachable, for all ends of ``edges`` (a, b).

    Union-find as alternating star contraction: every round links each node's neighbours to the
    smallest of them, first the larger neighbours, then the smaller, and writes the new edges.
    It ends when all edges lead straight to the roots, after a number of rounds that is
    logarithmic in the longest chain. Only the count of edges reaches the driver.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # u keeps its smallest neighbour, or itself
            least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            moved = edges.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")
            return moved.filter(F.col("a") != F.col("b")).distinct()
        # b is linked to its smallest neighbour, and the other smaller ones to that
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b")
        return (moved.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            moved.select(F.col("m").alias("a"), "b")).filter(F.col("a") != F.col("b")).distinct())

    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter(F.col("a") != F.col("b")).distinct(), "edges")
    while True:
        after = staged(star(star(edges, True), False), "edges")
        stars = after.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
        chained = after.select("b").join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if (stars.first()["n"] or 1) == 1 and not chained.take(1):
            break
        edges = after
    leaves = after.select(F.col("b").alias("doc"), F.col("a").alias("component"))
    roots = after.select(F.col("a").alias("doc"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Words are runs of other than ASCII white space, with A-Z in lower case; a text of fewer than
    five words is one shingle. Null and blank texts have no shingles and are linked with nothing.
    component_id is the smallest doc_id reachable over links, kept says whether it is the row's
    own. Rows that repeat a doc_id count as one document, and links are those of one of its texts;
    a null doc_id forms a component of its own and is kept. Other columns are ignored.
    """
    sketches = staged(sketch(docs), "sketches")
    filled = sketches.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # the smallest id stands for all texts with the same set
    sets = staged(filled.groupBy("set_key").agg(F.min("doc_id").alias("doc")), "sets")
    one = sets.groupBy("doc").agg(F.min("set_key").alias("set_key"))
    reps = (filled.join(one, "set_key").filter(F.col("doc_id") == F.col("doc"))
            .select("doc", "sig", "bands").dropDuplicates(["doc"]))
    reps = staged(reps, "representatives")

    pairs, members = _buckets(reps)
    members = staged(_pieces(members).join(reps.select("doc", "sig"), "doc"), "members")
    first = staged(pairs.unionByName(_likely_forest(members)).distinct(), "pairs")
    ends = first.select(F.col("a").alias("doc")).unionByName(
        members.select("doc")).unionByName(first.select(F.col("b").alias("doc"))).distinct()
    texts = staged(_needed(docs, staged(ends, "ends")).dropDuplicates(["doc"]), "shingles")
    links = staged(_verified(first, texts), "links")
    groups = staged(components(links), "groups")

    # buckets whose members are not all in one group yet
    labelled = staged(members.join(groups, "doc", "left").withColumn("group", F.coalesce("component", "doc")).drop("component"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("bucket")
    more = staged(_links_between(labelled.join(mixed, "bucket"), texts), "links")
    if more.take(1):
        groups = staged(components(links.unionByName(more)), "groups")

    classes = sets.join(groups, "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component"))
    return (sketches.join(classes, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Of rows that repeat a kept doc_id the smallest row stays. Rows with a null doc_id stay.
    """
    judged = staged(near_duplicates(docs), "judged")
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("doc")).distinct()
    stay = _without(docs, gone)
    repeated = (judged.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
                .agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if repeated.take(1):
        once = stay.join(repeated, "doc_id", "left_anti").select(docs.columns)
        one = (stay.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
               .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
        stay = once.unionByName(one)
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))
