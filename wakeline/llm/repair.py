"""Cheapest repair of conversations, by a dynamic programme that keeps only checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``, which a machine of four states accepts.
The cost of repairing the rest of a conversation is a vector over these states, computed backwards.
Vectors are kept at checkpoints only: at the ends of blocks of a conversation, and inside a block at
every square root of its length. Walking forward, the vectors between two checkpoints are computed
again, and of the edits that are tight against them the one with the ASCII-least initial is taken.

A long conversation is cut into blocks that lie in any number of tasks. Each block becomes a matrix
(state before, state after) of least costs; one pass over a conversation's matrices, last block
first, gives the checkpoints; blocks are then walked on their own, once per state they may be
entered in; and one pass over their exits, first block first, chooses among these walks. Both passes
stream: they hold one vector or one state.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import staged

#: Costs of a rerole, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A block ends after so many rows.
BLOCK_ROWS = 4096
#: Fixed value: what a blank text consists of.
SPACE = r"[\x20\x09-\x0D]"

#: States: nothing yet, after a system row, after a user row, after an assistant row.
NEXT = (2, 2, 3, 2)  # where the only row of user or assistant that fits leads
ACCEPTED = (0, 3)
#: Initials by number (0: any other, 4: an empty role) and where keeping such a row leads.
INITIAL = {"s": 1, "u": 2, "a": 3, "": 4}
KEEP = ((None,) * 4, (1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (0, 1, 2, 3))
LEGAL = {(1, 2), (2, 3), (3, 2)}
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = range(4)
END = (0, 2 * INSERT, INSERT, 0)  # what is left to pay after the last row
NEVER = 1 << 60

#: What orders the rows of a table of conversations, nulls first: the last two stand for the text.
ORDER = ["conv_id", "turn", "role", "opening", "digest"]
BLOCKS = ("conv_id long, block long, initials array<int>, faults array<int>, copies array<long>, "
          "turns array<long>, roles array<string>, digests array<binary>, opening string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with copies, damaged as the checksum of ``conv_id:turn`` says; nulls are one space.

    Of 20 remainders 0 drops the row (copies 0), 1 empties the text, 2 takes its sentence ends away,
    3 repeats the row and 4 makes it the user's.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def keyed(turns: DataFrame) -> DataFrame:
    """The columns of ORDER, text and copies; null roles and texts are one space."""
    rows = turns.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.col("copies").cast("long").alias("copies"))
    return rows.withColumns({"opening": F.substring("text", 1, 16), "digest": F.unhex(F.sha2("text", 256))})


def judged(turns: DataFrame) -> DataFrame:
    """Equal rows of a turn together, with copies and the fault of the first of them; no texts."""
    blank, cut = ~F.col("text").rlike(SPACE.replace("[", "[^")), ~F.col("text").rlike(r"[.!?]" + SPACE + r"*\z")
    rows = keyed(turns).select(*ORDER, "copies", blank.alias("blank"), cut.alias("cut"))
    rows = rows.groupBy(*ORDER, "blank", "cut").agg(F.sum("copies").alias("copies"))
    # where a role first says a text: found by an aggregate and matched to that one row, so that
    # a text said very often gathers nothing
    first = (rows.filter(F.col("copies") > 0).groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"))
             .agg(F.min(F.struct("turn")).alias("at")).select("f_conv", "f_role", "f_digest", F.col("at.turn").alias("f_turn"), F.lit(True).alias("is_first")))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role"))
                     & (F.col("digest") == F.col("f_digest")) & F.col("turn").eqNullSafe(F.col("f_turn")), "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE)
             .when(F.col("cut"), CUT_OFF).otherwise(NO_FAULT))
    return rows.select(*ORDER, "copies", fault.alias("fault"))


def blocks(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows in order, cut by range into tasks and there into blocks of one conversation each.

    Order: conv_id, turn, role, text (its first 16 characters, then its digest), nulls first.
    """
    rows = judged(turns).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    names = [*ORDER, "copies", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            _, turn, role, opening, digest, copies, fault = zip(*held)
            out.append((held[0][0], number, [INITIAL.get(r[:1], 0) for r in role], list(fault), list(copies),
                        list(turn), list(role), list(digest), opening[0]))
            number, held = number + 1, []

        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in names]):
                if held and (row[0] != held[0][0] or len(held) >= block_rows):
                    close()
                held.append(row)
            if out:
                yield _batch(out, BLOCKS)
                out = []
        if held:
            close()
            yield _batch(out, BLOCKS)

    return rows.select(*names).mapInArrow(run, BLOCKS)


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name type`` pairs, without a session."""
    plain = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, pa.list_(plain[kind[6:-1]]) if kind.startswith("array") else plain[kind])
                      for name, kind in (field.split() for field in ddl.split(","))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def before(after: list[int], initial: int, fault: int, copies: int) -> list[int]:
    """Costs before a row and its copies, from those after them; insertions before it included.

    All copies of a row but the first are duplicates, which go.
    """
    if not copies:
        return after
    if fault in (BLANK, DUPLICATE):
        return [v + DELETE * copies for v in after]
    rest, stays, keep = [v + DELETE * (copies - 1) for v in after], TRUNCATED if fault == CUT_OFF else 0, KEEP[initial]
    out = [min(DELETE + rest[s], REROLE + stays + rest[NEXT[s]],
               stays + rest[keep[s]] if keep[s] is not None else NEVER) for s in range(4)]
    return [min(out[s], INSERT + out[NEXT[s]], 2 * INSERT + out[NEXT[NEXT[s]]]) for s in range(4)]


def costs_through(rows: list[tuple[int, int, int]]) -> list[list[int]]:
    """Least costs by state before and after rows (initial, fault, copies)."""
    out = []
    for end in range(4):
        v = [0 if s == end else NEVER for s in range(4)]
        for row in reversed(rows):
            v = before(v, *row)
        out.append(v)
    return [[min(out[end][s], NEVER) for end in range(4)] for s in range(4)]


def checkpoints(rows: list[tuple[int, int, int]], after: list[int]) -> dict[int, list[int]]:
    """Cost vectors before every square-root-th row."""
    every, v, kept = math.isqrt(max(0, len(rows) - 1)) + 1, after, {len(rows): after}
    for i in range(len(rows) - 1, -1, -1):
        v = before(v, *rows[i])
        if i % every == 0:
            kept[i] = v
    return kept


def walk(rows: list[tuple[int, int, int]], after: list[int], state: int, kept: dict[int, list[int]],
         last: bool) -> tuple[str, int, int]:
    """(edits, state after them, cost) of the ASCII-least cheapest edits from ``state``."""
    edits, cost, starts = [], 0, sorted(kept)
    for start, stop in zip(starts, starts[1:]):
        vectors = [kept[stop]]
        for row in reversed(rows[start:stop]):
            vectors.append(before(vectors[-1], *row))
        vectors.reverse()
        for i, (initial, fault, copies) in enumerate(rows[start:stop]):
            now, rest, extra = vectors[i], vectors[i + 1], max(copies - 1, 0)
            if fault in (BLANK, DUPLICATE):
                edits.append("D" * copies)
                cost += DELETE * copies
                continue
            stays = TRUNCATED if fault == CUT_OFF else 0
            while copies:
                left, gone = now[state], DELETE * extra
                if DELETE + gone + rest[state] == left:
                    edits.append("D")
                    cost += DELETE
                elif INSERT + now[NEXT[state]] == left:
                    edits.append("I")
                    cost, state = cost + INSERT, NEXT[state]
                    continue
                elif (to := KEEP[initial][state]) is not None and stays + gone + rest[to] == left:
                    edits.append("K")
                    cost, state = cost + stays, to
                else:
                    edits.append("R")
                    cost, state = cost + REROLE + stays, NEXT[state]
                edits.append("D" * extra)
                cost += gone
                break
    while last and state not in ACCEPTED:
        edits.append("I")
        cost, state = cost + INSERT, NEXT[state]
    return "".join(edits), state, cost


def _map(df: DataFrame, work: Callable[..., tuple], ddl: str) -> DataFrame:
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([work(*row) for row in zip(*[batch.column(n).to_pylist() for n in names])], ddl)

    return df.mapInArrow(run, ddl)


def _stream(df: DataFrame, start: Callable[[], Callable[..., list[tuple]]], ddl: str, *order: Column) -> DataFrame:
    """Rows of a conversation in order through one function that holds only a state.

    ``order`` follows conv_id.
    """
    names = df.columns
    df = df.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            out = [r for row in zip(*[batch.column(n).to_pylist() for n in names]) for r in step(*row)]
            if out:
                yield _batch(out, ddl)
        if out := step(*[None] * len(names), done=True):
            yield _batch(out, ddl)

    return df.mapInArrow(run, ddl)


def _ends(matrix: list[list[int]], after: list[int]) -> list[int]:
    return [min(m + a for m, a in zip(row, after)) for row in matrix]


def _backwards():
    """Last block first: the vector after each block, and whether it is first or last."""
    held: tuple | None = None

    def step(conv_id, block, matrix, done=False):
        nonlocal held
        out, same = [], not done and held is not None and held[0] == conv_id
        if held is not None:
            out.append((held[1], held[2], not same, held[3]))
        if not done:
            after = held[4] if same else list(END)
            held = (conv_id, block, after, not same, _ends([matrix[i:i + 4] for i in range(0, 16, 4)], after))
        return out

    return step


def _forwards():
    """First block first: the walk of each block from the state that the one before it ends in."""
    seen: list = []

    def step(conv_id, block, edits, exits, costs, done=False):
        if done:
            return []
        state = seen[1] if seen and seen[0] == conv_id else 0
        seen[:] = [conv_id, exits[state]]
        return [(block, state, edits[state], costs[state])]

    return step


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of every conversation with the edits that repair them, and their cost; no texts.

    ``turns``: conv_id, turn, role, text and copies (how often the row stands there; 0: it is gone,
    but its conversation is still returned). Null roles and texts are one space; null turns come
    first, and rows with a null conv_id form one conversation. Rows of a turn go by role, then text;
    equal ones lie side by side. A role counts by its first character; an empty role adds none. Other
    columns are ignored, and an empty table gives no rows.

    Edits, one letter each and in order: K keeps a row (only if its initial fits), R gives it the
    role that fits, D deletes it (blank texts and repeated ones must go), I inserts an empty row of
    the role that fits. Of the cheapest sequences the ASCII-least is taken.
    """
    cut = staged(blocks(turns, block_rows), "blocks")
    codes = ["initials", "faults", "copies"]

    def through(conv_id, block, initials, faults, copies):
        return conv_id, block, [c for row in costs_through(list(zip(initials, faults, copies))) for c in row]

    matrices = _map(cut.select("conv_id", "block", *codes), through, "conv_id long, block long, matrix array<long>")
    ends = _stream(matrices, _backwards, "b_block long, after array<long>, first boolean, last boolean", F.desc("block"))
    ends = staged(ends, "checkpoints")

    def walks(conv_id, block, initials, faults, copies, after, first, last):
        rows = list(zip(initials, faults, copies))
        kept = checkpoints(rows, after)
        done = [walk(rows, after, s, kept, last) if s == 0 or not first else ("", 0, 0) for s in range(4)]
        return conv_id, block, *map(list, zip(*done))

    walked = _map(cut.select("conv_id", "block", *codes).join(ends, F.col("block") == F.col("b_block")).drop("b_block"), walks,
                  "conv_id long, block long, edits array<string>, exits array<int>, costs array<long>")
    chosen = staged(_stream(walked, _forwards, "e_block long, entry int, edits string, cost long", F.asc("block")), "edits")
    return cut.join(chosen, F.col("block") == F.col("e_block")).drop("e_block")


def _rows(roles: list[str], copies: list[int], edits: str, state: int) -> Iterator[tuple]:
    """(edit, index of the row before or at it, role) of each edit of a block entered in ``state``."""
    at, left = -1, 0
    for edit in edits:
        if edit != "I":
            while not left:
                at += 1
                left = copies[at]
            left -= 1
        if edit in "IR":
            role, state = "assistant" if state == 2 else "user", NEXT[state]
            yield edit, at, role
        else:
            if edit == "K":
                state = KEEP[INITIAL.get(roles[at][:1], 0)][state]
            yield edit, at, roles[at]


def _digest():
    """Blocks and texts of a conversation in order: its row of counts and digests when it ends.

    A block comes before its texts. It says which role each text gets, and which rows are new.
    """
    now: dict = {}

    def line(role: str, text: str) -> None:
        now["sha"].update(f"{chr(10) if now['lines'] else ''}{role}:{text}".encode())
        now["lines"] += 1

    def leave_block() -> None:
        for role in now["new"].pop(now["at"], ()):
            line(role, "")

    def finish() -> list[tuple]:
        if not now:
            return []
        leave_block()
        span = now["max"] - now["min"] + 1 - now["turns"] if now["turns"] else 0
        return [(now["conv"], span, *now["faults"][1:], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())]

    def enter_block(initials, faults, copies, turns, roles, entry, edits, cost) -> None:
        for initial, fault, n, turn in zip(initials, faults, copies, turns):
            if not n:
                continue
            now["faults"][fault] += 1
            now["faults"][BLANK if fault == BLANK else DUPLICATE] += n - 1
            now["illegal"] += n - 1 + (now["initial"] is not None and (now["initial"], initial) not in LEGAL)
            now["initial"] = initial
            if turn is not None and turn != now["max"]:
                now["min"] = turn if now["min"] is None else now["min"]
                now["max"], now["turns"] = turn, now["turns"] + 1
        now.update(at=-1, key=None, stay={}, new={})
        for edit, at, role in _rows(roles, copies, edits, entry):
            if edit == "I":
                now["new"].setdefault(at, []).append(role)
            elif edit != "D":
                now["stay"][at] = role
        now["cost"] += cost
        now["audit"].append(edits)

    def step(conv_id, turn, role, opening, digest, text, plan, done=False):
        out = []
        if done or not now or now["conv"] != conv_id:
            out = finish()
            now.clear()
            if done:
                return out
            now.update(conv=conv_id, min=None, max=None, turns=0, faults=[0] * 4, illegal=0, cost=0, audit=[],
                       sha=hashlib.sha256(), lines=0, initial=None, at=-1, key=None, stay={}, new={})
        if plan is not None:
            leave_block()
            enter_block(**plan)
        elif (turn, role, digest) != now["key"]:  # equal rows are one row of the block
            leave_block()
            now["key"], now["at"] = (turn, role, digest), now["at"] + 1
            if (kept := now["stay"].get(now["at"])) is not None:
                line(kept, text)
        return out

    return step


def digests(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row per conversation of ``turns``, with the blocks that :func:`repair` made of them. A digest
    must see its text in order, so the texts of a conversation stream through one task, each block
    before its own, and none is held. Conversations without rows have zeros, an empty audit and the
    digest of nothing.
    """
    plan = F.struct("initials", "faults", "copies", "turns", "roles", "entry", "edits", "cost")
    first = repaired.select("conv_id", F.get("turns", F.lit(0)).alias("turn"), F.get("roles", F.lit(0)).alias("role"), "opening",
                            F.get("digests", F.lit(0)).alias("digest"), F.lit(None).cast("string").alias("text"), plan.alias("plan"))
    texts = keyed(turns).select(*ORDER, "text", F.lit(None).cast(first.schema["plan"].dataType).alias("plan"))
    # of two rows with the same key the one with the plan comes first
    return _stream(first.unionByName(texts), _digest,
                   "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                   "audit string, repaired_sha256 string", *ORDER[1:], F.col("plan").isNull())


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, block, position, edit, turn, role, text: every row that stays or is new.

    Sort by block and position. Blocks are read on their own and their rows meet their texts by key;
    inserted rows have no turn and an empty text.
    """
    made = "conv_id long, block long, position int, edit string, role string, k_turn long, k_role string, k_digest binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for i, (edit, at, role) in enumerate(_rows(r["roles"], r["copies"], r["edits"], r["entry"])):
                    if edit != "D":
                        key = (None, None, None) if edit == "I" else (r["turns"][at], r["roles"][at], r["digests"][at])
                        out.append((r["conv_id"], r["block"], i, edit, role, *key))
                if out:
                    yield _batch(out, made)

    kept = repaired.select("conv_id", "block", "turns", "roles", "digests", "copies", "entry", "edits").mapInArrow(rows, made)
    texts = keyed(turns).groupBy(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("role").alias("t_role"),
                                 F.col("digest").alias("t_digest")).agg(F.first("text").alias("t_text"))
    same = (F.col("conv_id").eqNullSafe(F.col("t_conv")) & F.col("k_turn").eqNullSafe(F.col("t_turn"))
            & (F.col("k_role") == F.col("t_role")) & (F.col("k_digest") == F.col("t_digest")))
    return kept.join(texts, same, "left").select("conv_id", "block", "position", "edit", F.col("k_turn").alias("turn"), "role",
                                                 F.coalesce("t_text", F.lit("")).alias("text"))


def _sql() -> str:
    """The same by a forward programme: per state the least (cost, audit, lines), row by row."""
    def edit(x: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'l': {x}.l || {line}}}"

    def kept(x: str, initials: str) -> str:
        return edit(x, f"(CASE WHEN may AND left(role, 1) IN ({initials}) THEN more ELSE 1000000000 END)", "K", "chr(10) || role || ':' || text")

    def rerole(x: str, role: str) -> str:
        return edit(x, "(CASE WHEN may THEN more + 1 ELSE 1000000000 END)", "R", f"chr(10) || '{role}:' || text")

    def insert(x: str, role: str) -> str:
        return edit(x, "5", "I", f"chr(10) || '{role}:'")

    def inserted(v: str) -> str:
        user, assistant = (", ".join(insert(f"{v}[{i}]", r) for i in places) for r, places in (("user", (1, 2, 4)), ("assistant", (3,))))
        return f"[{v}[1], {v}[2], list_min([{v}[3], {user}]), list_min([{v}[4], {assistant}])]"

    gone = [edit(f"v[{i}]", "2", "D", "''") for i in range(1, 5)]
    same = [kept(f"v[{i}]", "''") for i in range(1, 5)]
    user = ", ".join([kept(f"v[{i}]", "'u'") for i in (1, 2, 4)] + [rerole(f"v[{i}]", "user") for i in (1, 2, 4)])
    step = (f"[list_min([{gone[0]}, {same[0]}]), list_min([{gone[1]}, {same[1]}, {kept('v[1]', chr(39) + 's' + chr(39))}]), "
            f"list_min([{gone[2]}, {same[2]}, {user}]), "
            f"list_min([{gone[3]}, {same[3]}, {kept('v[3]', chr(39) + 'a' + chr(39))}, {rerole('v[3]', 'assistant')}])]")
    never = "{'c': 1000000000::BIGINT, 'a': '', 'l': ''}"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))),
    4294967295) % 20 AS kind FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), rows AS (
  SELECT *, NOT blank AND NOT again AS may, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM faults
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), costs AS (
  SELECT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': '', 'l': ''}}, {never}, {never}, {never}] AS v
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {step}
  FROM (SELECT conv_id, i, role, text, may, more, {inserted('v')} AS v
        FROM (SELECT d.conv_id, r.i, role, text, may, more, {inserted('d.v')} AS v
              FROM costs d JOIN rows r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1))
), ends AS (
  SELECT conv_id, i, list_min([v[1], v[4]]) AS best
  FROM (SELECT conv_id, i, {inserted('v')} AS v FROM (SELECT conv_id, i, {inserted('v')} AS v FROM costs))
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(best.l[2:]) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(c.n, 0)
"""


SQL = _sql()
