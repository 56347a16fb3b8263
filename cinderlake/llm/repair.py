"""Conversation structure repair: the cheapest edits that leave a system turn at most, then user and assistant in turn.

Turns and the states of the role pattern ``(s?(ua)+)?`` make a graph of layers. Its arcs keep, re-role, delete or insert a turn
at small integer costs, so distances to the end are found with Dial's bucket queue; the audit is the walk along tight arcs
that takes the least letter each time.

Conversations are worked on in blocks of consecutive turns, so that one with a large share of all rows is dealt out: a block
tells the cost between any two states and which of its cheapest walks come first, whatever follows. A pass over a
conversation's blocks, a few bytes each, then fixes the states at block borders, and each block writes its part of the
audit and of the repaired text. Only the digest of the whole text needs a conversation in one task, and it streams.

Turns are ordered by turn (nulls first); those of one turn by role, then SHA-256 of the text, so that repeats are
adjacent. Null roles and texts are one space; a null conversation id is a conversation of its own. Roles with another first
letter than s, u or a, and empty ones, can be re-roled or deleted only. Texts are read whole; a very long one is one row. No
rows give no rows. Columns other than the four named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import Stored, broadcast_if_small, column
from cinderlake.shipping import ship

#: Turns of a block, as a power of two.
BLOCK_BITS = 8
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the next user or assistant turn, and what role that is.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: States that turns of a role's initial lead to; and turns to be inserted at the end.
KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "x": {}}
MISSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: A turn in a block's code: its role's initial and fault as one letter, behind a mark where role and text occur first.
FINE, TRUNCATED, BLANK = range(3)
INITIALS, FIRST = "suax", "!"


@lru_cache(maxsize=32)
def arcs(initial: str, doomed: bool, truncated: bool) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """By state: (letter, cost, next state) of the arcs in front of one turn, by letter. All but insertions lead behind the turn."""
    more = TRUNCATED_COST if truncated else 0
    out = []
    for state in range(4):
        mine = [(DELETE, COST[DELETE], state), (INSERT, COST[INSERT], NEXT[state])]
        if not doomed:
            if state in KEPT[initial]:
                mine.append((KEEP, COST[KEEP] + more, KEPT[initial][state]))
            mine.append((REROLE, COST[REROLE] + more, NEXT[state]))
        out.append(tuple(mine))
    return tuple(out)


def turns_of(code: str) -> list[tuple[str, int, bool]]:
    """(initial, fault, whether it repeats an earlier turn) of a block's turns."""
    out, first = [], False
    for c in code:
        if c == FIRST:
            first = True
        else:
            kind, fault = divmod(ord(c) - ord("a"), 3)
            out.append((INITIALS[kind], fault, fault != BLANK and not first))
            first = False
    return out


def layers(turns: list[tuple[str, int, bool]]) -> list:
    return [arcs(initial, fault == BLANK or repeated, fault == TRUNCATED) for initial, fault, repeated in turns]


def distances(steps: list, end: int) -> list[list[int]]:
    """Dial's bucket queue, from one state behind the last turn back: the cost from each state in front of each turn; ``FAR`` where no way leads."""
    n = len(steps)
    into: list = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i, by_state in enumerate(steps):
        for state, mine in enumerate(by_state):
            for letter, cost, after in mine:
                into[i + (letter != INSERT)][after].append((i, state, cost))
    best = [[FAR] * 4 for _ in range(n + 1)]
    best[n][end] = 0
    size = COST[REROLE] + TRUNCATED_COST + 1  # one more than the dearest arc
    buckets: list[list] = [[] for _ in range(size)]
    buckets[0].append((n, end))
    waiting, d = 1, 0
    while waiting:
        bucket = buckets[d % size]
        while bucket:
            i, state = bucket.pop()
            waiting -= 1
            if best[i][state] != d:
                continue
            for h, before, cost in into[i][state]:
                if d + cost < best[h][before]:
                    best[h][before] = d + cost
                    buckets[(d + cost) % size].append((h, before))
                    waiting += 1
        d += 1
    return best


def walk(steps: list, best: list[list[int]], state: int) -> str:
    """The least letters along tight arcs from a state in front of the first turn to the end that ``best`` is for."""
    letters, i = [], 0
    while i < len(steps):
        for letter, cost, after in steps[i][state]:
            j = i + (letter != INSERT)
            if best[j][after] + cost == best[i][state]:
                letters.append(letter)
                i, state = j, after
                break
    return "".join(letters)


def summary(code: str) -> tuple[list[int], list[int]]:
    """Of a block: 16 costs from state to state; and for each first state the last states in the order of their walks' letters."""
    steps = layers(turns_of(code))
    by_end = [distances(steps, end) for end in range(4)]
    costs = [by_end[end][0][state] for state in range(4) for end in range(4)]
    order = []
    for state in range(4):
        open_ends = [end for end in range(4) if by_end[end][0][state] < FAR]
        order += sorted(open_ends, key=lambda end: walk(steps, by_end[end], state)) + [-1] * (4 - len(open_ends))  # noqa: B023
    return costs, order


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with faults put in, by CRC-32 of ``conversation:turn`` modulo 20: 0 drops the turn, 1 empties its text,
    2 takes its ``[.!?]`` out, 3 repeats it, 4 makes it the user's. Nulls are one space first."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = column(turns, conv_col).cast("long"), column(turns, turn_col).cast("long")
    rows = turns.select(
        conv.alias("conv"), turn.alias("turn"), space(column(turns, role_col)).alias("role"), space(column(turns, text_col)).alias("text"),
        (F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20).alias("hit"),
    ).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def lined_up(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, digest, line)``: ``line`` numbers all turns in order, with gaps. Rows are dealt out by ranges, equal ones too."""
    space = lambda c: F.coalesce(column(turns, c).cast("string"), F.lit(" "))
    rows = turns.select(column(turns, conv_col).cast("long").alias("conv"), column(turns, turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    order = ("conv", "turn", "role", "digest", "tie")
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("tie", F.monotonically_increasing_id())
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("line", F.monotonically_increasing_id())


def blocks_of(lines: DataFrame) -> DataFrame:
    """``(conv, head, code, turns)``: blocks by their first line, with the code of their turns, roles and texts in order."""
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)) * F.least(F.length("role"), F.lit(1)), F.lit(0)), F.lit(4)) - 1
    fault = F.when(F.length(bare) == 0, BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    code = F.char((initial * 3 + fault + ord("a")).cast("long"))
    said = lines.select("conv", "line", code.alias("code"), "role", "text")
    first = lines.groupBy("conv", "role", "digest").agg(F.min("line").alias("line")).select("conv", "line", F.lit(FIRST).alias("code"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = said.unionByName(first).groupBy("conv", F.shiftright("line", BLOCK_BITS).alias("slot"))
    held = both.agg(F.sort_array(F.collect_list(F.struct("line", "code", "role", "text"))).alias("x"))  # the mark sorts before its turn
    turns = F.transform(F.filter("x", lambda t: t["code"] != FIRST), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return held.select("conv", F.col("x")[0]["line"].alias("head"), F.array_join("x.code", "").alias("code"), turns.alias("turns"))


SUMMARY = "conv long, head long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, order array<int>"
PLAN = "conv long, head long, entry int, leave int, last boolean, blank long, duplicate long, truncated long, illegal long, cost long"
PIECE = "conv long, head long, n_lines long, audit string, repaired string, last boolean, blank long, duplicate long, truncated long, illegal long, cost long"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv, head, code): faults, pairs of neighbours out of order, costs and order of walks of each block."""
    for batch in batches:
        out = []
        for conv, head, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = turns_of(code)
            initials = [t[0] for t in turns]
            out.append((
                conv, head, sum(t[1] == BLANK for t in turns), sum(t[2] for t in turns), sum(t[1] == TRUNCATED and not t[2] for t in turns),
                sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), initials[0], initials[-1], *summary(code),
            ))
        yield batch_of(out, SUMMARY)


def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Borders of blocks: from summaries sorted by conversation, last block first, to first and last state of each; totals with the last block.

    Of the blocks seen so far only the chosen last states by first state and the heads are kept, 16 bytes a block.
    """
    now: object = batches  # no conversation
    heads, chosen = array("q"), array("b")
    ahead: list[int] = []
    counts, initial_ahead = [0] * 4, ""

    def finished() -> list[tuple]:
        rows, state = [], START
        for k in range(len(heads) - 1, -1, -1):
            leave = chosen[4 * k + state]
            last = k == 0
            rows.append((now, heads[k], state, leave, last, *(counts if last else (0,) * 4), ahead[START] if last else 0))
            state = leave
        return rows

    for batch in batches:
        out: list[tuple] = []
        for conv, head, *found, first, last, costs, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is batches or conv != now:
                if heads:
                    out += finished()
                now, heads, chosen, counts, initial_ahead = conv, array("q"), array("b"), [0] * 4, ""
                ahead = [COST[INSERT] * k for k in MISSING]
            counts = [a + b for a, b in zip(counts, found, strict=True)]
            counts[3] += bool(initial_ahead) and last + initial_ahead not in LEGAL
            initial_ahead = first
            heads.append(head)
            behind = []
            for state in range(4):
                least = min(costs[4 * state + end] + ahead[end] for end in range(4))
                chosen.append(next(end for end in order[4 * state : 4 * state + 4] if costs[4 * state + end] + ahead[end] == least))
                behind.append(least)
            ahead = behind
        if out:
            yield batch_of(out, PLAN)
    if heads:
        yield batch_of(finished(), PLAN)


def edited(turns: list[dict], letters: str, state: int, last: bool) -> list[str]:
    """Lines ``role:text`` of a block after its edits; behind the last block what the pattern still asks for."""
    lines, i = [], 0
    for letter in letters:
        if letter == INSERT:
            lines.append(f"{NEXT_ROLE[state]}:")
            state = NEXT[state]
            continue
        turn = turns[i]
        i += 1
        if letter == KEEP:
            lines.append(f"{turn['role']}:{turn['text']}")
            state = KEPT[turn["role"][0]][state]
        elif letter == REROLE:
            lines.append(f"{NEXT_ROLE[state]}:{turn['text']}")
            state = NEXT[state]
    for _ in range(MISSING[state] if last else 0):
        lines.append(f"{NEXT_ROLE[state]}:")
        state = NEXT[state]
    return lines


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (plan, code, turns): each block's part of the audit and of the repaired text."""
    for batch in batches:
        for i in range(batch.num_rows):  # one block at a time, as texts may be long
            row = batch.slice(i, 1).to_pylist()[0]
            steps = layers(turns_of(row["code"]))
            letters = walk(steps, distances(steps, row["leave"]), row["entry"])
            lines = edited(row["turns"], letters, row["entry"], row["last"])
            audit = letters + INSERT * (MISSING[row["leave"]] if row["last"] else 0)
            yield batch_of([(row["conv"], row["head"], len(lines), audit, "\n".join(lines), row["last"], *(row[c] for c in COUNTS))], PIECE)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by conversation and place: audit and digest of each conversation, text by text."""
    parts: list[str] = []
    digest, begun = hashlib.sha256(), False
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            conv, _, n_lines, audit, repaired, last, *counts = (c[i].as_py() for c in batch.columns)
            parts.append(audit)
            if n_lines:
                digest.update((("\n" if begun else "") + repaired).encode("utf-8"))
                begun = True
            if last:
                out.append((conv, *counts, "".join(parts), digest.hexdigest()))
                parts, digest, begun = [], hashlib.sha256(), False
        if out:
            yield batch_of(out, REPAIRED)


REPAIRED = "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired_pieces(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pieces ``(conv, head, n_lines, audit, repaired, last, counts)``, whose ``repaired`` texts are the conversations in order of ``head``; and ``(conv, gaps)``."""
    ship(turns.sparkSession)
    lines = Stored(lined_up(turns, conv_col, turn_col, role_col, text_col), "turns").df
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    blocks = Stored(blocks_of(lines), "blocks").df
    told = blocks.select("conv", "head", "code").mapInArrow(summaries, SUMMARY)
    plan = Stored(told.repartition("conv").sortWithinPartitions("conv", F.desc("head")).mapInArrow(plans, PLAN), "plan").df
    planned = blocks.select("head", "code", "turns").join(broadcast_if_small(plan), "head")
    return planned.mapInArrow(pieces, PIECE), lines.groupBy("conv").agg(gaps.alias("gaps"))


def repair(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation of ``turns``: conv, gaps (turns missing between the first and the last), blank, duplicate, truncated (first fault of a
    turn), illegal (neighbours out of order), cost, audit and SHA-256 of the repaired ``role:text`` lines."""
    made, gaps = repaired_pieces(turns, **columns)
    found = made.repartition("conv").sortWithinPartitions("conv", "head").mapInArrow(digests, REPAIRED)
    both = found.join(gaps.withColumnRenamed("conv", "conv_"), F.col("conv").eqNullSafe(F.col("conv_")))
    return both.select("conv", "gaps", *names(REPAIRED)[1:])


def repair_damaged(turns: DataFrame, **columns: str) -> DataFrame:
    """``repair`` of ``damage(turns)``, with a row for each conversation of ``turns``, those too that lose all their turns."""
    conv = column(turns, columns.get("conv_col", "conv_id")).cast("long")
    every = turns.select(conv.alias("conv_")).distinct()
    found = repair(damage(turns, **columns), conv_col="conv", turn_col="turn", role_col="role", text_col="text")
    both = every.join(found, F.col("conv_").eqNullSafe(F.col("conv")), "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS)}
    return both.select(
        F.col("conv_").alias("conv"), *(zeros[c] for c in ("gaps", *COUNTS)), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
