"""Conversation structure repair: the cheapest edits that make a conversation's roles legal, by dynamic programming.

Roles, by their first letters, are legal as (s?(ua)+)?. Edits of a turn: keep (0), give it the role user or assistant (1),
delete (2; blank and repeated turns must go); a turn without text may be put in anywhere (5), and a cut-off turn that is
not deleted costs 5 more. Of the cheapest edits the one whose letters (D, I, K, R) come first in ASCII is taken.

The roles seen so far are one of four states, and every letter leads from a state to one other, so the costs from a turn
to the end are four numbers. Conversations are bucketed by length into time-major tensors: all of a bucket are updated
together, a turn at a time from the end, the costs are stored, and the edits are traced together from the beginning.

Faults and codes are native expressions; a turn is one byte when conversations are put together, sorted by Spark, so a
conversation of any length needs some 30 bytes a turn in its task, as the edits' letters are one value anyhow. Texts are
shuffled once, behind the edits of their conversation, and streamed: no more than a batch of them is held.

Defined results: null role or text is one space; a conversation's turns are in order of turn, nulls first, then of role,
then of the SHA-256 of the text; equal turns repeat each other; a role of no letters is like any other that is not legal;
rows without a conversation id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of edits, and of what an undeleted cut-off turn adds.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Where a turn of a role (s, u, a, other) leads from each; -1: not legal.
STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Where a turn that is put in or given a role leads, and its role.
NEXT, ROLES = np.array([2, 2, 3, 2]), ("user", "user", "assistant", "user")
#: Faults of a turn, the last one of a row that is not there.
SOUND, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
#: Turns of conversations gathered before buckets are made, and cells of a tensor.
GATHER, CELLS = 1 << 18, 1 << 21
FAR = 1 << 29
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after seeded faults: by the CRC-32 of `conversation:turn` modulo 20 a row is left out (0),
    emptied (1), robbed of its [.!?] (2), repeated (3) or given to the user (4). Rows left out stay with absent = true."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space(conv_col), F.lit(":"), space(turn_col)), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    out = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"), (kind == 0).alias("absent"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return out.drop("_copy")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space), absent, _text (digest) of rows that may have no column `absent`."""
    absent = F.coalesce("absent", F.lit(False)) if "absent" in rows.columns else F.lit(False)
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), absent.alias("absent"), F.unhex(F.sha2(text, 256)).alias("_text"))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, _text, code: what a turn is, as role + 4 * fault, without its text."""
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(F.col("absent"), ABSENT).when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    lean = _turns(rows).select("conv_id", "turn", "role", "_text", fault.alias("_fault"))
    # Of turns of one conversation, role and text all but the first repeat it.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "_text", F.col("_fault") == ABSENT).orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("_fault").isin(ABSENT, BLANK), F.col("_fault")).when(again, DUPLICATE).otherwise(F.col("_fault"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return lean.withColumn("code", (role + 4 * fault).cast("byte")).drop("_fault")


def _sorted(rows: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Whole conversations in a partition, in order; what comes first, and last of equal turns."""
    keys = ["conv_id", first, F.asc_nulls_first("turn"), "role", "_text", last]
    return rows.repartition("conv_id").sortWithinPartitions(*[k for k in keys if k is not None])


# --- dynamic programming ------------------------------------------------------------------------------------------


def _closed(cost: np.ndarray) -> np.ndarray:
    """Least costs (4, n) if turns may be put in before the next one."""
    out = np.empty_like(cost)
    out[2], out[3] = np.minimum(cost[2], INSERT + cost[3]), np.minimum(cost[3], INSERT + cost[2])
    out[0], out[1] = np.minimum(cost[0], INSERT + out[2]), np.minimum(cost[1], INSERT + out[2])
    return out


def _edit_costs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For turns of these codes: costs of deleting and of giving a role (n), of keeping from each state (4, n), and where
    that leads. A code below 0 is no turn: it is deleted at no cost."""
    none, role, fault = code < 0, np.maximum(code, 0) % 4, np.maximum(code, 0) // 4
    must = none | (fault == BLANK) | (fault == DUPLICATE)
    cut = np.where(fault == TRUNCATED, CUT, 0)
    to = STEP[:, role]
    keep = np.where(must | (to < 0), FAR, cut)
    return np.where(none, 0, DELETE), np.where(must, FAR, REROLE + cut), keep, np.maximum(to, 0)


def solve(codes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Least cost and letters of the edits of each conversation; codes: (turns, conversations), -1 beyond a conversation."""
    turns, n = codes.shape
    every = np.arange(n)
    costs = np.empty((turns + 1, 4, n), np.int32)
    costs[turns] = _closed(np.repeat(np.array([[0], [FAR], [FAR], [0]], np.int32), n, 1))
    for t in range(turns - 1, -1, -1):
        delete, rerole, keep, to = _edit_costs(codes[t])
        after = costs[t + 1]
        costs[t] = _closed(np.minimum(np.minimum(delete + after, keep + after[to, every]), rerole + after[NEXT]))
    # Letters: up to two put in before each turn (and at the end), then the turn's own.
    letters = np.zeros((turns + 1, 3, n), np.uint8)
    state = np.zeros(n, np.int64)
    for t in range(turns + 1):
        if t < turns:
            delete, rerole, keep, to = _edit_costs(codes[t])
            after = costs[t + 1]
        for k in range(2):
            goes = INSERT + costs[t, NEXT[state], every] == costs[t, state, every]
            if t < turns:
                goes &= delete + after[state, every] != costs[t, state, every]
            letters[t, k][goes] = ord("I")
            state = np.where(goes, NEXT[state], state)
        if t == turns:
            break
        now = costs[t, state, every]
        deleted = delete + after[state, every] == now
        kept = ~deleted & (keep[state, every] + after[to[state, every], every] == now)
        letters[t, 2] = np.where(codes[t] < 0, 0, np.where(deleted, ord("D"), np.where(kept, ord("K"), ord("R"))))
        state = np.where(deleted, state, np.where(kept, to[state, every], NEXT[state]))
    flat = letters.transpose(2, 0, 1).reshape(n, -1)
    ends = np.cumsum((flat > 0).sum(1))
    whole = flat[flat > 0].tobytes()
    return costs[0, 0].astype(np.int64), [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def solve_all(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """As solve, for conversations that follow each other in codes; those of like lengths are solved together."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sizes = ends - starts
    cost, audit = np.zeros(len(ends), np.int64), [b""] * len(ends)
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for b in np.unique(bucket[sizes > 0]):
        own = np.flatnonzero((bucket == b) & (sizes > 0))
        for s in range(0, len(own), max(1, CELLS >> b)):
            part = own[s : s + max(1, CELLS >> b)]
            turn = np.arange(sizes[part].max())[:, None]
            within = turn < sizes[part]
            tensor = np.where(within, codes[np.where(within, starts[part] + turn, 0)], -1)
            found, letters = solve(tensor)
            cost[part] = found
            for c, x in zip(part.tolist(), letters, strict=True):
                audit[c] = x
    return cost, audit


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Whole conversations of a sorted partition, some GATHER turns at a time: ids, ends, and turns, their nulls and codes."""
    parts: list[pa.RecordBatch] = []
    held = 0

    def whole(final: bool):
        nonlocal parts, held
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = one.column(0)
        value, none = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
        new = np.flatnonzero((value[1:] != value[:-1]) | (none[1:] != none[:-1])) + 1
        ends = np.concatenate((new, [len(value)]))
        cut = len(value)
        if not final:
            ends, cut = ends[:-1], int(ends[-2]) if len(ends) > 1 else 0
        parts, held = ([one.slice(cut)], len(value) - cut) if cut < len(value) else ([], 0)
        if len(ends):
            done = one.slice(0, cut)
            turn = done.column(1)
            yield done.column(0).take(pa.array(np.concatenate(([0], ends[:-1])))), ends, [np.asarray(turn.fill_null(0)), np.asarray(turn.is_null()), done.column(2).to_numpy()]

    least = GATHER
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        held += batch.num_rows
        if held >= least:
            yield from whole(False)
            least = max(GATHER, 2 * held)  # a conversation longer than that is put together seldom
    if parts:
        yield from whole(True)


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(total[np.concatenate(([0], ends))])


def plan(rows: DataFrame) -> DataFrame:
    """PLAN of every conversation of rows (conv_id, turn, role, text): its faults, and the least cost and edits that mend it.

    gaps: turn numbers missing between the least and the greatest; illegal: neighbours whose roles do not follow each other.
    Rows with absent = true only say that there is the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, (turn, no_turn, code) in _runs(batches):
            here = code // 4 != ABSENT
            ends = np.cumsum(_sums(here, ends))
            turn, no_turn, code = turn[here], no_turn[here], code[here]
            role, fault = code % 4, code // 4
            first = np.zeros(len(code) + 1, bool)
            first[np.concatenate(([0], ends[:-1]))] = True
            first = first[: len(code)]
            follows = np.isin(np.concatenate(([3], role[:-1])) * 4 + role, (1, 6, 9))
            known = ~no_turn
            opens = known & (first | np.concatenate(([True], no_turn[:-1] | (turn[1:] != turn[:-1])))[: len(code)])
            n_known = _sums(known, ends)
            low, high = (np.zeros(len(ends), np.int64) for _ in range(2))
            some = np.flatnonzero(n_known)
            # Nulls are first, and turns ascend: the least is the first known one, the greatest the last.
            low[some], high[some] = turn[ends[some] - n_known[some]], turn[ends[some] - 1]
            gaps = np.where(n_known > 0, high - low + 1 - _sums(opens, ends), 0)
            cost, audit = solve_all(code, ends)
            figures = [gaps, *(_sums(fault == f, ends) for f in (BLANK, DUPLICATE, TRUNCATED)), _sums(~first & ~follows, ends), cost]
            arrays = [ids, *[pa.array(f.astype(np.int64)) for f in figures], pa.array([a.decode() for a in audit], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PLAN.split(", ")])

    lean = _sorted(coded(rows), last=F.floor(F.col("code") / 4) == DUPLICATE).select("conv_id", "turn", "code")
    return lean.mapInArrow(run, PLAN)


# --- repaired turns -----------------------------------------------------------------------------------------------


class Mending:
    """Applies a conversation's edits to its turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def put_in(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLES[self.state], ""
            self.state, self.at = int(NEXT[self.state]), self.at + 1

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.put_in()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(STEP[self.state, "sua".index(role[0])])
            yield role, text
        elif letter == "R":
            role, self.state = ROLES[self.state], int(NEXT[self.state])
            yield role, text


class _Turns(Mending):
    """Rows of (conv_id, place, role, text)."""

    def __init__(self, head: dict):
        super().__init__(head["audit"])
        self.id, self.place = head["conv_id"], 0

    def _placed(self, turns) -> Iterator[tuple]:
        for role, text in turns:
            yield self.id, self.place, role, text
            self.place += 1

    def take(self, role: str, text: str) -> Iterator[tuple]:
        return self._placed(self.turn(role, text))

    def end(self) -> Iterator[tuple]:
        return self._placed(self.put_in())


class _Digest(Mending):
    """One row: the plan and the SHA-256 of the repaired `role:text`, joined by newlines."""

    def __init__(self, head: dict):
        super().__init__(head["audit"])
        self.head, self.hash, self.before = head, hashlib.sha256(), b""

    def _add(self, turns) -> None:
        for role, text in turns:
            self.hash.update(self.before + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.before = b"\n"

    def take(self, role: str, text: str) -> tuple:
        self._add(self.turn(role, text))
        return ()

    def end(self) -> Iterator[tuple]:
        self._add(self.put_in())
        yield (*self.head.values(), self.hash.hexdigest())


def _streamed(rows: DataFrame, plans: DataFrame, kind: type, schema: str) -> DataFrame:
    """What a kind of mending makes of each conversation's turns, which come behind its plan."""
    own = [c.split()[0] for c in PLAN.split(", ")]
    turns = _turns(rows).where("not absent").drop("absent")
    head = plans.select("conv_id", F.struct(*own).alias("_plan"))
    lean = _sorted(head.unionByName(turns, allowMissingColumns=True), F.col("_plan").isNull()).select("role", "text", "_plan")
    fields = [c.split() for c in schema.split(", ")]
    arrow = pa.schema([(name, pa.int64() if of == "long" else pa.string()) for name, of in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            for role, text, plan_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if plan_row is None:
                    out += now.take(role, text)
                    continue
                out += now.end() if now else ()
                now = kind(plan_row)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in now.end()], schema=arrow)

    return lean.mapInArrow(run, schema)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation after its edits, by place from 0."""
    return _streamed(rows, plans, _Turns, "conv_id long, place long, role string, text string")


def repaired_digest(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256."""
    return _streamed(rows, plans, _Digest, f"{PLAN}, repaired_sha256 string")
