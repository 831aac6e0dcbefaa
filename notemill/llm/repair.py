"""Repair of conversations by the cheapest edits: A* on the lattice of (row, what the repaired roles are so far).

A repaired conversation is empty, or an optional system message and then user and assistant in turn. Edits are Keep, Rerole, Delete and
Insert. The heuristic of a node is the sum over the rows still to come of what no edit can avoid: a deletion for a blank or repeated row, one for a
truncated row (kept, it costs that; deleted, it costs more). Nodes leave the queue in order of (cost so far + heuristic, audit), so the first to reach the end has the
least cost and of those the ASCII-least audit.

Rows are dealt by conversation and stream through a task in order of turn. A long conversation is taken in blocks of rows: for each state that the
best edits so far end in, A* gives the best edits of the block to every state, and the two are put together. Its rows wait in the task's own
spill file until the last block tells which edits they get, so memory holds a block and four strings of edits.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after the roles so far: none, a system message, a user, an assistant. A state's moves by role initial; the ends that are legal.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LEGAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a block.
BLOCK = 256


def cheapest(rows: list[tuple[str, str]], start: int, ends: tuple[int, ...], every: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best edits of rows from state `start` to each state of ends, or to the best of them unless `every`.

    rows: (initial, fault), fault being one of "", "blank", "duplicate", "truncated".
    """
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        least[i] = least[i + 1] + (DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault else 0)
    found: dict[int, tuple[int, str]] = {}
    done, queue = set(), [(least[0], "", 0, start)]
    while queue:
        total, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = total - least[i]
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        for initial, after in MOVES[state].items():
            if initial != "s" and (i, after) not in done:
                heapq.heappush(queue, (cost + INSERT + least[i], audit + "I", i, after))
        if i == n:
            continue
        mine, fault = rows[i]
        heapq.heappush(queue, (cost + DELETE + least[i + 1], audit + "D", i + 1, state))
        if fault in ("blank", "duplicate"):
            continue
        extra = (TRUNCATED if fault else 0) + least[i + 1]
        for initial, after in MOVES[state].items():
            if initial == mine:
                heapq.heappush(queue, (cost + KEEP + extra, audit + "K", i + 1, after))
            elif initial != "s":
                heapq.heappush(queue, (cost + REROLE + extra, audit + "R", i + 1, after))
    return found


class Conversation:
    """What is known of a conversation while its rows come by."""

    def __init__(self, block: int):
        self.block, self.best, self.spill = block, {0: (0, "")}, None
        self.rows: list[tuple[str, str, str]] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.last = None
        self.distinct = self.illegal = 0
        self.before = None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if len(self.rows) == self.block:
            self._settle()
        initial = role[:1]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text, fault))

    def _settle(self) -> None:
        """Puts the block at hand behind the best edits so far, and its rows into the spill file."""
        self.best = self._joined((0, 1, 2, 3), True)
        self.spill = self.spill or tempfile.TemporaryFile()
        pickle.dump(self.rows, self.spill)
        self.rows = []

    def _joined(self, ends: tuple[int, ...], every: bool) -> dict[int, tuple[int, str]]:
        told = [(role[:1], fault) for role, _, fault in self.rows]
        best: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.best.items():
            for end, (more, edits) in cheapest(told, state, ends, every).items():
                best[end] = min(best.get(end, (1 << 62, "")), (cost + more, audit + edits))
        return best

    def _blocks(self):
        if self.spill:
            self.spill.seek(0)
            while True:
                try:
                    yield pickle.load(self.spill)
                except EOFError:
                    break
            self.spill.close()
        yield self.rows

    def done(self) -> dict:
        cost, audit = min(self._joined(LEGAL, False).values())
        lines, state, at, first = sha256(), 0, 0, True
        rows = (row for block in self._blocks() for row in block)

        def put(line: str) -> None:
            nonlocal first
            lines.update(("" if first else "\n").encode() + line.encode("utf-8", "surrogatepass"))
            first = False

        for edit in audit:
            # only a kept row can be a system message; all else follows from what came before
            due = "a" if state == 2 else "u"
            if edit == "I":
                put(f"{NAMES[due]}:")
            else:
                role, text, _ = next(rows)
                if edit == "D":
                    continue
                due = role[:1] if edit == "K" else due
                put(f"{role if edit == 'K' else NAMES[due]}:{text}")
            state = MOVES[state][due]
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": lines.hexdigest()}


def _repaired(block: int):
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        at, now, out = (), None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for conv, gone, turn, role, text, fault in zip(*columns):
                if (conv,) != at:
                    if now:
                        out.append({"conv_id": at[0], **now.done()})
                    at, now = (conv,), Conversation(block)
                if not gone:
                    now.add(turn, role, text, fault)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now:
            out.append({"conv_id": at[0], **now.done()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of conversations with faults put in by a hash of (conversation, turn): dropped rows stay as gone, repeated ones come twice."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("_time")).drop("_time")


def fault(text: Column, again: Column) -> Column:
    """The first fault of a row; again: its place among the rows of its conversation with its role and text."""
    solid = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", "blank").when(again > 1, "duplicate").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. rows: conv_id, turn, role, text, gone.

    Rows are taken by turn, null turns first, ties by role and text; gone ones count for nothing but that their conversation has a result. Null
    roles and texts count as one space, an empty role or one with another initial can't be kept. A null conv_id is a conversation of its own. A conversation without rows has zeros, an empty audit and
    the hash of the empty string. Texts of any length are kept whole, repeated rows are duplicates, columns of other names are ignored, an empty table gives no rows.
    block changes nothing but memory.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("bigint"), F.coalesce("gone", F.lit(False)).alias("gone"), F.col("turn").cast("bigint"), one("role"), one("text"))
    # dealt by text as well: a conversation of any size is in many tasks
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("_again", F.row_number().over(same)).withColumn("fault", fault(F.col("text"), F.col("_again")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_again")
    return rows.select("conv_id", "gone", "turn", "role", "text", "fault").mapInArrow(_repaired(block), "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
