"""Conversation structure repair: a square-root checkpointed DP finds the cheapest edits that make the roles alternate.

The rows of a conversation are a sequence of symbols; four states say what was written last. A run of symbols is a 4x4 matrix of least
costs, so a conversation may lie over any number of tasks: each task turns its part into a matrix, the driver chains the few parts that
are cut by a task's border, and every task then walks its own part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import cut

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing written, system, user or assistant written last. What a user or assistant row (kept, reroled or inserted) leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = (USER, USER, ASSISTANT, USER)
#: At the end of a conversation: nothing and assistant may end; a user lacks an assistant, a system row both.
END = (0, 2 * INSERT, INSERT, 0)

#: A symbol: the role's initial (system, user, assistant, other), plus 4 if truncated, plus 8 if the row must go.
INITIALS = {"s": 0, "u": 1, "a": 2}
#: conv_id is a number or a text.
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def takes(state: int, initial: int) -> int | None:
    """The state after a kept row, None if the row does not fit."""
    if initial == 0:
        return SYSTEM if state == START else None
    fits = (initial == 1) == (state != USER) and initial < 3
    return TURN[state] if fits else None


def choices(state: int, symbol: int) -> list[tuple[str, float, int]]:
    """Edits that consume a row, in ASCII order without inserts: letter, cost, next state."""
    out = [("D", DELETE, state)]
    if symbol < 8:
        extra = TRUNCATED if symbol & 4 else 0
        kept = takes(state, symbol & 3)
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, TURN[state]))
    return out


CHOICES = {(s, x): choices(s, x) for s in range(4) for x in range(16)}


def closed(v: list[float]) -> tuple[float, ...]:
    """Least costs if rows may be inserted first; more than one insert in a row only helps from nothing or system."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def back(symbol: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """Least costs before a row from those behind it."""
    return closed([min(c + after[t] for _, c, t in CHOICES[s, symbol]) for s in range(4)])


def checkpoints(symbols: bytes, end: tuple[float, ...]) -> tuple[int, list[tuple[float, ...]]]:
    """Block length (the square root) and the state costs at the start of every block, with `end` behind the last one."""
    size = max(1, isqrt(len(symbols)))
    marks, v = [end], end
    for i in range(len(symbols) - 1, -1, -1):
        v = back(symbols[i], v)
        if i % size == 0:
            marks.append(v)
    return size, marks[::-1]


def matrix(symbols: bytes) -> list[tuple[float, ...]]:
    """For each state behind the run, the least costs from the states before it; four passes without any stored vector."""
    out = []
    for e in range(4):
        v = tuple(0 if s == e else inf for s in range(4))
        for x in reversed(symbols):
            v = back(x, v)
        out.append(v)
    return out


def chained(m: list[tuple[float, ...]], after: tuple[float, ...]) -> tuple[float, ...]:
    return tuple(min(m[e][s] + after[e] for e in range(4)) for s in range(4))


def walk(symbols: bytes, state: int, end: tuple[float, ...], last: bool) -> tuple[str, int]:
    """The ASCII-least edits among the cheapest, and the state they leave. Only checkpoints are kept; each block is computed again.

    The state costs decide: an edit is tight if its cost and those behind it add up. D < I < K < R, and an end is less than any edit."""
    size, marks = checkpoints(symbols, end)
    out = []
    for b in range(len(marks) - 1):
        part = symbols[b * size : (b + 1) * size]
        vectors = [marks[b + 1]]
        for x in reversed(part):
            vectors.append(back(x, vectors[-1]))
        for i, x in enumerate(part):
            here, after = vectors[-1 - i], vectors[-2 - i]
            while True:
                left = here[state]
                if DELETE + after[state] == left:
                    out.append("D")
                    break
                # an insert is tight if none of the row's own edits is cheaper from the state it leads to
                if INSERT + here[TURN[state]] == left:
                    out.append("I")
                    state = TURN[state]
                    continue
                letter, _, state = next(c for c in CHOICES[state, x] if c[1] + after[c[2]] == left)
                out.append(letter)
                break
    while last and state in (SYSTEM, USER):
        out.append("I")
        state = TURN[state]
    return "".join(out), state


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: conv_id, turn, role, text, no nulls in role and text.

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes out [.!?], 3 repeats it, 4 sets role user.
    Nulls count as one space, in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(r == 1, "").when(r == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    got = rows.select("conv_id", "turn", F.when(r == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), r.alias("r")).where("r <> 0")
    return got.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("r") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


WHITE = " \t\n\x0b\x0c\r"


def faults(text: Column) -> tuple[Column, Column]:
    """blank, truncated."""
    end = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return end == "", ~end.isin("", ".", "!", "?")


def sequences(rows: DataFrame) -> DataFrame:
    """Slim rows in the order of their conversations, written once: conv_id, turn, symbol, fault (0 to 3), n.

    Equal rows of a turn are one with a count. Order: conversation, turn (nulls first), role, digest of the text; partitions are ranges
    of that order, so a conversation of any size is spread over them and each holds whole runs. A row is a duplicate if its role and text
    stand in an earlier turn, and every further copy in its turn is one."""
    blank, cut_off = faults(F.col("text"))
    slim = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), blank.alias("blank"), cut_off.alias("truncated"))
    slim = slim.groupBy("conv_id", "turn", "role", "h", "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    # texts that stand in one turn only need no look at the others
    first = slim.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    again = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)) & F.col("first").isNotNull()
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("truncated"), 3).otherwise(0)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == k, v) for k, v in INITIALS.items()], F.lit(3))
    symbol = initial + F.when(fault == 3, 4).when(fault != 0, 8).otherwise(0)
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "h"]
    marked = slim.select(*order, symbol.cast("int").alias("symbol"), fault.alias("fault"), "n")
    fixed = cut(marked.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    return fixed.select("conv_id", "turn", "symbol", "fault", "n", F.spark_partition_id().alias("part"))


class Run:
    """The rows of one conversation inside one partition."""

    def __init__(self, conv, part: int, nth: int) -> None:
        self.conv, self.part, self.nth, self.symbols = conv, part, nth, bytearray()
        self.faults, self.first, self.last = [0, 0, 0, 0], None, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, symbol: int, fault: int, n: int) -> None:
        self.first = turn if not self.symbols else self.first
        self.turns += turn is not None and (not self.symbols or turn != self.last)
        self.last = turn
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.symbols.append(symbol)
        self.faults[fault] += 1
        if n > 1:  # further copies go
            self.symbols += bytes([symbol & 3 | 8]) * (n - 1)
            self.faults[1 if fault == 1 else 2] += n - 1


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Run, bool]]:
    """The runs of a partition in order, and whether each is the last one."""
    run = None
    for batch in batches:
        for conv, turn, symbol, fault, n, part in zip(*[c.to_pylist() for c in batch.columns]):
            if run is None or run.conv != conv:
                if run is not None:
                    yield run, False
                run = Run(conv, part, 0 if run is None else run.nth + 1)
            run.add(turn, symbol, fault, n)
    if run is not None:
        yield run, True


def borders(seq: DataFrame) -> dict[tuple[int, bool], tuple[int, tuple[float, ...], bool]]:
    """For the runs that a partition's border cuts: state before, costs behind, whether the conversation ends there.

    Keys are (partition, whether it is the partition's last run). The driver gets at most two matrices a partition."""
    kind = seq.schema["conv_id"].dataType.simpleString()

    def ends(batches):
        rows = []
        for run, last in runs(batches):
            if run.nth == 0 or last:
                rows.append((run.conv, run.part, run.nth == 0, last, [x for column in matrix(bytes(run.symbols)) for x in column]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=["conv_id", "part", "head", "tail", "m"])

    arrow = (ARROW[kind], pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()))
    found = sorted(seq.mapInArrow(ends, f"conv_id {kind}, part int, head boolean, tail boolean, m array<double>").collect(), key=lambda r: (r["part"], r["tail"]))
    chains: list[list] = []
    for r in found:
        before = chains[-1][-1] if chains else None
        if before is not None and before["tail"] and r["head"] and before["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    behind = {}
    for chain in chains:
        v = tuple(map(float, END))
        for r in reversed(chain):
            behind[r["part"], r["tail"]] = v
            v = chained([tuple(r["m"][4 * e : 4 * e + 4]) for e in range(4)], v)
    if not behind:
        return {}

    def exits(batches):
        rows = []
        for run, last in runs(batches):
            end = behind.get((run.part, last)) if run.nth == 0 or last else None
            if end is not None:
                rows.append((run.part, last, [walk(bytes(run.symbols), s, end, False)[1] for s in range(4)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.list_(pa.int32())))], names=["part", "tail", "to"])

    to = {(r["part"], r["tail"]): r["to"] for r in seq.mapInArrow(exits, "part int, tail boolean, to array<int>").collect()}
    out = {}
    for chain in chains:
        state = START
        for r in chain:
            key = (r["part"], r["tail"])
            out[key] = (state, behind[key], r is chain[-1])
            state = to[key][state]
    return out


PIECE = "part int, turns bigint, low bigint, high bigint, first bigint, last bigint, initials string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, cost bigint, audit string"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def pieces(seq: DataFrame) -> DataFrame:
    """One row per conversation and partition: its edits and counts there."""
    known = borders(seq)
    kind = seq.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[c.split()[0] for c in PIECE.split(", ")]]

    def solve(batches):
        rows = []
        for run, last in runs(batches):
            state, end, ends = known.get((run.part, last), (START, END, True)) if run.nth == 0 or last else (START, END, True)
            symbols = bytes(run.symbols)
            audit, _ = walk(symbols, state, end, ends)
            stay = sum(1 for letter, x in zip((c for c in audit if c != "I"), symbols) if letter != "D" and x & 4)
            cost = DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R") + TRUNCATED * stay
            own = [x & 3 for x in symbols]
            illegal = sum(p not in LEGAL for p in zip(own, own[1:]))
            rows.append((run.conv, run.part, run.turns, run.low, run.high, run.first, run.last, f"{own[0]}{own[-1]}", illegal, *run.faults[1:], cost, audit))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    schema = pa.schema([("conv_id", ARROW[kind]), *[(c.split()[0], ARROW[c.split()[1]]) for c in PIECE.split(", ")]])
    return seq.mapInArrow(solve, f"conv_id {kind}, {PIECE}")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, turn, role, text (other columns are ignored). A conversation is taken by turn, nulls first; rows of one turn by role
    and text digest. audit holds the initials of the cheapest edits (Keep, Rerole, Delete, Insert) that leave roles `(s?(ua)+)?`, the
    ASCII-least if several are as cheap. Null roles and texts are one space: an unknown role, a blank text. A null conv_id is a
    conversation like any other. A conversation may hold any share of all rows: it is cut at the partitions' borders."""
    part = pieces(sequences(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])))
    # as many entries per conversation as partitions hold parts of it
    joined = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c.split()[0] for c in PIECE.split(", ")]))).alias("p"))
    total = lambda c: F.aggregate(F.col(f"p.{c}"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    pairs = F.when(F.size("p") > 1, pairs)
    counted = lambda test: F.coalesce(F.size(F.filter(pairs, test)), F.lit(0)).cast("bigint")
    shared = counted(lambda x: F.coalesce(x["a"]["last"] == x["b"]["first"], F.lit(False)))
    over = counted(lambda x: ~F.concat(F.substring(x["a"]["initials"], 2, 1), F.substring(x["b"]["initials"], 1, 1)).isin("01", "12", "21"))
    spread = F.array_max("p.high") - F.array_min("p.low") + 1
    return joined.select(
        "conv_id", F.coalesce(spread - (total("turns") - shared), F.lit(0).cast("bigint")).alias("gaps"), *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + over).alias("illegal"), total("cost").alias("cost"), F.concat_ws("", "p.audit").alias("audit"))


class Digest:
    """SHA-256 of the repaired `role:text` lines of one conversation, fed row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.sum, self.written, self.state = audit, 0, hashlib.sha256(), False, START

    def write(self, role: str, text: str) -> None:
        self.sum.update((f"\n{role}:{text}" if self.written else f"{role}:{text}").encode())
        self.written = True

    def turn(self) -> str:
        self.state = TURN[self.state]
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.write(self.turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.write(self.turn(), text)
        elif letter == "K":
            if role[:1] == "s":
                self.state = SYSTEM
            else:
                self.turn()
            self.write(role, text)

    def end(self) -> str:
        self.inserts()
        return self.sum.hexdigest()


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256. A digest takes its bytes in order, so a conversation's rows pass one task as a sorted stream; the
    task holds one row, the audit and the state of the hash."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), "text")
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), F.col("audit").alias("text"))
    flow = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")

    def run(batches):
        conv, open_ = None, None
        for batch in batches:
            done = []
            for c, k, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")]):
                if k == 0:
                    if open_ is not None:
                        done.append((conv, open_.end()))
                    conv, open_ = c, Digest(text)
                else:
                    open_.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("conv_id").type), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
            kept = batch.schema.field("conv_id").type
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kept), pa.array([open_.end()])], names=["conv_id", "repaired_sha256"])

    return flow.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


COUNTED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit(conversations: DataFrame) -> DataFrame:
    """Every original conv_id with what the damage left of it: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Conversations without rows after the damage have zeros, an empty audit and the hash of the empty string."""
    rows = damaged(conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text"))
    found = cut(repaired(rows))
    hashed = digests(rows, found.select("conv_id", "audit"))
    ids = conversations.select("conv_id").distinct().alias("i")
    got = ids.join(found.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left").join(hashed.alias("h"), F.expr("i.conv_id <=> h.conv_id"), "left")
    return got.select("i.conv_id", *[F.coalesce(f"f.{c}", F.lit(0).cast("bigint")).alias(c) for c in COUNTED], F.coalesce("f.audit", F.lit("")).alias("audit"),
                      F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
