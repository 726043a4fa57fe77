"""Operator 1, chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation; tool turns may follow an assistant's, which then speaks again.  Each turn may be kept, given another role, merged into the
turn before it, or preceded by an inserted empty turn; dynamic programming over
the automaton of turns finds the cheapest repair, ties going to the smallest
state (start, system, user, assistant, tool), then to keeping, merging, inserting.

A conversation of any length is handled in parts of ``PART`` turn numbers: the
least costs from each entry state to each exit state of a part are a 5 x 5
matrix, matrices of one conversation are chained (one row per part), and then
every part is repaired between its own entry and exit state.  Only roles take
part in this; texts meet their repaired roles in one join at the end.

The result has one row per turn; concatenating ``rendered`` over the turns of a
conversation in their order gives the rendered conversation, so one endless
conversation is never one string.

Edge cases: roles are trimmed, lower-cased and mapped by ``ALIASES``; null or
unknown roles are free to take any role at cost ``UNKNOWN``; null text is empty;
turns are ordered by (turn, role, hash of the text); those without a number come
first, in the order of the leading bits of their hash, by which they are dealt
into parts; texts and conversations of any length are rendered whole; repeated
rows are turns of their own; rows with a null conv_id form one conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.shared import written
from motley.session import ship

STATES = ("start", "system", "user", "assistant", "tool")
START, SYSTEM, USER, ASSISTANT, TOOL = range(5)
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "tool": TOOL, "function": TOOL, "observation": TOOL}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT, TOOL)}
RELABEL, UNKNOWN, MERGE, INSERT, PART = 10, 4, 6, 15, 1024
NEVER = 1 << 40
ACTIONS = ("keep", "merge", "insert")


def _steps() -> list[list[tuple[int, int, int, int]]]:
    """For each state after a turn: (state before, action, inserted state or 0, cost without relabelling), best first."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in STATES]
    for s in range(len(STATES)):
        for t in LEGAL[s]:
            out[t].append((s, 0, 0, 0))
        if s != START:
            out[s].append((s, 1, 0, MERGE))
        for y in set(LEGAL[s]) - {TOOL}:
            for t in LEGAL[y]:
                out[t].append((s, 2, y, INSERT))
    return [sorted(steps) for steps in out]


STEPS = _steps()


def relabel(code: int, state: int) -> int:
    """Cost of giving a turn with a role's code a state; nothing else becomes a tool's output lightly."""
    cost = UNKNOWN if code == 0 else 0 if code == state else RELABEL
    return cost + RELABEL if state == TOOL != code else cost


def advance(costs: list[int], code: int) -> tuple[list[int], list[int]]:
    """Costs after one turn and, for each state, the index of the step taken."""
    after, taken = [NEVER], [0]
    for t in range(1, len(STATES)):
        best, at, extra = NEVER, 0, relabel(code, t)
        for k, (s, _, _, cost) in enumerate(STEPS[t]):
            total = costs[s] + cost + extra
            if total < best:
                best, at = total, k
        after.append(best)
        taken.append(at)
    return after, taken


def _groups(batches, keys: list[str], values: list[str]):
    """Runs of equal keys over sorted batches, across their borders: (key, list of value tuples)."""
    now, rows = None, []
    for batch in batches:
        for key, value in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in values))):
            if key != now:
                if now is not None:
                    yield now, rows
                now, rows = key, []
            rows.append(value)
    if now is not None:
        yield now, rows


def _chunks(rows, schema: pa.Schema, size: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


_MATRIX = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("matrix", pa.list_(pa.int64()))])
_PATH = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])
_REPAIR = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("hash", pa.int64()), ("action", pa.int32()), ("state", pa.int32()), ("inserted", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("position", pa.int64())])


def _matrices(batches):
    def run():
        now, vectors = None, []
        for batch in batches:
            for conv, part, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "code"))):
                if (conv, part) != now:
                    if now is not None:
                        yield {"conv": now[0], "part": now[1], "matrix": [c for v in vectors for c in v]}
                    now, vectors = (conv, part), [[0 if s == t else NEVER for t in range(len(STATES))] for s in range(len(STATES))]
                vectors = [advance(v, code)[0] for v in vectors]
        if now is not None:
            yield {"conv": now[0], "part": now[1], "matrix": [c for v in vectors for c in v]}

    return _chunks(run(), _MATRIX)


def _ends(costs: list[int]) -> list[int]:
    """Costs with what it takes to end: a lone system turn needs an inserted user turn."""
    return [NEVER, costs[SYSTEM] + INSERT, *costs[USER:]]


def chain(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """Entry and exit state of each part on the cheapest way from the start to a legal end (any but the start and a system turn)."""
    size = len(STATES)
    costs, back = [0] + [NEVER] * (size - 1), []
    for m in matrices:
        options = [[(costs[s] + m[size * s + t], s) for s in range(size)] for t in range(size)]
        best = [min(o) for o in options]
        costs, back = [min(c, NEVER) for c, _ in best], [*back, [s for _, s in best]]
    end = _ends(costs)
    state, out = end.index(min(end)), []
    for before in reversed(back):
        out.append((before[state], state))
        state = before[state]
    return out[::-1]


def _paths(batches):
    def run():
        for (conv,), rows in _groups(batches, ["conv"], ["part", "matrix"]):
            for k, ((part, _), (entry, leave)) in enumerate(zip(rows, chain([m for _, m in rows]))):
                yield {"conv": conv, "part": part, "entry": entry, "exit": leave, "first": k == 0, "last": k == len(rows) - 1}

    return _chunks(run(), _PATH)


def repair(codes: list[int], entry: int = START, leave: int | None = None) -> list[tuple[int, int, int]]:
    """(action, state, inserted state) of each turn on the cheapest way; ``leave``: the state to end in."""
    costs, taken = [0 if s == entry else NEVER for s in range(len(STATES))], []
    for code in codes:
        costs, step = advance(costs, code)
        taken.append(bytes(step))
    if leave is None:
        end = _ends(costs)
        leave = end.index(min(end))
    out, state = [], leave
    for step in reversed(taken):
        before, action, inserted, _ = STEPS[state][step[state]]
        out.append((action, state, inserted))
        state = before
    return out[::-1]


def _repairs(batches):
    def run():
        for (conv, part, entry, leave, first, last), rows in _groups(batches, ["conv", "part", "entry", "exit", "first", "last"], ["turn", "role", "hash", "code"]):
            found = repair([r[3] for r in rows], entry, leave)
            for k, ((turn, role, digest, _), (action, state, inserted)) in enumerate(zip(rows, found)):
                yield {"conv": conv, "turn": turn, "role": role, "hash": digest, "action": action, "state": state, "inserted": inserted, "first": first and k == 0, "last": last and k == len(rows) - 1, "position": k}

    return _chunks(run(), _REPAIR)


def _code(role: Column) -> Column:
    out = F.lit(0)
    for name, state in ALIASES.items():
        out = F.when(F.lower(F.trim(role)) == name, state).otherwise(out)
    return out.cast("int")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, action, new_role, inserted_role, rendered, position (inside the part)."""
    spark = turns.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    part = F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-(1 << 62)) + F.shiftright("hash", 54))
    slim = written(rows.select("conv", "turn", "role", "hash", part.alias("part"), _code(F.col("role")).alias("code")), "turns")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "part", "turn", "role", "hash")]
    dealt = slim.repartition(parts, "conv", "part").sortWithinPartitions(*order)
    matrices = dealt.mapInArrow(_matrices, "conv long, part long, matrix array<long>")
    paths = matrices.repartition(parts, "conv").sortWithinPartitions(*order[:2]).mapInArrow(_paths, "conv long, part long, entry int, exit int, first boolean, last boolean")
    paths = written(paths, "paths").select(F.col("conv").alias("c"), F.col("part").alias("p"), "entry", "exit", "first", "last")
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    known = slim.join(paths, on).select("conv", "part", "entry", "exit", "first", "last", "turn", "role", "hash", "code")
    shape = "conv long, turn long, role string, hash long, action int, state int, inserted int, first boolean, last boolean, position long"
    repaired = known.repartition(parts, "conv", "part").sortWithinPartitions(*order).mapInArrow(_repairs, shape)
    texts = rows.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("hash").alias("h"), "text").dropDuplicates(["c", "t", "h"])
    full = repaired.join(texts, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("hash") == F.col("h")))
    name = lambda state: F.element_at(F.array(*[F.lit(s) for s in STATES]), state + 1)
    empty = lambda state: F.concat(F.lit("<|"), name(state), F.lit("|>\n<|end|>\n"))
    close = F.when(F.col("first"), "").otherwise("\n<|end|>\n")
    lead = F.when(F.col("action") == 1, "\n").otherwise(F.concat(close, F.when(F.col("action") == 2, empty(F.col("inserted"))).otherwise(""), F.lit("<|"), name(F.col("state")), F.lit("|>\n")))
    tail = F.when(F.col("last"), F.concat(F.lit("\n<|end|>\n"), F.when(F.col("state") == SYSTEM, empty(F.lit(USER))).otherwise(""))).otherwise("")
    done = F.when(F.col("action") > 0, F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action") + 1)).when(_code(F.col("role")) == F.col("state"), "keep").otherwise("relabel")
    return full.select(F.col("conv").alias("conv_id"), "turn", "role", done.alias("action"), name(F.col("state")).alias("new_role"), F.when(F.col("action") == 2, name(F.col("inserted"))).alias("inserted_role"), F.concat(lead, F.col("text"), tail).alias("rendered"), "position")
