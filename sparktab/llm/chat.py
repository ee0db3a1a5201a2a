"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, and ends with the assistant. Every
turn is given a role; it opens a new turn, is merged with the turn before (same role), or has one empty turn
inserted before it. Dynamic programming over the automaton's four states (start, system, user, assistant) finds the
cheapest repair; the repaired turns are then rendered.

A turn's costs are a 4 x 4 matrix from state to state, and matrices combine by (min, +), so a long conversation is
cut: turns are sorted by range into chunks of at most CHUNK, each chunk is reduced to one matrix, the chunks' matrices
give each chunk its entry and exit state, and each chunk is solved by itself. Neither a conversation nor its text is ever
in one task; only 16 numbers per chunk of it are.

Defined results: rows with a null conversation id are one conversation; turns are ordered by turn (null first), equal turn
numbers by a hash of role and text; null text is empty text; a role that isn't known costs OTHER to label; equal rows are
turns of their own; of repairs with equal costs any one is taken; an empty table gives an empty result. Other columns are ignored. The output has a row per source
turn and per inserted turn, so a merged or rendered conversation of any length is spread over rows: joining `rendered` in
the order (conv_id, position, sub) gives the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.order import order_stage
from sparktab.llm.common import keep, null_key, query, table

MERGE, INSERT, RELABEL, OTHER = 1, 3, 4, 1
CHUNK = 4096
ROLES = ("system", "user", "assistant")       # states 1 to 3; 0 is the start
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "developer": "system"}
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # legal next turns
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
_FAR = 10 ** 12


def _step(s: int, a: int) -> tuple[int, bool, int]:
    """(cost, merged, role inserted before or 0) of a turn of role a in state s."""
    if a in NEXT[s]:
        return 0, False, 0
    if s == a:
        return MERGE, True, 0
    for x in NEXT[s]:
        if a in NEXT[x]:
            return INSERT, False, x
    return _FAR, False, 0


STEP = [[_step(s, a) for a in range(4)] for s in range(4)]
for _row in STEP:
    _row[0] = (_FAR, False, 0)
LABEL = [[0 if k == a else RELABEL for a in range(4)] for k in range(4)]  # by the turn's own role; 0: not known
LABEL[0] = [OTHER] * 4
COST = np.array([[[STEP[s][a][0] + LABEL[k][a] for a in range(4)] for s in range(4)] for k in range(4)])
END = [0, 2 * INSERT, INSERT, 0]               # what is missing after the last turn
MISSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def transfer(kinds: list[int]) -> np.ndarray:
    """Least costs from state to state over a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for k in kinds:
        out = (out[:, :, None] + COST[k][None, :, :]).min(axis=1)
    return out


def ends(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the cheapest way through all."""
    ahead = [np.array([0, _FAR, _FAR, _FAR])]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).min(axis=0))
    state, out = int(np.argmin(ahead[-1] + np.array(END))), []
    for m, before in zip(reversed(matrices), reversed(ahead[:-1])):
        entry = int(np.argmin(before + m[:, state]))
        out.append((entry, state))
        state = entry
    return out[::-1]


def solve(kinds: list[int], entry: int, exit_: int) -> list[tuple[int, bool, int]]:
    """(role, merged, role inserted before or 0) of each turn on the cheapest way from entry to exit."""
    cost, back = np.full(4, _FAR), []
    cost[entry] = 0
    for k in kinds:
        both = cost[:, None] + COST[k]
        back.append(both.argmin(axis=0))
        cost = both.min(axis=0)
    state, out = exit_, []
    for at in reversed(back):
        before = int(at[state])
        _, merged, inserted = STEP[before][state]
        out.append((state, merged, inserted))
        state = before
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first `keys` columns, in sorted batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = -1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[chars]) if chars >= 0 else 0
        if len(held) >= 5000 or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, position, sub, role_in, role, action, text, rendered of every source and inserted turn."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    for name, of in ALIASES.items():
        role = F.when(role == name, of).otherwise(role)
    kind = F.coalesce(*[F.when(role == name, i + 1) for i, name in enumerate(ROLES)], F.lit(0))
    rows = turns.select(null_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
                        kind.alias("kind"), F.xxhash64("role", "text").alias("tie"))
    rows = order_stage(rows, ["conv", "turn", "tie"]).drop("tie").withColumn("blk", F.floor(F.col("_rid") / chunk))
    cut = ["_pid", "blk", "conv"]

    shape = pa.schema([("_pid", pa.int64()), ("blk", pa.int64()), ("conv", pa.string()), ("costs", pa.list_(pa.int64()))])

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*run[0][:3], transfer([r[4] for r in run]).ravel().tolist()) for run in _runs(batches, 3))
        return _batches(found, shape)

    narrow = rows.select(F.col("_pid").cast("bigint").alias("_pid"), F.col("blk").cast("bigint").alias("blk"), "conv", "_rid", "kind")
    chunks = (narrow.repartition("_pid", "blk").sortWithinPartitions("_pid", "blk", "conv", "_rid")
              .mapInArrow(reduce_, "_pid bigint, blk bigint, conv string, costs array<bigint>"))

    ways = pa.schema([("_pid", pa.int64()), ("blk", pa.int64()), ("conv", pa.string()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for run in _runs(batches, 1):
                states = ends([np.array(r[3]).reshape(4, 4) for r in run])
                for i, (r, (entry, exit_)) in enumerate(zip(run, states)):
                    yield r[1], r[2], r[0], entry, exit_, i == len(run) - 1
        return _batches(each(), ways)

    via = keep(chunks.select("conv", "_pid", "blk", "costs").repartition("conv").sortWithinPartitions("conv", "_pid", "blk")
               .mapInArrow(chain, "_pid bigint, blk bigint, conv string, entry int, exit int, last boolean"), "chat-chunks")

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    result = (f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, position bigint, sub int, role_in string, role string, action string, "
              "text string, rendered string")
    from_spark = turns.select("conv_id", "turn").limit(0).toArrow().schema

    shown = pa.schema([from_spark.field("conv_id"), from_spark.field("turn"), ("position", pa.int64()), ("sub", pa.int32()), ("role_in", pa.string()),
                       ("role", pa.string()), ("action", pa.string()), ("text", pa.string()), ("rendered", pa.string())])

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for run in _runs(batches, 3):
                entry, exit_, last = run[0][9:12]
                open_ = entry != 0
                for i, (r, (role_, merged, inserted)) in enumerate(zip(run, solve([x[8] for x in run], entry, exit_))):
                    position, (conv_id, turn, was, text, kind_) = (r[0] << 33) + r[3], r[4:9]
                    if inserted:
                        yield conv_id, None, position, 0, None, ROLES[inserted - 1], "insert", "", (CLOSE if open_ else "") + OPEN.format(ROLES[inserted - 1])
                        open_ = True
                    body = "\n" + text if merged else (CLOSE if open_ else "") + OPEN.format(ROLES[role_ - 1]) + text
                    open_ = True
                    done = last and i == len(run) - 1
                    after = MISSING[role_] if done else ()
                    name = "+".join((["relabel"] if kind_ != role_ else []) + (["merge"] if merged else [])) or "keep"
                    yield conv_id, turn, position, 1, was, ROLES[role_ - 1], name, text, body + (CLOSE if done and not after else "")
                    for j, x in enumerate(after):
                        yield (conv_id, None, position, 2 + j, None, ROLES[x - 1], "insert", "",
                               CLOSE + OPEN.format(ROLES[x - 1]) + (CLOSE if j == len(after) - 1 else ""))
        return _batches(each(), shown, 8)

    whole = rows.withColumns({"_pid": F.col("_pid").cast("bigint"), "blk": F.col("blk").cast("bigint")}).join(via, cut)
    return (whole.select("_pid", "blk", "conv", "_rid", "conv_id", "turn", "role", "text", "kind", "entry", "exit", "last")
            .repartition("_pid", "blk").sortWithinPartitions("_pid", "blk", "conv", "_rid").mapInArrow(act, result))


@query("op8_chat_formatting")
def op8_chat_formatting(spark, folder):
    return repair(table(spark, folder, "conversations"))
