"""Conversation structure repair by iterative-deepening A*.

A conversation is sound when its turns' role initials read `(s?(ua)+)?`. Walking its rows in order, a repair deletes a row (D, 3),
inserts an empty user or assistant turn (I, 2), keeps a row (K, 0) or gives it the role user or assistant (R, 2); a blank row and a
repeated one must go, and a truncated one that stays costs 1 more. The cheapest repair is looked for by depth-first search in ASCII
order of the edits under a bound on the cost; when it fails, the bound rises to the least cost that was cut off. Each state (row,
place in the pattern) keeps the highest budget with which it has failed, as the least that a way from it can still cost; a
state met again with no more is not entered. So the first accepting path is the cheapest, and of the cheapest the ASCII-least.
The heuristic adds up what every row must cost and, for rows and neighbours that can't stay side by side, the cheapest edit (of disjoint pairs).

Long conversations: rows are sorted by range over (conversation, turn, role, text) and cut into blocks of BLOCK rows. A conversation inside
a block is solved at once. One that reaches a block's edge gives, for its part, the least cost from each place in the pattern to each;
from the end of the conversation backwards these become the least cost still to come after each part, with which every part
is solved alone for each way in; forwards the way in is picked. Both walks keep four numbers in memory, and paths of different parts can
be compared one by one, as each row has exactly one letter other than I. No task holds more than a block.
Only the digest of a conversation's text, a sequential hash, streams through one task in order, row after row.

Defined results: in a damaged table a null role or text is one space; a null conversation id is a conversation of its own; a null turn comes first;
rows of equal turn are ordered by role, then the text's first HEAD characters, then its digest; equal rows are turns of their own, all but
the first duplicates; a role that begins with none of s, u, a can't be kept, nor can an empty one; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.lookup import lookup
from sparktab.functions.order import order_stage
from sparktab.llm.common import keep, null_key, query, table

DELETE, INSERT, KEEP, REROLE, CUT = 3, 2, 0, 2, 1
BLOCK = 128
HEAD = 32
FINE, BLANK, REPEATED, TRUNCATED = range(4)          # faults
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # places in the pattern: start, after s, after u, after a
GIVEN = ("u", "u", "a", "u")                          # role that an insert or rerole gives in each place
END = (0, 2 * INSERT, INSERT, 0)                      # cost of ending there
TAIL = ("", "II", "I", "")
WHITE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def edits(initial: str, fault: int, place: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows taken, next place) in ASCII order."""
    given = STEP[place][GIVEN[place]]
    out = [("D", DELETE, 1, place), ("I", INSERT, 0, given)]
    if fault not in (BLANK, REPEATED):
        more = CUT if fault == TRUNCATED else 0
        if initial in STEP[place]:
            out.append(("K", KEEP + more, 1, STEP[place][initial]))
        out.append(("R", REROLE + more, 1, given))
    return out


_EDITS = {(i, f): [edits(i, f, p) for p in range(4)] for i in ("s", "u", "a", "?") for f in range(4)}
_LEGAL = {"su", "ua", "au"}


def forced(rows: list[tuple[str, int]]) -> list[int]:
    """Least cost of the rows from each place on, whatever their neighbours become."""
    n = len(rows)
    sure, clash = [0] * (n + 1), [0] * (n + 2)
    stays = [f not in (BLANK, REPEATED) for _, f in rows]
    for i in range(n - 1, -1, -1):
        sure[i] = sure[i + 1] + (DELETE if not stays[i] else CUT if rows[i][1] == TRUNCATED else 0)
        clash[i] = clash[i + 1] + (1 if stays[i] and rows[i][0] == "?" else 0)
        if i + 1 < n and stays[i] and stays[i + 1] and rows[i][0] + rows[i + 1][0] not in _LEGAL:
            clash[i] = max(clash[i], 1 + clash[i + 2])
    return [a + 2 * b for a, b in zip(sure, clash)]


class Search:
    """Cheapest repairs of rows (initial, fault) from any place, where ending in place p costs end[p] more."""

    def __init__(self, rows: list[tuple[str, int]], end: tuple[float, ...] | list[float]):
        self.moves = [_EDITS[r] for r in rows]
        self.most = DELETE * len(rows) + 2 * INSERT + CUT + max((e for e in end if e < math.inf), default=0)  # of any cheapest way
        self.least = [[h + min(end)] * 4 for h in forced(rows)[:-1]] + [list(end)]  # of a way from (row, place): the failed states' table

    def run(self, entry: int) -> tuple[int, str] | None:
        """(cost, letters) of the first accepting path; None if there is no way."""
        while (bound := self.least[0][entry]) <= self.most:
            if (path := self._within(entry, bound)) is not None:
                return int(bound), path
        return None

    def _within(self, entry: int, bound: float) -> str | None:
        least, moves, n = self.least, self.moves, len(self.moves)
        trail, path = [[0, entry, bound, 0]], []
        while trail:
            at = trail[-1]
            row, place, left, k = at
            if row == n:
                return "".join(path)
            options = moves[row][place]
            while k < len(options):
                letter, cost, taken, then = options[k]
                k += 1
                if cost + least[row + taken][then] <= left:
                    at[3] = k
                    trail.append([row + taken, then, left - cost, 0])
                    path.append(letter)
                    break
            else:
                least[row][place] = max(least[row][place], min(c + least[row + t][p] for _, c, t, p in options))
                trail.pop()
                if path:
                    path.pop()
        return None


def by_row(path: str, rows: list[tuple[str, int]], entry: int, last: bool) -> tuple[list[str], list[str], int]:
    """(letters of each row with the inserts before it, roles they give or -, place at the end); the last row takes the closing inserts."""
    letters, roles, place, held, given = [], [], entry, "", ""
    for x in path:
        held += x
        given += GIVEN[place] if x in "IR" else "-"
        if x != "I":
            initial = rows[len(letters)][0]
            letters.append(held)
            roles.append(given)
            held = given = ""
        place = place if x == "D" else STEP[place][GIVEN[place] if x in "IR" else initial]
    if last:
        for x in TAIL[place]:
            letters[-1] += x
            roles[-1] += GIVEN[place]
            place = STEP[place][GIVEN[place]]
    return letters, roles, place


@dataclass
class Part:
    """Rows of one conversation in one block."""
    conv: str
    rows: list[tuple[str, int]]

    @classmethod
    def packed(cls, conv: str, codes: str) -> Part:
        return cls(conv, [(codes[i], int(codes[i + 1])) for i in range(0, len(codes), 2)])

    def codes(self) -> str:
        return "".join(f"{i}{f}" for i, f in self.rows)

    def costs(self) -> list[float]:
        """Least cost from each place to each, 16 numbers."""
        out = [math.inf] * 16
        for to in range(4):
            search = Search(self.rows, [0 if p == to else math.inf for p in range(4)])
            opened = any(r == ("s", f) for r in self.rows for f in (FINE, TRUNCATED))
            ways = ((0,), (0, 1) if opened else (1,), range(4), range(4))[to]  # nothing comes back to the start or to the turn after it
            for entry in ways:
                if (found := search.run(entry)) is not None:
                    out[4 * entry + to] = found[0]
        return out


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _emit(held, schema)
            held = []
    if held:
        yield _emit(held, schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_SOLVED = pa.schema([("conv", pa.string()), ("_pid", pa.int64()), ("rid", pa.int64()), ("last", pa.bool_()), ("codes", pa.string()),
                     ("costs", pa.list_(pa.float64())), ("letters", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))])
_SOLVED_SQL = "conv string, _pid bigint, rid bigint, last boolean, codes string, costs array<double>, letters array<string>, roles array<string>"


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_pid, blk, _rid, conv, initial, fault): conversations inside a block solved, parts at its edges with their costs."""
    def block(rows: list[tuple]) -> Iterator[tuple]:
        starts = [i for i, r in enumerate(rows) if not i or r[3] != rows[i - 1][3]]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            part = Part(rows[a][3], [(r[4], r[5]) for r in rows[a:b]])
            if a and b < len(rows):
                _, path = Search(part.rows, END).run(0)
                letters, roles, _ = by_row(path, part.rows, 0, True)
                yield part.conv, rows[a][0], rows[a][2], True, None, None, letters, roles
            else:
                yield part.conv, rows[a][0], rows[a][2], False, part.codes(), part.costs(), None, None

    def each() -> Iterator[tuple]:
        held: list[tuple] = []
        for row in _records(batches):
            if held and row[:2] != held[0][:2]:
                yield from block(held)
                held = []
            held.append(row)
        if held:
            yield from block(held)
    return _batched(each(), _SOLVED)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each conversation from the last to the first: `costs` becomes the least cost after the part, by the place it ends in."""
    def each() -> Iterator[tuple]:
        now, rest = None, list(END)
        for conv, pid, rid, _, codes, costs, _, _ in _records(batches):
            last = conv != now
            if last:
                now, rest = conv, list(END)
            yield conv, pid, rid, last, codes, rest, None, None
            rest = [min(costs[4 * a + b] + rest[b] for b in range(4)) for a in range(4)]
    return _batched(each(), _SOLVED)


_WAYS = pa.schema([("conv", pa.string()), ("_pid", pa.int64()), ("rid", pa.int64()), ("exits", pa.list_(pa.int32())),
                   ("letters", pa.list_(pa.list_(pa.string()))), ("roles", pa.list_(pa.list_(pa.string())))])


def _solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part for each way in, knowing what comes after."""
    def each() -> Iterator[tuple]:
        for conv, pid, rid, last, codes, rest, _, _ in _records(batches):
            part = Part.packed(conv, codes)
            search, exits, letters, roles = Search(part.rows, rest), [], [], []
            for entry in range(4):
                found = search.run(entry)
                own = by_row(found[1], part.rows, entry, last) if found else ([], [], -1)
                letters.append(own[0])
                roles.append(own[1])
                exits.append(own[2])
            yield conv, pid, rid, exits, letters, roles
    return _batched(each(), _WAYS, 100)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each conversation from the first to the last: the way in that the part before leaves."""
    def each() -> Iterator[tuple]:
        now, place = None, 0
        for conv, pid, rid, exits, letters, roles in _records(batches):
            if conv != now:
                now, place = conv, 0
            yield conv, pid, rid, True, None, None, letters[place], roles[place]
            place = exits[place]
    return _batched(each(), _SOLVED, 100)


def marked(turns: DataFrame) -> DataFrame:
    """Sorted rows conv, conv_id, turn, role, text, initial, fault, pos, _pid, _rid (a written stage)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(null_key(F.col("conv_id")).alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.md5("text")})
    rows = order_stage(rows, ["conv", "turn", "role", "head", "digest"]).drop("head")
    body = F.rtrim("text", F.lit(WHITE))
    first = F.substring("role", 1, 1)
    rows = rows.select("conv", "conv_id", "turn", "role", "text", F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"), first.alias("letter"),
                       F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("own"),
                       F.md5(F.concat_ws("\u0000", F.length("conv").cast("string"), "conv", F.length("role").cast("string"), "role", "digest")).alias("same"),
                       F.col("_pid").cast("bigint").alias("_pid"), F.col("_rid").cast("bigint").alias("_rid"),
                       (F.shiftleft(F.col("_pid").cast("bigint"), 33) + F.col("_rid")).alias("pos"))
    total = max(rows.count(), 1)
    again = (rows.filter(F.col("own") != BLANK).groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("same", "first", (F.col("n") / total).alias("share")))  # repeated rows only; hot ones travel by broadcast
    fault = F.when((F.col("own") != BLANK) & (F.col("pos") > F.col("first")), REPEATED).otherwise(F.col("own"))
    return lookup(rows, again, "same", ["first"], weight="share").withColumn("fault", fault).drop("same", "own", "first")


def plan(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """pos, letters, roles of every row of `marked`: its edit with the inserts before it (behind the last row: after it, too)."""
    narrow = rows.select("_pid", F.floor(F.col("_rid") / block).alias("blk"), "_rid", "conv", "initial", "fault")
    found = keep(narrow.repartition("_pid", "blk").sortWithinPartitions("_pid", "blk", "_rid").mapInArrow(_solve_blocks, _SOLVED_SQL), "repair-blocks")
    edge = found.filter(F.col("codes").isNotNull())
    rest = (edge.repartition("conv").sortWithinPartitions("conv", F.desc("_pid"), F.desc("rid")).mapInArrow(_rest, _SOLVED_SQL))
    ways = (rest.repartition("_pid", "rid")
            .mapInArrow(_solve_parts, "conv string, _pid bigint, rid bigint, exits array<int>, letters array<array<string>>, roles array<array<string>>"))
    edge = ways.repartition("conv").sortWithinPartitions("conv", "_pid", "rid").mapInArrow(_pick, _SOLVED_SQL)
    each = found.filter(F.col("codes").isNull()).unionByName(edge)
    each = each.select("_pid", "rid", F.posexplode(F.arrays_zip("letters", "roles")).alias("i", "x"))
    return each.select((F.shiftleft("_pid", 33) + F.col("rid") + F.col("i")).alias("pos"), F.col("x.letters").alias("letters"), F.col("x.roles").alias("roles"))


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, conv_id, turn, position, sub, edit (D, I, K, R), fault, letter (initial before), role, text, cost of every row and inserted turn.

    The repaired conversation is the rows whose edit isn't D, in the order (position, sub).
    """
    rows = keep(marked(turns), "repair-rows")
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    steps = F.sequence(F.lit(1), F.length("letters"))
    each = rows.join(plan(rows, block), "pos").withColumn("sub", F.explode(steps)).withColumn("edit", F.expr("substring(letters, sub, 1)"))
    given, insert = F.expr("substring(roles, sub, 1)"), F.col("edit") == "I"
    cost = F.when(F.col("edit") == "D", DELETE).when(insert, INSERT).otherwise(
        F.when(F.col("edit") == "R", REROLE).otherwise(KEEP) + F.when(F.col("fault") == TRUNCATED, CUT).otherwise(0))
    return each.select("conv", "conv_id", F.when(~insert, F.col("turn")).alias("turn"), F.col("pos").alias("position"), "sub", "edit",
                       F.when(~insert, F.col("fault")).alias("fault"), F.when(~insert, F.col("letter")).alias("letter"),
                       F.when(given == "-", F.col("role")).otherwise(name[given]).alias("role"), F.when(insert, "").otherwise(F.col("text")).alias("text"),
                       cost.cast("bigint").alias("cost"))


def summary(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row per conversation of `turns`: counts of faults, cost, audit and digest of `repaired`, streamed in order."""
    seen = turns.select(null_key(F.col("conv_id")).alias("conv"), "conv_id").distinct()
    empty = [F.lit(None).cast(repaired.schema[c].dataType).alias(c) for c in ("turn", "sub", "edit", "fault", "letter", "role", "text", "cost")]
    rows = repaired.unionByName(seen.select("conv", "conv_id", F.lit(-1).cast("bigint").alias("position"), *empty))
    rows = rows.select("conv", "conv_id", "turn", "edit", "fault", "letter", "role", "text", "cost", "position", "sub")
    kind = turns.schema["conv_id"].dataType.simpleString()
    shape = pa.schema([rows.select("conv_id").limit(0).toArrow().schema.field(0),
                       *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                       ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            now = None
            for conv, conv_id, turn, edit, fault, letter, role, text, cost, _, _ in _records(batches):
                if conv != now:
                    if now is not None:
                        yield close()
                    now, who, turns_, last_turn, low = conv, conv_id, 0, None, None
                    faults, illegal, before, total, audit, body, started = [0] * 4, 0, None, 0, [], hashlib.sha256(), False

                    def close() -> tuple:
                        gap = last_turn - low + 1 - turns_ if low is not None else 0
                        return who, gap, faults[BLANK], faults[REPEATED], faults[TRUNCATED], illegal, total, "".join(audit), body.hexdigest()
                if edit is None:
                    continue
                audit.append(edit)
                total += cost
                if edit != "I":
                    faults[fault] += 1
                    if turn is not None and turn != last_turn:
                        low, last_turn, turns_ = turn if low is None else low, turn, turns_ + 1
                    if before is not None and before + letter not in _LEGAL:
                        illegal += 1
                    before = letter
                if edit != "D":
                    body.update((("\n" if started else "") + f"{role}:{text}").encode())
                    started = True
            if now is not None:
                yield close()
        return _batched(each(), shape)

    return (rows.repartition("conv").sortWithinPartitions("conv", "position", "sub")
            .mapInArrow(run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"))


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of `conv_id:turn`: dropped, emptied, without sentence ends, repeated, role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("copy", F.explode(times)).drop("copy", "kind"))


#: The same by dynamic programming over (row, place) in one statement; texts and conversation ids of any kind, turns as whole numbers.
SQL = f"""
with recursive keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hashed as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: cast(ascii(ch) as bigint))), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as kind from keyed),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy from hashed where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, left(text, {HEAD}), md5(text), copy) as i,
    count(*) over (partition by conv_id) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from hurt),
rows_ as materialized (select conv_id, turn, role, text, i, n, left(role, 1) as letter, lead(left(role, 1)) over (partition by conv_id order by i) as follow,
    case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault
    from placed),
step(place, letter, then_) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given(place, who, then_) as (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
ins(place, pre, lines, then_) as (select place, '', '', place from given union all select place, 'I', who || ':', then_ from given
    union all select g.place, 'II', g.who || ':' || chr(10) || h.who || ':', h.then_ from given g join given h on g.then_ = h.place),
way as (select distinct conv_id, n, 0 as i, 0 as place, 0 as c, '' as a, '' as t from rows_
  union all
  select conv_id, n, i, place, c, a, t from (select *, row_number() over (partition by conv_id, place order by c, a) as best from (
    select w.conv_id, w.n, r.i, o.then_ as place, w.c + 2 * length(p.pre) + o.cost as c, w.a || p.pre || o.edit as a,
      w.t || case when w.t <> '' and p.lines <> '' then chr(10) else '' end || p.lines
        || case when o.line is null then '' else case when w.t <> '' or p.lines <> '' then chr(10) else '' end || o.line end as t
    from way w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join ins p on p.place = w.place
    join lateral (select 'D' as edit, 3 as cost, p.then_ as then_, null as line
      union all select 'K', case when r.fault = 3 then 1 else 0 end, s.then_, r.role || ':' || r.text from step s where s.place = p.then_ and s.letter = r.letter and r.fault in (0, 3)
      union all select 'R', case when r.fault = 3 then 3 else 2 end, g.then_, g.who || ':' || r.text from given g where g.place = p.then_ and r.fault in (0, 3)) o on true)) where best = 1),
done as (select conv_id, c + case place when 1 then 4 when 2 then 2 else 0 end as cost, a || case place when 1 then 'II' when 2 then 'I' else '' end as audit,
    t || case place when 1 then chr(10) || 'user:' || chr(10) || 'assistant:' when 2 then chr(10) || 'assistant:' else '' end as t from way where i = n),
best as (select * from done qualify row_number() over (partition by conv_id order by cost, audit) = 1),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (follow is not null and letter || follow not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
  cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost,
  coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join told on told.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id"""


@query("op12_conversation_repair", SQL)
def op12_conversation_repair(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return summary(turns, repair(damage(turns)))
