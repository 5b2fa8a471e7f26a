"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, the last an assistant's. Dynamic programming over this automaton's states
(the role of the last turn so far) keeps, relabels or merges each given turn and
inserts empty ones, at the least total cost. Costs of a stretch of turns make a
matrix, from state to state, and stretches join by (min, +) products, so that a long
conversation is repaired in pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = (None, "system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
KEEP, MERGE, INSERT, RELABEL = 0, 1, 2, 3
#: Turn numbers of one piece.
PIECE = 256
FOREVER = 1 << 40
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_HEAD, _TAIL = "<|{}|>\n", "\n<|end|>\n"


def role_number(role: str | None) -> int:
    """The state of a role's name; START for one that isn't known."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return NAMES.index(r) if r in NAMES[1:] else START


def _moves() -> list[list[list[tuple[int, tuple[int, ...], int]]]]:
    """moves[role][state]: (state after, roles inserted before, cost) in order of preference."""
    out = []
    for role in range(4):
        by_state = []
        for state in range(4):
            moves = []
            for to in (SYSTEM, USER, ASSISTANT):
                cost = 0 if to == role else RELABEL
                if to == state:
                    moves.append((to, (), cost + MERGE))
                if (state, to) in _LEGAL:
                    moves.append((to, (), cost + KEEP))
                else:
                    moves += [(to, (i,), cost + INSERT) for i in (USER, ASSISTANT) if (state, i) in _LEGAL and (i, to) in _LEGAL]
            by_state.append(moves)
        out.append(by_state)
    return out


MOVES = _moves()
#: Cost, and turns inserted, to end in a state.
ENDS = {START: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def costs(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each state over a stretch of turns."""
    out = []
    for start in range(4):
        best = [0 if s == start else FOREVER for s in range(4)]
        for role in roles:
            new = [FOREVER] * 4
            for state, cost in enumerate(best):
                if cost < FOREVER:
                    for to, _, c in MOVES[role][state]:
                        new[to] = min(new[to], cost + c)
            best = new
        out.append(best)
    return out


def repair(roles: list[int], start: int, end: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """(role, roles inserted before, merged) of each turn, on a cheapest path from start to end."""
    best, back = [[0 if s == start else FOREVER for s in range(4)]], []
    for role in roles:
        new, how = [FOREVER] * 4, [None] * 4
        for state, cost in enumerate(best[-1]):
            if cost < FOREVER:
                for to, inserted, c in MOVES[role][state]:
                    if cost + c < new[to]:
                        new[to], how[to] = cost + c, (state, inserted)
        best.append(new)
        back.append(how)
    out, state = [], end
    for how in reversed(back):
        before, inserted = how[state]
        out.append((state, inserted, before == state and not inserted))
        state = before
    return out[::-1]


def ends(matrices: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each stretch, on a cheapest legal path through all."""
    best, back = [0, FOREVER, FOREVER, FOREVER], []
    for m in matrices:
        new = [min((best[s] + m[s][t], s) for s in range(4)) for t in range(4)]
        back.append([s for _, s in new])
        best = [min(c, FOREVER) for c, _ in new]
    state = min(range(3, -1, -1), key=lambda s: best[s] + ENDS[s][0])
    out = []
    for how in reversed(back):
        out.append((how[state], state))
        state = how[state]
    return out[::-1]


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of one key each, from batches in which rows of a key follow one another; the key comes first."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for _, group in groupby(rows, lambda r: r[:keys]):
        yield list(group)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rendered(group: list[tuple]) -> Iterator[tuple]:
    """(conv, turn, action, inserted, repaired, rendered) of the rows (conv, piece, turn, role, text, before, after, last) of a piece."""
    before, after, last = group[0][5:8]
    given = [role_number(r[3]) for r in group]
    for i, (row, was, (role, inserted, merged)) in enumerate(zip(group, given, repair(given, before, after), strict=True)):
        end = last and i + 1 == len(group)
        at_end = ENDS[after][1] if end else ()
        empty = "".join(_HEAD.format(NAMES[r]) + _TAIL for r in inserted)
        # A turn's end is written by what follows it, or by the conversation's end.
        start = "" if i == 0 and before == START else _TAIL
        shown = ("\n" if merged else start + empty + _HEAD.format(NAMES[role])) + row[4]
        if end:
            shown += _TAIL + "".join(_HEAD.format(NAMES[r]) + _TAIL for r in at_end)
        action = "+".join(x for x, is_so in (("relabel", role != was), ("merge", merged)) if is_so) or "keep"
        yield row[0], row[2], action, len(inserted) + len(at_end), NAMES[role], shown


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """conv, turn, role, action, inserted, rendered; one row per different row of turns.

    role is the repaired one; action is keep, relabel or merge (into the turn before),
    or both; inserted is how many empty turns stand before the turn, and after the last
    one; rendered is the turn's share of the formatted text: all shares of a
    conversation in order of turn, role, text make its whole text. A null or unknown
    role may become any at a relabel's cost; null text is empty; rows with a null
    conversation are one conversation; null turns come first. Repeated rows count once.
    Very long texts are carried whole, long conversations in pieces; of repairs of equal cost
    the first in the automaton's order counts. An empty table gives no rows; other columns,
    and their names, have no effect.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("piece", F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(1 << 40))))
    sides = ["conv", "piece"]
    order = ["conv", "piece", "turn", "role", "text"]
    dealt = rows.repartition(*sides).sortWithinPartitions(*order)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64()))])
        yield from _batches(((*g[0][:2], sum(costs([role_number(r[2]) for r in g]), [])) for g in _groups(batches, 2)), schema)

    pieces = dealt.select("conv", "piece", "role").mapInArrow(measure, "conv long, piece long, costs array<long>")
    listed = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "costs"))).alias("parts"))

    @F.pandas_udf("array<struct<piece:long,before:int,after:int,last:boolean>>")
    def path(parts: pd.Series) -> pd.Series:
        out = []
        for p in parts:
            states = ends([[list(x["costs"])[4 * s : 4 * s + 4] for s in range(4)] for x in p])
            out.append([{"piece": x["piece"], "before": a, "after": b, "last": i + 1 == len(p)} for i, (x, (a, b)) in enumerate(zip(p, states, strict=True))])
        return pd.Series(out)

    states = listed.select("conv", F.explode(path("parts")).alias("s")).select(F.col("conv").alias("c"), "s.*").withColumnRenamed("piece", "p")
    joined = rows.join(states, rows["conv"].eqNullSafe(states["c"]) & (rows["piece"] == states["p"])).drop("c", "p")

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("action", text), ("inserted", pa.int32()), ("repaired", text), ("rendered", text)])
        yield from _batches((r for g in _groups(batches, 2) for r in _rendered(g)), schema)

    columns = [*order, "before", "after", "last"]
    out = joined.select(*columns).repartition(*sides).sortWithinPartitions(*order).mapInArrow(render, "conv long, turn long, action string, inserted int, repaired string, rendered string")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("repaired").alias("role"), "action", "inserted", "rendered")
