"""Chat formatting: least-cost role repair by dynamic programming over an automaton of legal turns, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one an
assistant's. A turn can be placed under its own role, relabelled, or merged into the turn before it; empty turns can be
inserted. The costs of a block of turns form a matrix over the automaton's states, and blocks are composed in the
(min, +) algebra: so a conversation of any length is repaired block by block, and no task needs all of its turns.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.storage import stored

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
#: From each state, the roles that may follow and the states they lead to.
LEGAL = {START: {"system": SYSTEM, "user": USER}, SYSTEM: {"user": USER}, USER: {"assistant": ASSISTANT}, ASSISTANT: {"user": USER}}
HELD = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
MERGE, RELABEL, INSERT = 1, 2, 4
#: Values of turn in one block.
BLOCK = 1024


def _options(state: int, role: str | None):
    """(cost, next state, roles inserted before, action, role given) of the ways to place a turn, in order of preference among equals."""
    for before, at in [((), state), *((((r,)), s) for r, s in LEGAL[state].items())]:
        for given, to in LEGAL[at].items():
            yield INSERT * len(before) + (0 if given == role else RELABEL), to, before, "keep" if given == role else "relabel", given
    if state in HELD:
        given = HELD[state]
        yield MERGE + (0 if given == role else RELABEL), state, (), "merge", given


OPTIONS = {(s, r): sorted(_options(s, r), key=lambda o: o[0]) for s in range(4) for r in (*ROLES, None)}
#: What closes a conversation in each state: (cost, roles inserted at the end).
CLOSING = {START: (2 * INSERT, ("user", "assistant")), SYSTEM: (2 * INSERT, ("user", "assistant")), USER: (INSERT, ("assistant",)), ASSISTANT: (0, ())}


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def block_costs(roles: list[str | None]) -> list[list[float]]:
    """The least cost of each (state before, state after) for a run of turns."""
    out = []
    for first in range(4):
        best = [0 if s == first else math.inf for s in range(4)]
        for role in roles:
            new = [math.inf] * 4
            for s in range(4):
                if best[s] < math.inf:
                    for cost, to, *_ in OPTIONS[s, known(role)]:
                        new[to] = min(new[to], best[s] + cost)
            best = new
        out.append(best)
    return out


def boundary_states(costs: list[list[list[float]]]) -> tuple[list[int], float]:
    """The state before each block and after the last on a path of least cost, and that cost with the closing."""
    best, back = [0, math.inf, math.inf, math.inf], []
    for matrix in costs:
        ways = [[best[s] + matrix[s][t] for s in range(4)] for t in range(4)]
        back.append([min(range(4), key=lambda s, w=w: (w[s], s)) for w in ways])
        best = [min(w) for w in ways]
    total = [best[t] + CLOSING[t][0] for t in range(4)]
    state = min(range(4), key=lambda t: (total[t], -t))
    states = [state]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1], total[state]


def repair_block(roles: list[str | None], first: int, last: int) -> list[tuple]:
    """For each turn (roles inserted before, action, role given), on a path of least cost from state first to state last."""
    best, back = [0 if s == first else math.inf for s in range(4)], []
    for role in roles:
        new, came = [math.inf] * 4, [None] * 4
        for s in range(4):
            if best[s] < math.inf:
                for option in OPTIONS[s, known(role)]:
                    if best[s] + option[0] < new[option[1]]:
                        new[option[1]], came[option[1]] = best[s] + option[0], (s, option)
        best = new
        back.append(came)
    out, state = [], last
    for came in reversed(back):
        s, (_, _, before, action, given) = came[state]
        out.append((before, action, given))
        state = s
    return out[::-1]


def escaped(text: str | None) -> str:
    """text in which no mark can be read: a backslash more stands in each `<|`, so that unescaped() has one to take away."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text or "")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def rendered(before: tuple, action: str, given: str, text: str | None, closing: tuple = (), opens: bool = True, ends: bool = True) -> str:
    """The part of the rendered conversation that a turn adds; parts in order, joined, are the conversation.

    A turn is closed by what comes after it, so that merged turns are one: opens tells the conversation's first turn,
    which has none to close, and ends the last one, which nothing else closes.
    """
    empty = lambda roles: "".join(f"<|{r}|>\n<|end|>\n" for r in roles)
    if action == "merge":
        part = f"\n{escaped(text)}"
    else:
        part = ("" if opens else "<|end|>\n") + empty(before) + f"<|{given}|>\n{escaped(text)}"
    return part + ("<|end|>\n" + empty(closing) if ends else "")


def repair_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: (conv, turn, role, new_role, action, inserted, closing, cost, rendered).

    action: keep, relabel or merge (into the turn before, whose role it takes). inserted: the roles of empty turns put
    before it; closing: of those put after the last turn. cost: of the whole conversation, on each of its rows.
    Turns are taken in the order of turn (null first), then role and text, so ties and repeated rows have one defined
    order. rendered: the part of the conversation that the turn adds, its marks escaped (see rendered()); a merged turn
    goes on in the one before. Null and unknown roles are relabelled or merged, null texts are empty. Rows with a null conversation form one.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    kind, turn_kind = dict(df.dtypes)[conv_col], dict(df.dtypes)[turn_col]
    turns = df.select(F.col(conv_col).alias("conv"), F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(-(2**62))).alias("block"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    blocks = turns.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def cost_rows(parts):
        for batch in parts:
            found = [block_costs(roles) for roles in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[c for row in m for c in row] for m in found], pa.list_(pa.float64()))], ["conv", "block", "costs"])

    costs = blocks.select("conv", "block", F.transform("turns", lambda t: t["role"]).alias("roles")).mapInArrow(cost_rows, f"conv {kind}, block long, costs array<double>")

    def state_rows(parts):
        for batch in parts:
            conv, block, first, last, closes, cost = [], [], [], [], [], []
            for c, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states, total = boundary_states([[x["costs"][4 * s : 4 * s + 4] for s in range(4)] for x in chain])
                for k, x in enumerate(chain):
                    conv.append(c)
                    block.append(x["block"])
                    first.append(states[k])
                    last.append(states[k + 1])
                    closes.append(k == len(chain) - 1)
                    cost.append(int(total))
            yield pa.RecordBatch.from_arrays([pa.array(conv, batch.schema.field(0).type), pa.array(block, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(closes, pa.bool_()), pa.array(cost, pa.int64())], ["conv", "block", "first", "last", "closes", "cost"])

    # a row of 16 numbers for each 1,024 turns of a conversation
    chains = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("chain"))
    states = stored(chains.mapInArrow(state_rows, f"conv {kind}, block long, first int, last int, closes boolean, cost long"), "states")

    def turn_rows(parts):
        for batch in parts:
            out: list[list] = [[] for _ in range(9)]
            for conv, turns_, first, last, closes, cost in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                placed = repair_block([t["role"] for t in turns_], first, last)
                for k, (t, (before, action, given)) in enumerate(zip(turns_, placed, strict=True)):
                    ends = closes and k == len(turns_) - 1
                    closing = CLOSING[last][1] if ends else ()
                    part = rendered(before, action, given, t["text"], closing, opens=k == 0 and first == START, ends=ends)
                    row = (conv, t["turn"], t["role"], given, action, ",".join(before), ",".join(closing), cost, part)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            turn_type = batch.schema.field(1).type.value_type.field(0).type
            types = [batch.schema.field(0).type, turn_type, *[pa.string()] * 5, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["conv", "turn", "role", "new_role", "action", "inserted", "closing", "cost", "rendered"])

    s = states.withColumnsRenamed({"conv": "s_conv", "block": "s_block"})
    joined = blocks.join(s, blocks["conv"].eqNullSafe(s["s_conv"]) & (blocks["block"] == s["s_block"])).select("conv", "turns", "first", "last", "closes", "cost")
    out = joined.mapInArrow(turn_rows, f"conv {kind}, turn {turn_kind}, role string, new_role string, action string, inserted string, closing string, cost long, rendered string")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))
