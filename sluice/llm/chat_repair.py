"""Chat formatting: minimum-cost role repair.

A legal conversation is what the turn automaton accepts: optionally a system
turn, then user and assistant turns in alternation, the last of them by the
assistant.  Dynamic programming over the automaton chooses, for the sequence
of roles as it stands, the cheapest set of

* relabels  (a turn takes another role),
* merges    (a turn joins the one before it, of the same role),
* empty insertions (a turn without text that was missing),

and the repaired sequence is rendered turn by turn, so that the rows of a
conversation, joined in order, are its text.

The step of one turn is a small matrix of costs between states, and steps
compose by the min-plus product.  Rows are range-partitioned by conversation and
turn and cut into chunks of bounded size.  A conversation that lies in one chunk
(nearly all do) is repaired where it is.  Of a longer one every chunk is summed
up by its matrix; chaining these gives each chunk the cost of every state before
it.  With these costs a chunk traces its cheapest paths back from each state it
may end in, which says in what state it begins for each; chaining these maps from
the end gives each chunk its last state.  Costs and ties are thereby decided as
in one pass over the conversation, whatever the size of chunks and partitions.

Ties go to the earlier operation in the order keep, merge, insert, relabel,
and, from the last turn back, to the earlier state.  Null or unknown roles may take any role at the cost
of a relabel.  Null text renders as empty.  Turns with equal numbers are
ordered by text, role and place; null conversation ids form one conversation,
null turns come first.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Turns and characters after which a chunk is closed.
CHUNK_TURNS, CHUNK_CHARS = 512, 1 << 21


class Costs(NamedTuple):
    merge: int = 2
    insert: int = 3
    #: from a role to another; what is not named cannot be had
    relabel: tuple[tuple[str, str, int], ...] = (
        ("user", "assistant", 5), ("assistant", "user", 5), ("system", "user", 4), ("system", "assistant", 8), ("user", "system", 9), ("assistant", "system", 12))
    unknown: int = 1


class Template(NamedTuple):
    """How a turn is rendered: what stands before and after its text, and between merged texts."""
    opening: str = "<|{role}|>\n"
    closing: str = "\n<|end|>\n"
    joint: str = "\n\n"


#: Legal next turns by state; START is a conversation without turns yet.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


class Step(NamedTuple):
    cost: int
    action: str
    inserted: tuple[int, ...]


def fill(state: int, role: int) -> tuple[int, ...] | None:
    """Empty turns to put between a state and a role: none, one or two; None where no filling is legal."""
    if role in LEGAL[state]:
        return ()
    for a in LEGAL[state]:
        if role in LEGAL[a]:
            return (a,)
    for a in LEGAL[state]:
        for b in LEGAL[a]:
            if role in LEGAL[b]:
                return (a, b)
    return None


def steps(role: int | None, costs: Costs) -> list[list[Step | None]]:
    """``[before][after]``: the cheapest way to read one turn; a state is the role of the turn read last."""
    relabel = {(ROLES.index(a) + 1, ROLES.index(b) + 1): c for a, b, c in costs.relabel}
    table: list[list[Step | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            change = costs.unknown if role is None else 0 if role == after else relabel.get((role, after))
            if change is None:
                continue
            ways = []
            empties = fill(before, after)
            if before == after:
                ways.append(Step(change + costs.merge, "merge", ()))
            if empties is not None:
                ways.append(Step(change + costs.insert * len(empties), "insert" if empties else "keep", empties))
            if ways:
                table[before][after] = min(ways, key=lambda w: w.cost)
    return table


def ending(costs: Costs) -> list[int]:
    """What it costs to end in each state: the empty turns that make the last one the assistant's."""
    return [0, 2 * costs.insert, costs.insert, 0]


def end_turns(state: int) -> tuple[int, ...]:
    return {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ())


class Automaton:
    def __init__(self, costs: Costs):
        self.table = {r: steps(r, costs) for r in (None, SYSTEM, USER, ASSISTANT)}
        self.ending = np.array(ending(costs), np.int64)
        self.cost = {r: np.array([[NEVER if s is None else s.cost for s in row] for row in t], np.int64) for r, t in self.table.items()}

    def matrix(self, roles: list[int | None]) -> np.ndarray:
        """Cheapest cost between any two states over a run of turns."""
        total = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
        for r in roles:
            total = product(total, self.cost[r])
        return total

    def trace(self, roles: list[int | None], reach: np.ndarray, last: int) -> list[int]:
        """States before the first and after each turn on the cheapest path to ``last``, ``reach`` being the costs of
        all states before the first turn."""
        reaches = [reach]
        for r in roles[:-1]:
            reaches.append(np.minimum((reaches[-1][:, None] + self.cost[r]).min(0), NEVER))
        states = [last]
        for before, r in zip(reversed(reaches), reversed(roles)):
            states.append(int(np.argmin(before + self.cost[r][:, states[-1]])))
        return states[::-1]

    def after(self, roles: list[int | None], reach: np.ndarray) -> np.ndarray:
        """Costs of all states after a run of turns."""
        for r in roles:
            reach = np.minimum((reach[:, None] + self.cost[r]).min(0), NEVER)
        return reach


def begun() -> np.ndarray:
    """Costs of the states of a conversation without turns yet."""
    return np.where(np.arange(4) == START, 0, NEVER).astype(np.int64)


def known_roles(roles: list[str | None]) -> list[int | None]:
    return [ROLES.index(r) + 1 if r in ROLES else None for r in roles]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), NEVER)


_CHUNK = "conv_id {kind}, part int, chunk int, turns array<long>, roles array<string>, texts array<string>, alone boolean, matrix array<long>"


def chunks(turns: DataFrame, costs: Costs, kind: str, most: int) -> DataFrame:
    """Conversations in order, as runs of bounded size.  ``alone``: the run is a whole conversation; others have their matrix."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "key", "role", "pos")]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, chars, chunk, schema = Automaton(costs), [], 0, 0, None
        whole = False  # the conversation began in this partition (the first one may have begun before it) and was not cut

        def close(alone: bool) -> dict:
            roles = [h[2] for h in held]
            return {"conv_id": held[0][0], "part": held[0][4], "chunk": chunk, "turns": [h[1] for h in held], "roles": roles, "texts": [h[3] for h in held],
                    "alone": alone, "matrix": None if alone else automaton.matrix(known_roles(roles)).ravel().tolist()}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("chunk", pa.int32()), ("turns", pa.list_(pa.int64())),
                                ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("alone", pa.bool_()), ("matrix", pa.list_(pa.int64()))])
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out.append(close(whole))
                    held, chars, chunk, whole = [], 0, chunk + 1, True
                elif held and (len(held) >= most or chars >= CHUNK_CHARS):
                    out.append(close(False))
                    held, chars, chunk, whole = [], 0, chunk + 1, False
                held.append(row)
                chars += len(row[3] or "")
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:  # the last one may go on in the next partition
            yield pa.RecordBatch.from_pylist([close(False)], schema)

    return rows.mapInArrow(run, _CHUNK.format(kind=kind))


def chain(costs: Costs):
    """For the chunks of one conversation: the costs of all states before each, the state the conversation ends in, and its cost."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "chunk"])
        reach = [begun()]
        for m in group["matrix"]:
            reach.append(np.minimum((reach[-1][:, None] + np.array(m, np.int64).reshape(4, 4)).min(0), NEVER))
        final = reach[-1] + np.array(ending(costs))
        sizes = group["size"].to_numpy(np.int64)
        return pd.DataFrame({
            "part": group["part"].to_numpy(), "chunk": group["chunk"].to_numpy(), "reach": [r.tolist() for r in reach[:-1]], "rows_before": np.cumsum(sizes) - sizes,
            "final": int(np.argmin(final)), "cost": int(final.min()), "is_last": [False] * (len(group) - 1) + [True]})
    return run


def unchain(group: pd.DataFrame) -> pd.DataFrame:
    """For the chunks of one conversation: the state each one ends in, from the maps of last to first state."""
    group = group.sort_values(["part", "chunk"], ascending=False)
    state, lasts = int(group["final"].iloc[0]), []
    for back in group["back"]:
        lasts.append(state)
        state = int(back[state])
    return pd.DataFrame({"part": group["part"].to_numpy(), "chunk": group["chunk"].to_numpy(), "last_state": lasts})


def backs(rows: DataFrame, costs: Costs) -> DataFrame:
    """``conv, part, chunk, final, back``: the state each chunk begins in, for every state it may end in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(costs)
        for batch in batches:
            found = []
            for roles, reach in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                known, reach = known_roles(roles), np.array(reach, np.int64)
                found.append([automaton.trace(known, reach, last)[0] for last in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int32()))], ["conv", "part", "chunk", "final", "back"])

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.select("conv", "part", "chunk", "final", "roles", "reach").mapInArrow(run, f"conv {kind}, part int, chunk int, final int, back array<int>")


def repair(conversations: DataFrame, costs: Costs = Costs(), template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per turn of the repaired conversations, in pieces:

    ``conv_id, row`` (place of the source turn, from 0), ``slot`` (turns inserted before it from 0; 9 for the
    turn itself; from 10 what is added at the end), ``turn, role`` (repaired), ``source_role, action`` (keep,
    merge, relabel or insert), ``rendered, cost`` (of the whole conversation).  ``rendered`` in the order of row
    and slot is the text of the conversation."""
    kind = conversations.schema[conv].dataType.simpleString()
    turns = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("pos"))
    runs = cut(chunks(turns, costs, kind, chunk_turns), "chat-chunks")
    # the key is a struct, so that the null conversation is one too
    several = runs.filter(~F.col("alone")).withColumn("conv", F.struct("conv_id"))
    chained = several.select("conv", "part", "chunk", "matrix", F.size("turns").alias("size")).groupBy("conv").applyInPandas(
        chain(costs), "part int, chunk int, reach array<long>, rows_before long, final int, cost long, is_last boolean")
    met = cut(several.drop("alone", "matrix").join(chained, ["part", "chunk"]), "chat-chained")
    lasts = backs(met, costs).groupBy("conv").applyInPandas(unchain, "part int, chunk int, last_state int")
    columns = ["conv_id", "turns", "roles", "texts", "reach", "last_state", "rows_before", "cost", "is_last"]
    null = lambda t: F.lit(None).cast(t)
    whole = runs.filter("alone").select("conv_id", "turns", "roles", "texts", null("array<long>").alias("reach"), null("int").alias("last_state"),
                                        F.lit(0).cast("long").alias("rows_before"), null("long").alias("cost"), F.lit(True).alias("is_last"))
    ready = whole.union(met.join(lasts, ["part", "chunk"]).select(*columns))

    schema = f"conv_id {kind}, row long, slot int, turn long, role string, source_role string, action string, rendered string, cost long"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(costs)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(rendered(automaton, {n: batch.column(n)[i].as_py() for n in batch.schema.names}, template, batch.schema.field("conv_id").type),
                                                 ["conv_id", "row", "slot", "turn", "role", "source_role", "action", "rendered", "cost"])

    return ready.mapInArrow(render, schema)


def rendered(automaton: Automaton, run: dict, template: Template, kind: pa.DataType) -> list[pa.Array]:
    """Columns of the repaired turns of one chunk."""
    known, out = known_roles(run["roles"]), []
    if run["reach"] is None:  # a whole conversation
        final = automaton.after(known, begun()) + automaton.ending
        run |= {"reach": begun(), "last_state": int(np.argmin(final)), "cost": int(final.min())}
    states = automaton.trace(known, np.array(run["reach"], np.int64), run["last_state"])

    def name(s: int) -> str:
        return ROLES[s - 1]

    for i, (state, after, had) in enumerate(zip(states, states[1:], known)):
        step = automaton.table[had][state][after]
        opening = template.joint if step.action == "merge" else template.closing * (state != START)
        row = run["rows_before"] + i
        for k, empty in enumerate(step.inserted):
            out.append((row, k, run["turns"][i], name(empty), None, "insert", opening + template.opening.format(role=name(empty))))
            opening = template.closing
        head = "" if step.action == "merge" else template.opening.format(role=name(after))
        action = "merge" if step.action == "merge" else "keep" if had == after else "relabel"
        out.append((row, 9, run["turns"][i], name(after), run["roles"][i], action, opening + head + (run["texts"][i] or "")))
    if run["is_last"]:
        row, turn = run["rows_before"] + len(known) - 1, run["turns"][-1]
        for k, empty in enumerate(end_turns(states[-1])):
            out.append((row, 10 + k, turn, name(empty), None, "insert", template.closing + template.opening.format(role=name(empty))))
        out[-1] = (*out[-1][:6], out[-1][6] + template.closing)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
    return [pa.array([run["conv_id"]] * len(out), kind), *cols, pa.array([run["cost"]] * len(out), pa.int64())]
