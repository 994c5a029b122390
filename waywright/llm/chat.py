"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

Legal: at most one system turn, first, then user and assistant turns in alternation, the
last one the assistant's.  A message keeps its role, gets another (relabel), or joins the
turn before it (merge); empty turns may be inserted.  A message's choices depend on the
state before it, so a message is a small matrix of costs, and matrices multiply in the
min-plus sense: long conversations are cut into parts, whose matrices are multiplied up a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
COST = {MERGE: 1, RELABEL: 2, INSERT: 3}
FAR = 1 << 40
#: A part spans 2^TURN_BITS turns; beyond PART_ROWS rows it is cut further by a hash of its messages.
TURN_BITS, PART_ROWS = 8, 4_096

# Which turn may follow a state, and the empty turns that make another one legal there.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


@cache
def bridge(state: int, turn: int) -> tuple[int, ...] | None:
    """The shortest run of empty turns after which ``turn`` may follow; None if there is none."""
    paths = [((), state)]
    for _ in range(3):
        for path, at in paths:
            if turn in FOLLOWS[at]:
                return path
        paths = [((*path, t), t) for path, at in paths for t in FOLLOWS[at] if t != SYSTEM]
    return None


@cache
def choices(role: str) -> tuple[tuple[int, int, int, int, tuple[int, ...]], ...]:
    """(state, next state, cost, action code, inserted turns) of a message, cheapest first, ties by simpler actions."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for state in range(STATES):
        for turn in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if turn == own else COST[RELABEL]
            if turn == state:
                out.append((state, turn, relabel + COST[MERGE], MERGE + 4 * bool(relabel), ()))
            path = bridge(state, turn)
            if path is not None:
                out.append((state, turn, relabel + COST[INSERT] * len(path), (RELABEL if relabel else KEEP) + 8 * len(path), path))
    return tuple(sorted(out, key=lambda c: (c[2], c[3], c[1])))


@cache
def matrix(role: str) -> np.ndarray:
    m = np.full((STATES, STATES), FAR, np.int64)
    for state, to, cost, *_ in choices(role):
        m[state, to] = min(m[state, to], cost)
    return m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation legally."""
    return () if state in (START, ASSISTANT) else (*(bridge(state, ASSISTANT) or ()), ASSISTANT)


END = np.array([FAR if s == START else COST[INSERT] * len(ending(s)) for s in range(STATES)])


def best_path(roles: list[str], start: int, goal: np.ndarray) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """The cheapest choices of a run of messages from ``start``, where ending in a state costs ``goal``; ties by each message's order of choices."""
    after = [goal]
    for role in reversed(roles):
        after.append((matrix(role) + after[-1][None]).min(axis=1))
    after.reverse()
    out, state = [], start
    for i, role in enumerate(roles):
        best = min((c for c in choices(role) if c[0] == state), key=lambda c: (c[2] + after[i + 1][c[1]], c[3], c[1]))
        out.append(best)
        state = best[1]
    return out


def _tag(turn: int) -> str:
    return f"<|{ROLES[turn - 1]}|>\n"


CLOSE = "\n<|end|>\n"


def segments(roles: list[str], texts: list[str], start: int, goal: np.ndarray, last: bool) -> Iterable[tuple[str, str, int, int, str]]:
    """(label, action, inserted turns, cost, rendered piece) of each message; pieces in order make the rendered conversation."""
    path = best_path(roles, start, goal)
    for i, ((state, to, cost, code, inserted), text) in enumerate(zip(path, texts, strict=True)):
        if code & 3 == MERGE:
            piece = "\n\n" + text
        else:
            piece = (CLOSE if state != START else "") + "".join(_tag(t) + CLOSE for t in inserted) + _tag(to) + text
        action = ("merge" if code & 3 == MERGE else "") or ("relabel" if code & 3 == RELABEL else "keep")
        if code & 4:
            action = "relabel+merge"
        n = len(inserted)
        if last and i == len(path) - 1:
            tail = ending(to)
            piece += CLOSE + "".join(_tag(t) + CLOSE for t in tail)
            n, cost = n + len(tail), cost + COST[INSERT] * len(tail)
        yield ROLES[to - 1], action, n, cost, piece


#: Rows that a task works on at a time, and children of a node in the tree of parts.
SLICE, FAN_BITS = 4_096, 8
KEYS = ["conv", "span", "sub"]
NOBODY = -(2**63)


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Sorted batches as (key, its slices) in turn; the slices of a key are to be read before the next key."""
    slices = ((tuple(k), part) for b in batches for at in range(0, b.num_rows, SLICE) for k, part in _cut(b.slice(at, SLICE), n_keys))
    for key, own in groupby(slices, key=lambda x: x[0]):
        yield key, (part for _, part in own)


def _cut(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    ident = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
    cuts = [0, *(np.flatnonzero((ident[:, 1:] != ident[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield ident[:, a].tolist(), batch.slice(a, b - a)


def _known(role: str | None) -> str:
    name = (role or "").strip().lower()
    return name if name in ROLES else ""


def _multiplied(rows: DataFrame, n_keys: int) -> DataFrame:
    """(keys, n, costs): for each key the product of its matrices in order; rows are sorted by key and order, with n and costs, or a role."""
    names = rows.columns[:n_keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, parts in _runs(batches, n_keys):
            total, count = None, 0
            for part in parts:
                if "costs" in part.schema.names:
                    factors = np.array(part.column("costs").flatten()).reshape(-1, STATES, STATES)
                    count += int(np.sum(part.column("n").to_numpy()))
                else:
                    factors = [matrix(_known(r)) for r in part.column("role").to_pylist()]
                    count += part.num_rows
                for m in factors:
                    total = m if total is None else product(total, m)
            out.append((*key, count, total.ravel().tolist()))
            if len(out) >= SLICE:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.list_(pa.int64()))], names=[*names, "n", "costs"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]) + ", costs array<long>")


def _routed(children: DataFrame, parents: DataFrame, up: list[Column], names: list[str]) -> DataFrame:
    """(names, enter, leave, base, last) of each child, from those of its parent: where the best path through the parent enters and leaves it."""
    over = parents.select(*[F.col(c).alias(f"up_{c}") for c in names], "enter", "leave", "base", "last")
    rows = children.withColumns({f"up_{c}": u for c, u in zip(names, up, strict=True)}).join(over, [f"up_{c}" for c in names])
    own = [f"up_{c}" for c in names]
    rows = rows.select(*own, *names, "n", "costs", "enter", "leave", "base", "last").repartition(*own).sortWithinPartitions(*own, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in _runs(batches, len(names)):
            table = pa.Table.from_batches(list(slices))  # a node's children: 2^FAN_BITS at most
            parts = np.array(table["costs"].combine_chunks().flatten()).reshape(-1, STATES, STATES)
            goal = np.full(STATES, FAR, np.int64)
            leave_at, last = table["leave"][0].as_py(), table["last"][0].as_py()
            if leave_at < 0:
                goal = END
            else:
                goal[leave_at] = 0
            after = [goal]
            for m in parts[::-1]:
                after.append((m + after[-1][None]).min(axis=1))
            after.reverse()
            enter, leave, state = [], [], table["enter"][0].as_py()
            for i, m in enumerate(parts):
                enter.append(state)
                state = int(np.argmin(m[state] + after[i + 1]))
                leave.append(state)
            n = table["n"].to_numpy()
            base = table["base"][0].as_py() + np.cumsum(n) - n
            ends = [last and i == len(parts) - 1 for i in range(len(parts))]
            columns = [table[c].combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(enter, pa.int64()), pa.array(leave, pa.int64()), pa.array(base, pa.int64()), pa.array(ends)], names=[*names, "enter", "leave", "base", "last"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", enter long, leave long, base long, last boolean")


def repair_roles(messages: DataFrame) -> DataFrame:
    """Repair and render every conversation of (conv_id, turn, role, text).

    Returns one row a message: conv_id, place (from 0, in the order of turn, then a hash of
    role and text), turn, role, label (its role after repair), action (keep, merge, relabel,
    relabel+merge), inserted (empty turns put before it, or after the last one), cost and
    piece; a conversation's pieces, joined by place, are its rendering.  Total cost is least;
    ties prefer, from the first message on, keeping to merging to relabelling to inserting.

    Rows that repeat a message of the same conversation and turn count once; where the
    conversation or the turn is null they can't be told for repeats, and each is a message.
    A role is read without case and outer spaces; any other, or null, is unknown and must be
    relabelled.  A null text is empty, null turns come first, rows without a conv_id form a
    conversation of their own.  Other columns, whatever their names, are ignored; an empty
    table gives no rows.

    Conversations of one part, most of them, are repaired where their rows meet.  Longer ones
    are cut into parts; their matrices are multiplied up a tree and the best path is routed
    down again, so that no task holds more than a node's children.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    loose = (F.col("conv") == NOBODY) | F.col("turn").isNull()
    rows = rows.filter(~loose).distinct().withColumn("nth", F.lit(0).cast("long")).unionByName(rows.filter(loose).withColumn("nth", F.monotonically_increasing_id()))
    rows = rows.withColumn("mix", F.when(F.col("nth") == 0, F.xxhash64("role", "text")).otherwise(F.xxhash64("role", "text", "nth"))).withColumn("span", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(NOBODY)).cast("long"))
    rows = scratch.cut(rows, "rows")
    # A part is a span of turns; a crowded one is cut by turn and the first bits of the hash, which keeps the order.
    spans = scratch.cut(rows.groupBy("conv", "span").agg(F.count("*").alias("n")), "spans")
    crowded = spans.filter(F.col("n") > PART_ROWS).select("conv", "span", F.ceil(F.log2(F.col("n") / (PART_ROWS / 4))).cast("int").alias("bits"))
    within = F.coalesce(F.pmod("turn", F.lit(1 << TURN_BITS)), F.lit(0))
    first_bits = F.expr("shiftright(mix, 64 - bits) + shiftleft(1L, bits - 1)")
    long_ = spans.groupBy("conv").agg(F.count("*").alias("n_spans"), F.max("n").alias("most")).filter((F.col("n_spans") > 1) | (F.col("most") > PART_ROWS)).select("conv")
    long_ = scratch.cut(long_, "long")
    keyed = rows.withColumn("turn_key", F.coalesce("turn", F.lit(NOBODY)))
    order = ["turn_key", "mix", "role", "text"]
    of_long = keyed.join(long_, "conv", "left_semi").join(crowded, ["conv", "span"], "left")
    of_long = of_long.withColumn("sub", F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.expr("shiftleft(1L, bits)") * within + first_bits).cast("long")).drop("bits")
    of_long = scratch.cut(of_long.select(*KEYS, *order, "turn", "nth"), "parts")

    # Up the tree: parts by their place in a span, then spans, in runs of 2^FAN_BITS each time, until a conversation is one node.
    levels = [scratch.cut(_multiplied(of_long.select(*KEYS, *order).repartition(*KEYS).sortWithinPartitions(*KEYS, *order), 3), "factors-0")]
    ups: list[list[Column]] = []
    while levels[-1].groupBy("conv").count().filter("count > 1").limit(1).count():
        subs, spread = levels[-1].agg(F.max("sub"), F.max(F.greatest(F.col("span"), -(F.col("span") + 1)))).first()
        wider_span = F.shiftright("span", FAN_BITS) if spread else F.lit(0).cast("long")  # all are 0 or -1 in the end
        up = [F.col("conv"), F.col("span"), F.shiftright("sub", FAN_BITS)] if subs else [F.col("conv"), wider_span, F.col("sub")]
        wider = levels[-1].select(*[u.alias(f"up_{c}") for u, c in zip(up, KEYS, strict=True)], *KEYS, "n", "costs")
        own = [f"up_{c}" for c in KEYS]
        found = _multiplied(wider.repartition(*own).sortWithinPartitions(*own, *KEYS).select(*own, "n", "costs"), 3).withColumnsRenamed({f"up_{c}": c for c in KEYS})
        ups.append(up)
        levels.append(scratch.cut(found, f"factors-{len(levels)}"))
    # And down: a conversation starts with nothing and ends legally (leave -1).
    routed = levels[-1].select(*KEYS, F.lit(START).cast("long").alias("enter"), F.lit(-1).cast("long").alias("leave"), F.lit(0).cast("long").alias("base"), F.lit(True).alias("last"))
    for i in reversed(range(len(ups))):
        routed = scratch.cut(_routed(levels[i], routed, ups[i], KEYS), f"routed-{i}")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, *_), slices in _runs(batches, 3):
            table = pa.Table.from_batches(list(slices))  # a part
            enter, leave, base, last = (table[c][0].as_py() for c in ("enter", "leave", "base", "last"))
            goal = END if leave < 0 else np.where(np.arange(STATES) == leave, 0, FAR)
            out = list(zip(*segments([_known(r) for r in table["role"].to_pylist()], table["text"].to_pylist(), enter, goal, last), strict=True))
            rest = [pa.array([conv] * table.num_rows, pa.int64()), pa.array(base + np.arange(table.num_rows)), table["turn"].combine_chunks(), table["role"].combine_chunks()]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out[0]), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    schema = "conv long, place long, turn long, role string, label string, action string, inserted long, cost long, piece string"
    short = keyed.join(long_, "conv", "left_anti").select("conv", F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("sub"), *order, "turn", F.lit(START).cast("long").alias("enter"), F.lit(-1).cast("long").alias("leave"), F.lit(0).cast("long").alias("base"), F.lit(True).alias("last"))
    both = short.unionByName(of_long.drop("nth").join(routed, KEYS).select(short.columns))
    out = both.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInArrow(render, schema)
    return out.select(F.when(F.col("conv") != NOBODY, F.col("conv")).alias("conv_id"), *[c for c in out.columns if c != "conv"])
