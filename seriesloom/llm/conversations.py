"""Repair of conversation structure at least cost, by the auction algorithm for shortest paths.

The lattice has a node for every number of rows read and every state of the role pattern `(s?(ua)+)?`; its arcs are the edits with
whole costs. The auction keeps a price for each node, at most the cost of any arc plus the price behind it, and a path along arcs where
this holds with equality. The path's last node either extends over such an arc, or raises its price and gives way to the node
before it. When the path arrives, prices differ along every cheapest path by exactly the costs, so the tight arcs hold all
cheapest repairs, and the least one in letter order is traced through those that reach the end.

Rows are dealt out by ranges of (conversation, turn), so that a long conversation is spread over many tasks. Those cut by a range
boundary, at most one for each boundary, are solved in pieces: each piece gives the costs between its four entry and exit states, the
pieces' tables are chained, and each piece is traced between the states that the chain has found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: States of the pattern: nothing read, after the system turn, after a user turn, after an assistant turn.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a new or renamed turn gets in each state, and the state it leads to.
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: Rows that one auction runs over; longer pieces are chained inside the task.
BLOCK = 256

Row = tuple[str, bool, bool]  # role initial, must go, is cut off


def arcs(rows: list[Row], after: list[int]) -> list[list[tuple[int, int, str]]]:
    """For every node (row number * STATES + state) its arcs (cost, node, letter) towards the sink, which is the last node."""
    sink = (len(rows) + 1) * STATES
    out: list[list[tuple[int, int, str]]] = []
    for i in range(len(rows) + 1):
        for q in range(STATES):
            ways = [(INSERT, i * STATES + GIVEN[q][1], "I")]
            if i == len(rows):
                if after[q] < NEVER:
                    ways.append((after[q], sink, ""))
            else:
                initial, must_go, cut_off = rows[i]
                below, extra = (i + 1) * STATES, CUT_OFF if cut_off else 0
                ways.append((DELETE, below + q, "D"))
                if not must_go:
                    ways.append((REROLE + extra, below + GIVEN[q][1], "R"))
                    if (q, initial) in NEXT:
                        ways.append((KEEP + extra, below + NEXT[q, initial], "K"))
            out.append(ways)
    out.append([])
    live = reaching(out)
    return [[x for x in ways if x[1] in live] for ways in out]


def reaching(ways: list[list[tuple[int, int, str]]]) -> set[int]:
    """The nodes from which the last node can be reached."""
    before: list[list[int]] = [[] for _ in ways]
    for at, found in enumerate(ways):
        for _, node, _ in found:
            before[node].append(at)
    sink = len(ways) - 1
    live, todo = {sink}, [sink]
    while todo:
        for at in before[todo.pop()]:
            if at not in live:
                live.add(at)
                todo.append(at)
    return live


def first_prices(rows: list[Row], after: list[int]) -> list[int]:
    """Prices to start from: what the rows that are left cost at least, wherever they lead."""
    least = [min(after)]
    for _, must_go, cut_off in reversed(rows):
        least.append(least[-1] + (DELETE if must_go or cut_off else KEEP))
    return [p for p in reversed(least) for _ in range(STATES)] + [0]


def auction(ways: list[list[tuple[int, int, str]]], price: list[int], origin: int) -> None:
    """Raise the prices until a path from the origin to the last node is tight; an origin without any way there gets NEVER."""
    path, sink = [origin], len(ways) - 1
    if not ways[origin]:
        price[origin] = NEVER
        return
    while path[-1] != sink:
        at = path[-1]
        best, to = min((cost + price[node], node) for cost, node, _ in ways[at])
        if price[at] < best:
            price[at] = best  # contract
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)  # extend


def least_path(ways: list[list[tuple[int, int, str]]], price: list[int], origin: int) -> tuple[str, int]:
    """The letters of the least cheapest path in letter order, and the state that it leaves the rows in."""
    tight = [[x for x in found if price[at] == x[0] + price[x[1]]] for at, found in enumerate(ways)]
    live, sink = reaching(tight), len(ways) - 1
    letters, at, last = [], origin, origin
    while at != sink:
        letter, at = min((letter, node) for _, node, letter in tight[at] if node in live)
        letters.append(letter)
        last = last if at == sink else at
    return "".join(letters), last % STATES


def solve(rows: list[Row], entry: int, after: list[int]) -> tuple[int, str, int]:
    """(cost, letters, exit state) of the best edits of some rows from a state, `after` being the cost from each exit state on."""
    ways, price = arcs(rows, after), first_prices(rows, after)
    auction(ways, price, entry)
    if price[entry] == NEVER:
        return NEVER, "", entry
    return price[entry], *least_path(ways, price, entry)


def blocks(rows: list[Row]) -> list[list[Row]]:
    return [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]


def costs_before(rows: list[Row], after: list[int]) -> list[int]:
    """Cost from each entry state on."""
    ways, price = arcs(rows, after), first_prices(rows, after)
    for q in range(STATES):
        auction(ways, price, q)
    return price[:STATES]


def table(rows: list[Row]) -> list[int]:
    """Costs from each entry state (slowest) to each exit state."""
    columns = []
    for q in range(STATES):
        after = [0 if x == q else NEVER for x in range(STATES)]
        for part in reversed(blocks(rows)):
            after = costs_before(part, after)
        columns.append(after)
    return [columns[x][q] for q in range(STATES) for x in range(STATES)]


def repair(rows: list[Row], entry: int, after: list[int]) -> tuple[int, str, int]:
    """As `solve`, for any number of rows: prices are carried back over the blocks, then each block is traced in order."""
    parts = blocks(rows)
    behind = [after]
    for part in reversed(parts[1:]):
        behind.append(costs_before(part, behind[-1]))
    if not parts:
        return solve([], entry, after)
    total, letters, state = None, [], entry
    for part, then in zip(parts, reversed(behind), strict=True):
        cost, found, state = solve(part, state, then)
        total = cost if total is None else total
        letters.append(found)
    return total, "".join(letters), state


TERMINAL = [0 if q in ENDS else NEVER for q in range(STATES)]


def apply(letters: str, entry: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that the edits leave."""
    out, state, at = [], entry, 0
    for letter in letters:
        role, to = GIVEN[state]
        if letter == "I":
            out.append(f"{role}:")
            state = to
            continue
        if letter == "R":
            out.append(f"{role}:{texts[at]}")
            state = to
        elif letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = NEXT[state, roles[at][:1]]
        at += 1
    return out


# ---- damage and faults ----

NOT_BLANK = r"[^\x20\x09-\x0D]"
PAIRS = ("su", "ua", "au")


def damaged(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) after the damage that a checksum of conversation and turn decides."""
    conv, turn = talks["conv_id"].cast("long"), talks["turn"].cast("long")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = talks.select(conv.alias("conv_id"), turn.alias("turn"), blank(talks["role"]).alias("role"), blank(talks["text"]).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    # equal rows are counted and dealt out again, each as a copy with a number of its own
    times = F.count(F.lit(1)) * F.when(F.col("kind") == 3, 2).otherwise(1)
    counted = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind").groupBy("conv_id", "turn", "role", "text", "kind").agg(times.cast("int").alias("times"))
    return counted.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))


def row_order() -> list[Column]:
    """Order inside a conversation: turn, nulls first; equal turns by role, text and copy."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]


def with_faults(rows: DataFrame) -> DataFrame:
    """Add `fault` (blank, duplicate, truncated or null): a row's first one."""
    said = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("said", said)
    here = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "copy")
    first = rows.groupBy("conv_id", "said").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    marked = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["said"] == first["_said"]), "left")
    blank = ~F.col("text").rlike(NOT_BLANK)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(blank, "blank").when(F.col("first").isNotNull() & (here != F.col("first")), "duplicate").when(~last.rlike("^[.!?]$"), "truncated")
    return marked.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


def lattice_rows(found: pd.DataFrame) -> list[Row]:
    return [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, fault in zip(found["role"], found["fault"], strict=True)]


def illegal_pairs(initials: Iterable[str]) -> int:
    joined = list(initials)
    return sum(a + b not in PAIRS for a, b in zip(joined, joined[1:]))


def in_turn(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(["turn", "role", "text", "copy"], na_position="first", kind="stable")


_COLUMNS = ["conv_id", "turn", "role", "text", "copy", "fault"]


def whole_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired) of conversations that lie in one range."""

    def one(found: pd.DataFrame) -> pd.DataFrame:
        found = in_turn(found)
        cost, letters, _ = repair(lattice_rows(found), 0, TERMINAL)
        lines = apply(letters, 0, found["role"].tolist(), found["text"].tolist())
        return pd.DataFrame({"conv_id": found["conv_id"].iloc[:1], "illegal": illegal_pairs(r[:1] for r in found["role"]), "cost": cost, "audit": letters, "repaired": "\n".join(lines)})

    return rows.groupBy("conv_id").applyInPandas(one, "conv_id long, illegal long, cost long, audit string, repaired string")


def piece_repairs(rows: DataFrame) -> DataFrame:
    """As `whole_repairs`, of conversations cut into pieces by the ranges: tables, a chain over them, traces."""
    keys = ["conv_id", "piece"]

    def tabled(found: pd.DataFrame) -> pd.DataFrame:
        found = in_turn(found)
        initials = [r[:1] for r in found["role"]]
        return pd.DataFrame({**{k: found[k].iloc[:1] for k in keys}, "costs": [table(lattice_rows(found))], "inner": illegal_pairs(initials), "first": initials[0], "last": initials[-1]})

    def chained(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("piece")
        after, out = TERMINAL, []
        for costs in reversed(found["costs"].tolist()):
            out.append(after)
            square = np.array(costs).reshape(STATES, STATES) + np.array(after)
            after = np.minimum(square.min(1), NEVER).tolist()
        edges = [a + b not in PAIRS for a, b in zip(found["last"][:-1], found["first"][1:], strict=True)]
        return pd.DataFrame({"conv_id": found["conv_id"], "piece": found["piece"], "after": out[::-1], "illegal": found["inner"] + np.array([0, *edges])})

    def traced(found: pd.DataFrame) -> pd.DataFrame:
        """For each entry state the exit state: what the trace of the pieces before a piece may end in."""
        found = in_turn(found)
        after = found["after"].iloc[0].tolist()
        exits = [repair(lattice_rows(found), q, after)[2] for q in range(STATES)]
        return pd.DataFrame({**{k: found[k].iloc[:1] for k in keys}, "exits": [exits]})

    def entered(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("piece")
        state, out = 0, []
        for exits in found["exits"]:
            out.append(state)
            state = int(exits[state])
        return pd.DataFrame({"conv_id": found["conv_id"], "piece": found["piece"], "entry": out})

    def repaired(found: pd.DataFrame) -> pd.DataFrame:
        found = in_turn(found)
        entry, after = int(found["entry"].iloc[0]), found["after"].iloc[0].tolist()
        cost, letters, _ = repair(lattice_rows(found), entry, after)
        lines = apply(letters, entry, found["role"].tolist(), found["text"].tolist())
        return pd.DataFrame({**{k: found[k].iloc[:1] for k in keys}, "cost": cost, "audit": letters, "lines": [lines]})

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = left["conv_id"].eqNullSafe(named["_conv_id"]) & (left["piece"] == named["_piece"])
        return left.join(named, same).drop("_conv_id", "_piece")

    tables = rows.groupBy(*keys).applyInPandas(tabled, "conv_id long, piece int, costs array<long>, inner long, first string, last string")
    # a row for each range that holds rows of the conversation
    chain = stored(tables.groupBy("conv_id").applyInPandas(chained, "conv_id long, piece int, after array<long>, illegal long"), "chain")
    priced = stored(beside(rows, chain.drop("illegal")), "priced")
    exits = priced.groupBy(*keys).applyInPandas(traced, "conv_id long, piece int, exits array<int>")
    entries = exits.groupBy("conv_id").applyInPandas(entered, "conv_id long, piece int, entry int")
    parts = beside(priced, entries).groupBy(*keys).applyInPandas(repaired, "conv_id long, piece int, cost long, audit string, lines array<string>")
    joined = beside(parts, chain.select("conv_id", "piece", "illegal")).groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.min_by("cost", "piece").alias("cost"), F.sort_array(F.collect_list(F.struct("piece", "audit", "lines"))).alias("parts")
    )
    lines = F.flatten(F.transform("parts", lambda p: p["lines"]))
    return joined.select("conv_id", "illegal", "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"), F.array_join(lines, "\n").alias("repaired"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired) of every conversation of `rows` (conv_id, turn, role, text, copy, fault)."""
    tasks = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(tasks, F.col("conv_id"), *row_order()).withColumn("piece", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    places = ranged.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high")
    cut = [r["conv_id"] for r in places.select("conv_id").collect()]  # at most one for each boundary between ranges
    known = [c for c in cut if c is not None]
    in_pieces = F.coalesce(F.col("conv_id").isin(known), F.lit(None in cut)) if known else F.col("conv_id").isNull() & F.lit(None in cut)
    whole = whole_repairs(ranged.where(~in_pieces).drop("piece"))
    return whole.unionByName(piece_repairs(ranged.where(in_pieces))) if cut else whole


def repair_damage(talks: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation of `talks` (conv_id, turn, role, text) after damage by checksum.

    Columns: gaps (turn numbers missing between the first and the last), blank, duplicate, truncated (rows by their first fault),
    illegal (neighbours that may not follow each other), cost, audit (letters of the edits: Keep, Rerole, Delete, Insert) and the
    repaired text and its checksum. Nulls in role and text count as one space; null conversation ids are one conversation; null
    turns come first. Equal turns are ordered by role and text. A role that starts with none of s, u, a can't be kept. A conversation
    without rows after damage has zeros and an empty audit. Texts of any length are carried whole. An empty table gives no rows; other columns are not read.
    """
    rows = stored(with_faults(damaged(talks)), "damaged")
    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")])
    facts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")]
    )
    fixed = repaired_conversations(rows)
    every = talks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    named = [df.withColumnRenamed("conv_id", n) for df, n in ((facts, "_facts"), (fixed, "_fixed"))]
    joined = every.join(named[0], every["conv_id"].eqNullSafe(F.col("_facts")), "left").join(named[1], every["conv_id"].eqNullSafe(F.col("_fixed")), "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    repaired = F.coalesce("repaired", F.lit(""))
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), repaired.alias("repaired"), F.sha2(repaired.cast("binary"), 256).alias("repaired_sha256"))
