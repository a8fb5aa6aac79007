"""Conversation structure repair by an auction for shortest paths.

A conversation's turns are crossed by edits; a node of the lattice is a turn and what has been said so far (nothing, a
system message, a user's turn, an assistant's). Every node has a price. A path grows from its origin along the arc with
the least cost plus price; where its last node's price is below that, the price rises to it and the path shrinks by a
node. No price ever exceeds the cost of its cheapest arc plus the price behind it, so that when the path arrives, the
prices are a dual solution, and all arcs of cheapest paths are tight. Of the tight arcs that lead to the end, the one
with the least letter is followed from node to node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, need, written

#: Turns of a lattice that is solved at once; its end takes the prices of the next one's start.
STRETCH = 64

#: Conversations with more turns or bytes of text are cut into chunks, so that none meets in one task or cell.
LONG_TURNS, LONG_BYTES = 1024, 1 << 25

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # what a rewritten or inserted turn must be
_KEEP = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_END = (0, math.inf, math.inf, 0)  # a conversation may end with nothing said or after an assistant


class Costs(NamedTuple):
    """What edits cost; a truncated turn that is not deleted adds ``truncated``. All are integers, inserts above 0."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Stretch:
    """The lattice of some turns: initials of roles, and faults (b, d: must go; t: truncated). Node 4 * turn + state."""

    def __init__(self, initials: list[str], faults: list[str], exits: tuple, last: bool, costs: Costs):
        n = len(initials)
        self.goal = 4 * n + 4
        arcs: list[list[tuple[str, int, int]]] = []
        for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            more = costs.truncated if fault == "t" else 0
            for s in range(4):
                out = [("D", costs.delete, 4 * i + 4 + s), ("I", costs.insert, 4 * i + _NEXT[s])]
                if fault not in ("b", "d"):
                    if (to := _KEEP.get((s, initial))) is not None:
                        out.append(("K", more, 4 * i + 4 + to))
                    out.append(("R", costs.rerole + more, 4 * i + 4 + _NEXT[s]))
                arcs.append(out)
        arcs += [[("", exits[s], self.goal), *([("I", costs.insert, 4 * n + _NEXT[s])] if last else [])] for s in range(4)]
        leads = self._back(arcs, lambda v, cost, to: cost < math.inf)  # noqa: ARG005
        self.arcs = [[a for a in out if leads[a[2]] and a[1] < math.inf] for out in arcs]
        self.price = [0] * (self.goal + 1)
        least = min(exits)
        for i in reversed(range(n + 1)):
            if i < n:
                fault = faults[i]
                least += costs.delete if fault in ("b", "d") else min(costs.delete, (costs.truncated if fault == "t" else 0) + (0 if initials[i] in ("s", "u", "a") else costs.rerole))
            for s in range(4):
                self.price[4 * i + s] = least if leads[4 * i + s] else math.inf

    def _back(self, arcs: list, fits) -> list[bool]:
        """Nodes from which the goal can be reached over arcs that fit."""
        leads = [False] * self.goal + [True]
        for first in range(self.goal - 4, -1, -4):
            for _ in range(3):  # inserts lead from state to state of one turn
                for v in range(first, first + 4):
                    leads[v] = leads[v] or any(leads[to] and fits(v, cost, to) for _, cost, to in arcs[v])
        return leads

    def auction(self, origin: int) -> float:
        """The cost of a cheapest path from ``origin``; prices become those of a dual solution for it."""
        price, arcs, goal, path = self.price, self.arcs, self.goal, [origin]
        if price[origin] == math.inf:
            return math.inf
        while (v := path[-1]) != goal:
            least, to = math.inf, v
            for _, cost, w in arcs[v]:
                if cost + price[w] < least:
                    least, to = cost + price[w], w
            if price[v] < least:
                price[v] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def settle(self) -> None:
        """Keeps the tight arcs that lead to the goal."""
        tight = [[a for a in out if a[1] + self.price[a[2]] == self.price[v]] for v, out in enumerate(self.arcs)]
        leads = self._back(tight, lambda v, cost, to: True)  # noqa: ARG005
        self.tight = [[a for a in out if leads[a[2]]] for out in tight]


def solve(initials: list[str], faults: list[str], exits: tuple, last: bool, costs: Costs, origins: tuple = (0, 1, 2, 3)) -> tuple[list[Stretch], tuple]:
    """Stretches in order, with their tight arcs, and the cheapest cost from each of ``origins`` to the end."""
    found: list[Stretch] = []
    for at in range((max(0, len(initials) - 1) // STRETCH) * STRETCH, -1, -STRETCH):
        one = Stretch(initials[at : at + STRETCH], faults[at : at + STRETCH], exits, last and not found, costs)
        exits = tuple(one.auction(s) if at or s in origins else math.inf for s in range(4))
        one.settle()
        found.append(one)
    return found[::-1], exits


def trace(stretches: list[Stretch], state: int) -> tuple[str, list[tuple[int, str | None]], int]:
    """The least letters of cheapest edits from ``state``, the turns that result (place or -1, new role) and the last state."""
    letters, turns, base = [], [], 0
    for one in stretches:
        v = state
        while True:
            letter, _, to = min(one.tight[v])
            if to == one.goal:
                break
            letters.append(letter)
            if letter == "K":
                turns.append((base + v // 4, None))
            elif letter != "D":
                turns.append((-1 if letter == "I" else base + v // 4, _ROLE[to % 4]))
            v = to
        state = v % 4
        base += one.goal // 4 - 1
    return "".join(letters), turns, state


_EDITS = "array<struct<place:int,role:string>>"
_SOLVED = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string())])))])


def _solver(costs: Costs):
    @F.arrow_udf(f"cost long, audit string, edits {_EDITS}")
    def solved(initials: pa.Array, faults: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(initials.to_pylist(), faults.to_pylist(), strict=True):
            stretches, cost = solve(a, b, _END, True, costs, (_NOTHING,))
            audit, turns, _ = trace(stretches, _NOTHING)
            out.append({"cost": cost[0], "audit": audit, "edits": [{"place": p, "role": r} for p, r in turns]})
        return pa.array(out, _SOLVED)

    return solved


def _fault(text: Column) -> Column:
    """b: no word; t: the last character of a word is no end of a sentence."""
    return F.when(~text.rlike(WORD), "b").when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "").otherwise("t")


def _illegal(initials: Column) -> Column:
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))), F.slice(initials, 2, F.greatest(F.size(initials) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _span(low: Column, high: Column, distinct: Column) -> Column:
    """Turns that are missing between the first and the last."""
    wide = high.cast("decimal(38,0)") - low.cast("decimal(38,0)") + 1 - distinct.cast("decimal(38,0)")
    return F.when(low.isNull(), 0).otherwise(F.least(wide, F.lit(Decimal(2**63 - 1))).cast("long")).cast("long")


def _count(faults: Column, kind: str) -> Column:
    return F.size(F.filter(faults, lambda f: f == kind)).cast("long")


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PIECE = ["conv_id", "piece", *TOTALS, "pieces", "audit", "repaired"]


def _short(rows: DataFrame, costs: Costs) -> DataFrame:
    """One piece for each conversation; all its turns meet in one cell."""
    turns = F.sort_array(F.collect_list(F.when(~F.col("dropped"), F.struct("turn", "role", "same", "text", "fault"))))
    each = rows.groupBy("conv_id").agg(turns.alias("turns"))
    each = each.withColumns({"same": F.col("turns.same"), "numbers": F.filter(F.col("turns.turn"), lambda t: t.isNotNull()), "initials": F.transform(F.col("turns.role"), lambda r: F.left(r, F.lit(1)))})
    each = each.withColumn("faults", F.transform(F.col("turns"), lambda t, i: F.when((t["fault"] != "b") & (F.array_position(F.col("same"), t["same"]) <= i), "d").otherwise(t["fault"])))
    each = each.withColumn("solved", _solver(costs)("initials", "faults"))
    repaired = F.transform("solved.edits", lambda e: F.when(e["place"] < 0, F.struct(e["role"].alias("role"), F.lit("").alias("text"))).otherwise(F.struct(F.coalesce(e["role"], F.get(F.col("turns.role"), e["place"])).alias("role"), F.coalesce(F.get(F.col("turns.text"), e["place"]), F.lit("")).alias("text"))))
    return each.select(
        "conv_id", F.lit(0).cast("long").alias("piece"), _span(F.array_min("numbers"), F.array_max("numbers"), F.size(F.array_distinct("numbers"))).alias("gaps"),
        _count(F.col("faults"), "b").alias("blank"), _count(F.col("faults"), "d").alias("duplicate"), _count(F.col("faults"), "t").alias("truncated"), _illegal(F.col("initials")).alias("illegal"),
        F.col("solved.cost").alias("cost"), F.lit(1).cast("long").alias("pieces"), F.col("solved.audit").alias("audit"), repaired.alias("repaired"),
    )


def _by_chunk(rows: DataFrame, work, ddl: str) -> DataFrame:
    return rows.groupBy("conv_id", "chunk").applyInArrow(work, ddl)


def _lists(table: pa.Table) -> tuple[list, list, list]:
    table = table.sort_by("pos")
    return table["pos"].to_pylist(), table["initial"].to_pylist(), table["fault"].to_pylist()


def _long(rows: DataFrame, costs: Costs, chunk: int) -> DataFrame:
    """Pieces of conversations that are too long for a cell.

    Turns are sorted over all tasks. A chunk's costs from each state to each other are found first; chained backwards, they give the
    prices at each chunk's end, with which the chunks are solved again. No task has more than a chunk's turns, or the 16 costs of
    each chunk of a conversation.
    """
    there = rows.filter(~F.col("dropped"))
    sort = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("same")]
    placed = there.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("pos", F.monotonically_increasing_id())
    placed = written(placed, "turns")  # places stay as they are
    firsts = placed.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    light = placed.select("conv_id", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").join(firsts, "pos", "left")
    light = light.withColumn("fault", F.when(F.col("first").isNull() & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))).drop("first")
    light = written(light.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")), "faults")

    def crossed(table: pa.Table) -> pa.Table:
        _, initials, faults = _lists(table)
        costs_ = [solve(initials, faults, tuple(0 if s == j else math.inf for s in range(4)), False, costs)[1] for j in range(4)]
        flat = [None if c == math.inf else c for i in range(4) for c in (costs_[j][i] for j in range(4))]
        pairs = zip(initials, initials[1:], strict=False)
        row = {"conv_id": table["conv_id"][0].as_py(), "chunk": table["chunk"][0].as_py(), "n": len(initials), "costs": flat, "head": initials[0], "tail": initials[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs)}
        return pa.Table.from_pylist([row], pa.schema([("conv_id", table.schema.field("conv_id").type), ("chunk", pa.int64()), ("n", pa.int64()), ("costs", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())]))

    kind = rows.schema["conv_id"].dataType.simpleString()
    matrices = _by_chunk(light, crossed, f"conv_id {kind}, chunk long, n long, costs array<long>, head string, tail string, illegal long")

    def chained(table: pa.Table) -> pa.Table:
        exits, out, after = solve([], [], _END, True, costs)[1], [], None
        for r in reversed(table.sort_by("chunk").to_pylist()):
            out.append({"conv_id": r["conv_id"], "chunk": r["chunk"], "last": after is None, "exits": [int(x) for x in exits], "illegal": r["illegal"] + (after is not None and r["tail"] + after not in ("su", "ua", "au"))})
            exits = tuple(min((c + e for c, e in zip(r["costs"][4 * i : 4 * i + 4], exits, strict=True) if c is not None), default=math.inf) for i in range(4))
            after = r["head"]
            out[-1]["cost"] = int(exits[0])
        return pa.Table.from_pylist(out, pa.schema([("conv_id", table.schema.field("conv_id").type), ("chunk", pa.int64()), ("last", pa.bool_()), ("exits", pa.list_(pa.int64())), ("illegal", pa.int64()), ("cost", pa.int64())]))

    priced = written(matrices.groupBy("conv_id").applyInArrow(chained, f"conv_id {kind}, chunk long, last boolean, exits array<long>, illegal long, cost long"), "prices")

    def led(left: pa.Table, right: pa.Table) -> pa.Table:
        _, initials, faults = _lists(left)
        stretches, _ = solve(initials, faults, tuple(right["exits"][0].as_py()), False, costs)
        row = {"conv_id": right["conv_id"][0].as_py(), "chunk": right["chunk"][0].as_py(), "to": [trace(stretches, s)[2] for s in range(4)]}
        return pa.Table.from_pylist([row], pa.schema([("conv_id", right.schema.field("conv_id").type), ("chunk", pa.int64()), ("to", pa.list_(pa.int32()))]))

    by = lambda df: df.groupBy("conv_id", "chunk")
    leads = by(light).cogroup(by(priced)).applyInArrow(led, f"conv_id {kind}, chunk long, to array<int>")

    def entered(table: pa.Table) -> pa.Table:
        state, out = _NOTHING, []
        for r in table.sort_by("chunk").to_pylist():
            out.append({"conv_id": r["conv_id"], "chunk": r["chunk"], "entry": state})
            state = r["to"][state]
        return pa.Table.from_pylist(out, pa.schema([("conv_id", table.schema.field("conv_id").type), ("chunk", pa.int64()), ("entry", pa.int32())]))

    entries = leads.groupBy("conv_id").applyInArrow(entered, f"conv_id {kind}, chunk long, entry int")
    entries = written(by(entries.unionByName(priced.drop("illegal", "cost"), allowMissingColumns=True)).agg(F.max("entry").alias("entry"), F.max("exits").alias("exits"), F.max("last").alias("last")), "entries")

    def edited(left: pa.Table, right: pa.Table) -> pa.Table:
        pos, initials, faults = _lists(left)
        r = right.to_pylist()[0]
        stretches, _ = solve(initials, faults, tuple(r["exits"]), False, costs)
        audit, turns, state = trace(stretches, r["entry"])
        if r["last"]:
            ends, _ = solve([], [], _END, True, costs)
            tail, more, _ = trace(ends, state)
            audit, turns = audit + tail, turns + more
        rows_ = [{"pos": None if p < 0 else pos[p], "place": i, "role": role} for i, (p, role) in enumerate(turns)]
        rows_.append({"pos": None, "place": -1, "role": audit})
        return pa.Table.from_pylist([{"conv_id": r["conv_id"], "chunk": r["chunk"]} | x for x in rows_], pa.schema([("conv_id", right.schema.field("conv_id").type), ("chunk", pa.int64()), ("pos", pa.int64()), ("place", pa.int32()), ("role", pa.string())]))

    edits = by(light).cogroup(by(entries)).applyInArrow(edited, f"conv_id {kind}, chunk long, pos long, place int, role string")
    full = edits.join(placed.select("pos", F.col("role").alias("old"), "text"), "pos", "left")
    turn = F.struct("place", F.coalesce("role", "old").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = by(full).agg(F.max(F.when(F.col("place") < 0, F.col("role"))).alias("audit"), F.sort_array(F.collect_list(F.when(F.col("place") >= 0, turn))).alias("repaired"))
    pieces = pieces.withColumn("repaired", F.transform("repaired", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    numbers = light.groupBy("conv_id").agg(_span(F.min("turn"), F.max("turn"), F.count_distinct("turn")).alias("gaps"), *(F.count_if(F.col("fault") == k).alias(n) for k, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    costs_ = priced.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "chunk").alias("cost"), F.count("*").alias("pieces"))
    totals = numbers.withColumnRenamed("conv_id", "c").join(costs_, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c").withColumnRenamed("conv_id", "c")
    found = pieces.join(totals, F.col("c").eqNullSafe(F.col("conv_id")))
    return found.withColumnRenamed("chunk", "piece").select(*PIECE)


def repair_conversations(rows: DataFrame, *, dropped: str | None = None, costs: Costs = Costs(), long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The cheapest edits that make each conversation alternate: an optional system message, then pairs of user and assistant.

    ``rows`` has conv_id, turn, role and text. A conversation's rows count by turn (nulls first), then by role and a digest
    of role and text, which makes repeated rows neighbours. Returned are pieces: conv_id, piece (their order; one piece for each conversation of at most
    ``long_turns`` rows and ``long_bytes`` bytes), gaps, blank, duplicate, truncated, illegal, cost and number of
    pieces of the whole conversation, and audit (K, R, D, I for keep, change of role, delete, insert) and repaired (role and text of each turn
    that results) of the piece; ``pieces_joined`` puts them together.

    Null roles and texts are one space (a text without words is blank and must go; a role of one space must be changed or go); an
    empty role has no initial. A null conv_id is one conversation. Rows of which ``dropped`` (a boolean column) is true only
    say that a conversation exists: one without other rows has zeros and nothing in audit and repaired. Repeated rows are
    duplicates, which must go. An empty table gives no rows; further columns do nothing.
    """
    need(rows, ["conv_id", "turn", "role", "text", *([dropped] if dropped else [])])
    if costs.insert < 1 or min(costs) < 0:
        raise ValueError(f"costs must be 0 or more, inserts above 0: {costs}")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.coalesce(F.col(f"`{dropped}`"), F.lit(False)) if dropped else F.lit(False)).alias("dropped"))
    rows = rows.withColumns({"fault": _fault(F.col("text")), "same": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))})
    longer = rows.groupBy(F.col("conv_id").alias("c")).agg(F.count_if(~F.col("dropped")).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).filter((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select("c")
    longer = written(longer, "long")
    if longer.isEmpty():
        return _short(rows, costs)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    chunk = 1 << max(1, long_turns.bit_length() - 1)
    return _short(rows.join(longer, same, "left_anti"), costs).unionByName(_long(rows.join(longer, same, "left_semi"), costs, chunk))


def pieces_joined(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: its totals, the whole audit, and repaired_sha256 of its turns as lines ``role:text``.

    The pieces of a long conversation stream through one task, since a digest takes its text in order; their texts are not gathered."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    flat = pieces.select("conv_id", "piece", "pieces", *TOTALS, "audit", lines.alias("lines"), (F.size("repaired") > 0).alias("some"))
    one = flat.filter("pieces = 1").select("conv_id", *TOTALS, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, audit, begun = None, None, [], False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: held[c] for c in ("conv_id", *TOTALS)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in ("conv_id", *TOTALS, "audit")] + [pa.field("repaired_sha256", pa.string())])
            for r in batch.to_pylist():
                if held is None or held["conv_id"] != r["conv_id"]:
                    if held is not None:
                        yield out()
                    held, digest, audit, begun = r, hashlib.sha256(), [], False
                if r["some"]:
                    digest.update((b"\n" if begun else b"") + r["lines"].encode())
                    begun = True
                audit.append(r["audit"])
        if held is not None:
            yield out()

    ddl = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string"
    rest = flat.filter("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(streamed, ddl)
    return one.unionByName(rest)
