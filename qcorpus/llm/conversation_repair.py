"""Conversation structure repair by an auction shortest-path algorithm.

A conversation should have the role initials ``(s?(ua)+)?``.  Its rows, in order,
and four states (nothing yet, after the system row, after a user, after an
assistant) span a lattice; the edits of a row lead to the next column, inserted
rows stay in theirs:

====== ==== =============================================================
edit   cost
====== ==== =============================================================
Keep   0    the row as it is, if its initial is allowed next
Rerole 2    the row as user or assistant
Delete 3    the only edit of a blank or duplicate row
Insert 2    an empty row of user or assistant, anywhere
====== ==== =============================================================

A truncated row that is not deleted costs 1 more.

The auction keeps a price for every node and a path from the origin.  The path's
last node i compares its price with the least arc cost plus price of the
neighbour: a lower price is raised to it and the path contracts by i; otherwise
the path extends to that neighbour.  Prices never exceed arc cost plus the
neighbour's price, so when the path reaches the target they are a dual solution:
the origin's price is the distance and every cheapest path runs over tight arcs.
Among the tight arcs that lead on to the target the trace takes the least edit
initial; an initial has one successor in each state, so the string found is the
ASCII-least of all cheapest ones.

Scale: rows are sorted once by range, so a conversation that holds a third of all
rows spreads over many tasks, and each conversation is cut into blocks of ``BLOCK``
rows.  A conversation of one block is solved by itself.  For a longer one every
block gives its cheapest path between each pair of states; one group per
conversation of these small matrices (32 numbers per block, less than the audit
string that the conversation's one result row holds anyway) picks the states
at the block ends, and the blocks are then traced in parallel.

Cases: a null role or text counts as one space, a null turn sorts first; rows of
the same turn are ordered by role, then text; an empty role has no legal initial and
its neighbours count as illegal; repeated rows are duplicates by the rule; other
columns are ignored; a null conversation id is a conversation; an empty table
gives an empty result.  Long texts are carried whole, never compared (a digest
is); a block's texts are held together, at most ``BLOCK`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import stored

BLOCK = 32
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: What may follow each state, as (initial, next state).
NEXT = {START: (("s", SYSTEM), ("u", USER)), SYSTEM: (("u", USER),), USER: (("a", ASSISTANT),), ASSISTANT: (("u", USER),)}
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
#: Cost of ending in each state at the end of a conversation.
END = (0, FAR, FAR, 0)

Arc = tuple[int, int, str]  # cost, node, edit


def lattice(pattern: str, last: bool, exits: Sequence[int]) -> list[list[Arc]]:
    """Arcs of the lattice of a block.  ``pattern`` has a letter per row: x for
    rows that must go, else the initial (o: none that is legal), upper case if
    truncated.  Node 4 * column + state; the last node is the target, reached
    from the states of the last column at the cost ``exits``."""
    target = 4 * (len(pattern) + 1)
    arcs: list[list[Arc]] = [[] for _ in range(target + 1)]
    for column in range(len(pattern) + 1):
        for state in range(4):
            out, node = arcs[4 * column + state], 4 * column
            if column < len(pattern):
                letter = pattern[column]
                out.append((3, node + 4 + state, DELETE))
                if letter != "x":
                    more = 1 if letter.isupper() else 0
                    for initial, state2 in NEXT[state]:
                        if letter.lower() == initial:
                            out.append((more, node + 4 + state2, KEEP))
                        if state2 in NAMES:
                            out.append((2 + more, node + 4 + state2, REROLE))
            elif exits[state] < FAR:
                out.append((exits[state], target, ""))
            if column < len(pattern) or last:  # the last column of a block is the first of the next one
                out.extend((2, node + state2, INSERT) for _, state2 in NEXT[state] if state2 in NAMES)
    return arcs


def _leading(arcs: list[list[Arc]], target: int, tight: list[int] | None = None) -> list[bool]:
    """The nodes from which the target can be reached (over tight arcs)."""
    back: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for cost, to, _ in out:
            if tight is None or tight[node] == cost + tight[to]:
                back[to].append(node)
    seen, todo = [False] * len(arcs), [target]
    seen[target] = True
    while todo:
        for node in back[todo.pop()]:
            if not seen[node]:
                seen[node] = True
                todo.append(node)
    return seen


def auction(arcs: list[list[Arc]], origin: int, target: int) -> list[int] | None:
    """Prices at which a path of tight arcs joins origin and target; None if
    no path does.  Costs are whole numbers from 0, cycles cost more than 0."""
    leading = _leading(arcs, target)
    if not leading[origin]:
        return None
    open_arcs = [[a for a in out if leading[a[1]]] for out in arcs]
    price, path = [0] * len(arcs), [origin]
    while path[-1] != target:
        node = path[-1]
        best, to = min((cost + price[j], j) for cost, j, _ in open_arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price


@lru_cache(maxsize=20_000)
def cheapest(pattern: str, last: bool, entry: int, exits: tuple[int, ...]) -> tuple[int, str, tuple[int, ...]] | None:
    """(cost with the exit's, edits, state after each edit) of the ASCII-least
    cheapest way from ``entry``, or None."""
    arcs = lattice(pattern, last, exits)
    target = len(arcs) - 1
    price = auction(arcs, entry, target)
    if price is None:
        return None
    leading = _leading(arcs, target, price)
    node, edits, states = entry, [], []
    while True:
        edit, to = min((edit, to) for cost, to, edit in arcs[node] if price[node] == cost + price[to] and leading[to])
        if to == target:
            return price[entry] - price[target], "".join(edits), tuple(states)
        edits.append(edit)
        states.append(to % 4)
        node = to


def block_ways(pattern: str, last: bool) -> tuple[list[int], list[int]]:
    """Per (entry, exit): the cost between them and the rank of its edits among
    those of the same entry."""
    costs, ranks = [], []
    for entry in range(4):
        ways = [cheapest(pattern, last, entry, tuple(0 if s == q else FAR for s in range(4))) for q in range(4)]
        order = sorted({w[1] for w in ways if w})
        costs += [w[0] if w else FAR for w in ways]
        ranks += [order.index(w[1]) if w else 0 for w in ways]
    return costs, ranks


def through_blocks(costs: Sequence[Sequence[int]], ranks: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """(entry, exit) of each block on the ASCII-least cheapest way.  Ways of a
    block that differ in their exit differ in an edit before either ends, so
    the rank of a block's edits decides between equal costs."""
    togo, after = list(END), []
    for matrix in reversed(costs):
        after.append(togo)
        togo = [min(FAR, *(matrix[4 * q + r] + togo[r] for r in range(4))) for q in range(4)]
    out, state = [], START
    for matrix, rank, togo in zip(costs, ranks, reversed(after)):
        exit_ = min(range(4), key=lambda r: (min(FAR, matrix[4 * state + r] + togo[r]), rank[4 * state + r]))
        out.append((state, exit_))
        state = exit_
    return out


def repaired_lines(edits: str, states: Sequence[int], roles: Sequence[str], texts: Sequence[str]) -> list[str]:
    out, row = [], 0
    for edit, state in zip(edits, states):
        if edit == INSERT:
            out.append(f"{NAMES[state]}:")
            continue
        if edit != DELETE:
            out.append(f"{roles[row] if edit == KEEP else NAMES[state]}:{texts[row]}")
        row += 1
    return out


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(``conv_id:turn``)
    % 20: 0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it,
    4 makes it a user's."""
    kind = F.crc32(F.encode(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_spaced("text"), "[.!?]", "")).otherwise(_spaced("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_spaced("role")).alias("role"), text.alias("text"),
                        F.explode(F.array_repeat(F.lit(1), copies)).alias("one")).drop("one"))


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per block of a conversation's rows (conv_id, turn, role, text), blocks
    of a conversation ascending: conv_id, block, n_blocks, n_rows, blank, duplicate,
    truncated, illegal (within the block), first, last (role initials), cost,
    audit, repaired (array of ``role:text``)."""
    slim = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids rise along the order: partitions are ranges of it
    ordered = stored(slim.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                     .withColumn("id", F.monotonically_increasing_id()), "turns")
    # texts meet their block and whether they were seen before by id: one join of slim rows
    seen = ordered.select("id", "conv_id", F.md5(F.to_json(F.struct("conv_id", "role", "text"))).alias("digest"))
    seen = seen.join(seen.groupBy("digest").agg(F.min("id").alias("first_id")), "digest").alias("a")
    firsts = ordered.groupBy("conv_id").agg(F.min("id").alias("first_row")).alias("b")
    placed = (seen.join(firsts, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")))
              .select("id", (F.col("id") > F.col("first_id")).alias("again"),
                      F.floor((F.col("id") - F.col("first_row")) / block).alias("block")))
    rows = ordered.join(placed, "id")
    shown = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    blank = shown == ""
    duplicate = ~blank & F.col("again")
    truncated = ~blank & ~duplicate & ~shown.isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(blank | duplicate, "x").when(truncated, F.upper(letter)).otherwise(letter)
    row = F.struct("id", letter.alias("letter"), "role", "text", initial.alias("initial"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), *(F.count_if(c).alias(n) for n, c in
                                                           (("blank", blank), ("duplicate", duplicate), ("truncated", truncated))))
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(initials, F.slice(initials, 2, F.size(initials)), lambda x, y: F.concat(x, y))
    blocks = stored(blocks.select(
        "conv_id", "block", F.size("rows").alias("n_rows"), "blank", "duplicate", "truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).alias("illegal"), F.get(initials, F.lit(0)).alias("first"),
        F.element_at(initials, -1).alias("last"), F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("pattern"),
        F.transform("rows", lambda r: r["role"]).alias("roles"), F.transform("rows", lambda r: r["text"]).alias("texts")), "blocks")
    counts = blocks.groupBy("conv_id").agg(F.count("*").alias("n_blocks"), F.max("block").alias("last_block"))
    blocks = (blocks.alias("c").join(counts.alias("d"), F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")))
              .select("c.*", "n_blocks", "last_block"))
    alone = blocks.where("n_blocks = 1").select(*_CARRIED, F.lit(START).alias("entry"), F.lit(None).cast("int").alias("exit"),
                                                F.lit(True).alias("final"))
    many = blocks.where("n_blocks > 1").withColumn("final", F.col("block") == F.col("last_block"))
    ends = _block_ends(many.select("conv_id", "block", "pattern", "final"))
    many = many.alias("e").join(ends.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.block") == F.col("f.block")))
    many = many.select(*(f"e.{x}" for x in _CARRIED), "f.entry", "f.exit", "e.final")
    return _traced(alone.unionByName(many))


_CARRIED = ("conv_id", "block", "n_blocks", "n_rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "pattern", "roles", "texts")


def _block_ends(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, entry, exit) of the blocks of longer conversations."""
    @F.arrow_udf("struct<costs: array<bigint>, ranks: array<bigint>>")
    def ways(patterns: pa.Array, finals: pa.Array) -> pa.Array:
        found = [block_ways(p, f) for p, f in zip(patterns.to_pylist(), finals.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)],
                                          ["costs", "ranks"])

    @F.arrow_udf("array<struct<entry: int, exit: int>>")
    def ends(chains: pa.Array) -> pa.Array:
        out = []
        for chain in chains:
            chain = chain.as_py()
            found = through_blocks([w["costs"] for w in chain], [w["ranks"] for w in chain])
            out.append([{"entry": a, "exit": b} for a, b in found])
        return pa.array(out, pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32())])))

    solved = blocks.select("conv_id", "block", ways("pattern", "final").alias("way"))
    chains = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "way"))).alias("chain"))
    states = ends(F.transform("chain", lambda x: x["way"]))
    both = F.explode(F.arrays_zip(F.transform("chain", lambda x: x["block"]).alias("block"), F.col("states")))
    return (chains.select("conv_id", "chain", states.alias("states")).select("conv_id", both.alias("x"))
            .select("conv_id", "x.block", "x.states.entry", "x.states.exit"))


def _traced(blocks: DataFrame) -> DataFrame:
    """The blocks with cost, audit and repaired lines."""
    @F.arrow_udf("struct<cost: bigint, audit: string, repaired: array<string>>")
    def trace(patterns: pa.Array, finals: pa.Array, entries: pa.Array, exits: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
        costs, audits, lines = [], [], []
        for p, final, entry, exit_, r, t in zip(*(c.to_pylist() for c in (patterns, finals, entries, exits)), roles, texts):
            at = END if exit_ is None else tuple(0 if s == exit_ else FAR for s in range(4))
            cost, audit, states = cheapest(p, final, entry, at)
            costs.append(cost)
            audits.append(audit)
            lines.append(repaired_lines(audit, states, r.as_py(), t.as_py()))
        return pa.StructArray.from_arrays([pa.array(costs, pa.int64()), pa.array(audits, pa.string()),
                                           pa.array(lines, pa.list_(pa.string()))], ["cost", "audit", "repaired"])

    out = blocks.withColumn("way", trace("pattern", "final", "entry", "exit", "roles", "texts"))
    return out.select(*_CARRIED[:-3], "way.cost", "way.audit", "way.repaired")


def repair_report(original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conv_id of ``original`` what the repair of ``rows`` found and did:
    gaps, blank, duplicate, truncated, illegal, cost (long), audit and
    repaired_sha256 (string)."""
    turns = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    blocks = repair(rows, block)
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    alone = blocks.where("n_blocks = 1").select("conv_id", *(F.col(n).cast("long").alias(n) for n in numbers), "audit",
                                                F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    long = blocks.where("n_blocks > 1").drop("n_blocks").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    schema = alone.schema
    kind = to_arrow_type(blocks.schema["conv_id"].dataType)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation follow each other; texts are hashed as they come."""
        def row(key, sums, audit, digest):
            columns = [pa.array([key], kind), *(pa.array([v], pa.int64()) for v in sums),
                       pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        open_, key, before = False, None, ""
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                if not open_ or one["conv_id"] != key:
                    if open_:
                        yield row(key, sums, audit, digest)
                    open_, key, before, sums, audit, digest, empty = True, one["conv_id"], None, [0] * 5, [], hashlib.sha256(), True
                sums = [s + one[n] for s, n in zip(sums, numbers)]
                if before is not None and before + one["first"] not in ("su", "ua", "au"):
                    sums[3] += 1
                before = one["last"]
                audit.append(one["audit"])
                for line in one["repaired"]:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
        if open_:
            yield row(key, sums, audit, digest)

    per = alone.unionByName(long.mapInArrow(joined, schema))
    ids = original.select("conv_id").distinct()
    out = ids.alias("i").join(per.alias("p"), F.col("i.conv_id").eqNullSafe(F.col("p.conv_id")), "left")
    out = out.select("i.conv_id", *(f"p.{c}" for c in per.columns[1:]))
    out = out.alias("o").join(turns.alias("t"), F.col("o.conv_id").eqNullSafe(F.col("t.conv_id")), "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", *numbers)]
    return out.select("o.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
