import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from qcorpus.llm import conversation_repair as C
from qcorpus.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edited(roles, texts, found):
    """Dijkstra over (cost, edits): the ASCII-least cheapest edits, and their lines."""
    n = len(roles)
    heap, done = [(0, "", 0, "", ())], set()  # cost, edits, row, role initials so far (their end), lines
    while heap:
        cost, edits, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ("", "a"):
            return cost, edits, lines
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for x in nexts:
            if x != "s":
                name = {"u": "user", "a": "assistant"}[x]
                heapq.heappush(heap, (cost + 2, edits + "I", i, x, (*lines, f"{name}:")))
        if i < n:
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state, lines))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                for x in nexts:
                    if roles[i][:1] == x:
                        heapq.heappush(heap, (cost + more, edits + "K", i + 1, x, (*lines, f"{roles[i]}:{texts[i]}")))
                    if x != "s":
                        name = {"u": "user", "a": "assistant"}[x]
                        heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, x, (*lines, f"{name}:{texts[i]}")))
    raise AssertionError


def brute(original, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, lines = edited([r[2] for r in mine], [r[3] for r in mine], found)
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def reported(df, rows, **options):
    return sorted(map(tuple, C.repair_report(df, rows, **options).collect()), key=str)


def made(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "a", None, "", "usher"])
            text = rng.choice(["Hi.", "Yes!", "no stop", "Why?  ", "", None, " \n", "Tail . x", "clé.", f"own {turn}.", f"line\nof {turn}?"])
            rows.append((rng.choice([conv] * 9 + [None]), rng.choice([turn] * 9 + [None, turn + 3, 1]), role, text))
    return rows


def test_single_paths_equal_an_exhaustive_search():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 9)
        roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(n)]
        found = [rng.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        letters = [r[0] if r[0] in "sua" else "o" for r in roles]
        pattern = "".join("x" if f in ("blank", "duplicate") else x.upper() if f else x for x, f in zip(letters, found))
        cost, edits, states = C.cheapest(pattern, True, C.START, C.END)
        texts = [f"t{k}" for k in range(n)]
        want = edited(roles, texts, found)
        assert (cost, edits, tuple(C.repaired_lines(edits, states, roles, texts))) == want


def test_prices_are_a_dual_solution():
    rng = random.Random(2)
    for _ in range(200):
        pattern = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 12)))
        arcs = C.lattice(pattern, True, C.END)
        price = C.auction(arcs, C.START, len(arcs) - 1)
        leading = C._leading(arcs, len(arcs) - 1)
        assert all(price[i] <= cost + price[j] for i, out in enumerate(arcs) for cost, j, _ in out if leading[i] and leading[j])
        assert price[C.START] == C.cheapest(pattern, True, C.START, C.END)[0]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_equal_one_block(size):
    rng = random.Random(size)
    for _ in range(150):
        pattern = "".join(rng.choice("ssuuuaaaoSUAOx") for _ in range(rng.randint(1, 14)))
        parts = [pattern[i:i + size] for i in range(0, len(pattern), size)]
        ways = [C.block_ways(p, k == len(parts) - 1) for k, p in enumerate(parts)]
        cost, audit = 0, ""
        for k, (p, (entry, exit_)) in enumerate(zip(parts, C.through_blocks([w[0] for w in ways], [w[1] for w in ways]))):
            one = C.cheapest(p, k == len(parts) - 1, entry, tuple(0 if s == exit_ else C.FAR for s in range(4)))
            cost, audit = cost + one[0], audit + one[1]
        assert (cost, audit) == C.cheapest(pattern, True, C.START, C.END)[:2]


def test_report_equals_brute_force_whatever_the_blocks(spark):
    rows = made(random.Random(4), 60, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", block long, letter string").repartition(4)
    want = brute(rows, damaged(rows))
    for block in (32, 3):
        assert reported(df, C.damage(df), block=block) == want


def test_one_long_conversation(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"text {t}.", "again.", "cut"]))
            for t in range(700)] + [(8, 1, "user", "x " * 200_000 + "."), (8, 2, "assistant", "Done.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert reported(df, C.damage(df)) == brute(rows, damaged(rows))


def test_repaired_blocks_hold_the_lines(spark):
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "")], SCHEMA)
    blocks = sorted(C.repair(df).collect(), key=lambda r: r["block"])
    assert "".join(r["audit"] for r in blocks) == "KRD" and sum(r["cost"] for r in blocks) == 5
    assert [line for r in blocks for line in r["repaired"]] == ["user:A.", "assistant:B."]


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert reported(none, C.damage(none)) == []
    one = spark.createDataFrame([(1, 0, "user", "A.")], SCHEMA)
    assert reported(one, none) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_brute_force_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows, damaged(rows))
