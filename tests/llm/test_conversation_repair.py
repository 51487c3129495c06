"""Repair against a search over all edits, against a plain left-to-right table, and the damage and counts of the query."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from quillgraph.llm import conversation_repair as c
from quillgraph.llm.queries import op13_conversation_repair

GOOD = re.compile(r"(s?(ua)+)?")


def exhaustive(rows, most=2):
    """Least (cost, audit) over all edits with at most ``most`` insertions at each place."""
    best = None
    choices = []
    for initial, fault in rows:
        ways = [("D", "", 2)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            ways += [("K", initial, more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        choices.append(ways)
    inserts = ["".join(p) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    for ways in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = put[0], "I" * len(put[0]), 5 * len(put[0])
            for (edit, role, price), more in zip(ways, put[1:]):
                roles, audit, cost = roles + role + more, audit + edit + "I" * len(more), cost + price + 5 * len(more)
            if GOOD.fullmatch(roles) and all(e != "K" or r in "sua" and r for e, r, _ in ways) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain(rows):
    """The same by one pass over the automaton's states."""
    def close(table):
        for _ in range(4):
            for (p, role), q in c.MOVES.items():
                if p in table and role != "s":
                    found = (table[p][0] + 5, table[p][1] + "I")
                    table[q] = min(table.get(q, found), found)
        return table

    table = close({0: (0, "")})
    for initial, fault in rows:
        then = {p: (cost + 2, audit + "D") for p, (cost, audit) in table.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            for (p, role), q in c.MOVES.items():
                if p in table and (role == initial or role != "s"):
                    found = (table[p][0] + more + (role != initial), table[p][1] + ("K" if role == initial else "R"))
                    then[q] = min(then.get(q, found), found)
        table = close(then)
    return min(table[p] for p in (0, 3) if p in table)


def parse(rows):
    parser = c.Parser()
    for row in rows:
        parser.add(*row)
    return parser.result()


def test_parse_is_the_cheapest_of_all_edits():
    for n in range(3):
        for rows in itertools.product(itertools.product("suax", ["", "blank", "truncated"]), repeat=n):
            assert parse(rows) == exhaustive(rows)


def test_long_conversations_by_doubling_spans():
    r = random.Random(2)
    for n in [*range(3, 70), 400, 1000]:
        rows = [(r.choice("suuuaaax "), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert parse(rows) == plain(rows)


def test_cells_do_not_depend_on_the_split():
    r = random.Random(3)
    rows = [c.row_cells(r.choice("sua"), r.choice(["", "truncated"])) for _ in range(7)]
    whole = c.block_cells(rows)
    for i in range(1, 7):
        assert c.combined(c.block_cells(rows[:i]), c.block_cells(rows[i:])) == whole


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        a, b, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        bucket = crc32(f"{a}:{b}".encode()) % 20
        if bucket == 0:
            continue
        place = (turn is not None, turn or 0, role)
        text = "" if bucket == 1 else re.sub(r"[.!?]", "", text) if bucket == 2 else text
        kept += [(place, "user" if bucket == 4 else role, text)] * (1 + (bucket == 3))
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda k: k[0])
        turns, seen, faults = [k[0][1] for k in kept if k[0][0]], set(), []
        for _, role, text in kept:
            core = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain([(role[:1], f) for (_, role, _), f in zip(kept, faults)])
        left, fixed = iter(kept), []
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                done = sum(r != "system" for r, _ in fixed)
                fixed.append((role if edit == "K" else ["user", "assistant"][done % 2], text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def as_dict(df):
    return {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_the_brute_force(spark, sf):
    data = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(op13_conversation_repair(spark, data)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 60 if i % 11 else None, r.choice([None, *range(9)]) if i % 60 > 50 else i // 60, r.choice(["user", "assistant", "system", None, "", "Tool"]), r.choice([None, "", " \t", "Hi.", "Why?", "cut off", "é "])) for i in range(900)]
    rows += [(1000, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(700)] + [(1001, 5, "user", "x" * 300000)]
    rows = list({(a, b): (a, b, x, y) for a, b, x, y in rows}.values())  # equal turns have an order of their own, tested below
    spark.createDataFrame([(*x, 1, "clash") for x in rows], "conv_id long, turn long, role string, text string, copy int, place string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert as_dict(op13_conversation_repair(spark, str(tmp_path))) == brute(rows)


def test_equal_turns_and_empty_tables(spark, tmp_path):
    rows = [(7, 1, "user", "b."), (7, 1, "assistant", "a."), (7, 1, "user", "b."), (7, None, "system", "s.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in c.report(df, lambda conv, turn: c.F.lit(9)).collect()}
    assert (got[7]["audit"], got[7]["duplicate"], got[7]["cost"]) == ("KRRD", 1, 4)  # s, then assistant before user, by role
    assert c.report(df.limit(0), lambda conv, turn: c.F.lit(9)).collect() == []
    dropped = c.report(df, lambda conv, turn: c.F.lit(0)).collect()
    assert [tuple(r) for r in dropped] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
