"""Conversation repair against plain searches over all edits, and the registered query against them."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

from pricewell.llm import queries, repair

SF = "/root/testdata/sf0.001"


def searched(letters):
    """(cost, audit) of the cheapest repair: a best-first search over rows done and roles said."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, row, roles = heapq.heappop(heap)
        key = row, roles[-1:], roles == "s"
        if key in done:
            continue
        done.add(key)
        if row == len(letters) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        fits = lambda x: re.fullmatch("s?|s?(ua)*u?", x)
        for by in "ua":
            if fits(roles + by):
                heapq.heappush(heap, (cost + 2, audit + "I", row, roles + by))
        if row < len(letters):
            x = letters[row]
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, roles))
            if x != "x":
                if fits(roles + x.lower()):
                    heapq.heappush(heap, (cost + x.isupper(), audit + "K", row + 1, roles + x.lower()))
                for by in "ua":
                    if fits(roles + by):
                        heapq.heappush(heap, (cost + 2 + x.isupper(), audit + "R", row + 1, roles + by))


def enumerated(letters):
    """The least of all edit lists with up to two insertions at each place."""
    found = []
    for inserted in product(range(3), repeat=len(letters) + 1):
        for ops in product("KRD", repeat=len(letters)):
            audit = "".join("I" * n + op for n, op in zip(inserted, [*ops, ""]))
            open_roles, cost, row = [""], 0, 0
            for op in audit:
                x = letters[row] if op != "I" else ""
                row += op != "I"
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[op] + (x.isupper() and op != "D")
                if op == "D":
                    continue
                if x == "x":
                    open_roles = []
                open_roles = [r + by for r in open_roles for by in (x.lower() if op == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", r) for r in open_roles):
                found.append((cost, audit))
    return min(found)


def test_parse_finds_the_least_repair():
    for n in range(3):
        for letters in product("suaoSUx", repeat=n):
            assert repair.parse("".join(letters)) == enumerated("".join(letters)) == searched("".join(letters))
    r = random.Random(3)
    for _ in range(1_500):
        letters = "".join(r.choice("sssuuuaaaoSUAOxx") for _ in range(r.randrange(3, 14)))
        assert repair.parse(letters) == searched(letters), letters


def test_any_bracketing_gives_the_same_cell():
    """Cells from one split for each span are those of a full chart over all spans and all splits."""
    r = random.Random(5)
    for _ in range(60):
        letters = "".join(r.choice("suaoSUAx") for _ in range(r.randrange(2, 9)))
        n, chart = len(letters), {}
        for i, x in enumerate(letters):
            chart[i, i + 1] = repair.of_row(x)
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                cell = chart[i, i + size] = {}
                for k in range(i + 1, i + size):
                    for key, found in repair.joined(chart[i, k], chart[k, i + size]).items():
                        repair.least(cell, key, found)
        assert min(chart[0, n][repair.NOTHING, q] for q in repair.ENDS if (repair.NOTHING, q) in chart[0, n]) == repair.parse(letters)


def test_long_conversations():
    cost, audit = repair.parse("ua" * 50_000 + "x" + "uA")
    assert cost == 4 and audit == "K" * 100_000 + "D" + "KK"


def expected(rows):
    """The contract's row of one conversation, from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults, letters = set(), [], ""
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        by = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else by.upper() if fault else by
    cost, audit = searched(letters)
    said, row, roles = [], 0, ""
    for op in audit:
        role, text = (rows[row][1], rows[row][2]) if op != "I" else ("", "")
        row += op != "I"
        if op == "D":
            continue
        if op != "K":
            role = "assistant" if roles[-1:] == "u" else "user"
        roles += role[0]
        said.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: expected(m) for c, m in out.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df, rows):
    got = df.collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == harmed(rows) and len(got) == len(harmed(rows))


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op11_conversation_repair(spark, SF), rows)


def test_odd_rows(spark, tmp_path):
    r = random.Random(8)
    said = ["Yes.", "no", "", " \t\n", None, "Why?", "Well! \n", "x" * 20_000]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 0, 1, 2, 2, 5, 9]), r.choice([None, "", "user", "assistant", "system", "tool", "s", "User"]), r.choice(said)) for _ in range(90)]
    rows += [(100 + k, k % 3, "user", "Only one.") for k in range(60)]
    d = spark.createDataFrame([(*x, "mine", 1) for x in rows], "conv_id long, turn long, role string, text string, letter string, pos int").repartition(5)
    d.write.parquet(str(tmp_path / "conversations.parquet"))
    same(queries.op11_conversation_repair(spark, str(tmp_path)), rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in harmed(rows).values())
    made = repair.edits(repair.damaged(d))
    assert made.columns == ["conv_id", "place", "edit", "cost", "turn", "old_role", "role", "text", "fault", "illegal"]
    assert repair.edits(d.limit(0)).count() == 0
