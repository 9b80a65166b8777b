"""Conversation repair against a search over all edit sequences and a row-by-row reading of the contract."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from spindrift.llm import conversations, queries, sql_twins


def cheapest(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault): best-first search by cost, then audit."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        state = "" if not roles else roles[-1]
        if at == len(rows) and (not roles or state == "a"):
            return cost, audit, list(out)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        fits = lambda x: x in {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and fits(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*out, (role, text))))
                for to in ("user", "assistant"):
                    if fits(to[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + to[0], (*out, (to, text))))


def expected(table):
    """The contract, row by row, of (conv_id, turn, role, text) tuples."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def run(df):
    rows = conversations.damage(df)
    return conversations.with_digests(rows, conversations.audit(rows))


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows():
    r = random.Random(8)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Yes.", "What?  \n", None, "é ü.", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "sage", "unknown"]
    rows = []
    for conv in [*range(120), None]:
        for _ in range(r.randrange(1, 9)):
            role = r.choice(roles[:2]) if r.random() < 0.7 else r.choice(roles)
            rows.append((conv, r.choice([None, *range(12)]), role, r.choice(texts)))
    return rows + rows[:9]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(run(df)) == expected(rows)
    extra = df.selectExpr("*", "'z' AS audit", "'z' AS pos", "'z' AS copies", "'z' AS letters", "'z' AS gaps", "'z' AS run")
    assert result(run(extra)) == expected(rows)
    assert run(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    table = queries.table(spark, sf_dir, "conversations")
    assert result(queries.op12_conversation_repair(spark, sf_dir)) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_cut_conversations_equal_whole_ones(spark, monkeypatch):
    """Pieces of a conversation join into the result of the whole."""
    r = random.Random(2)
    strings = ["".join(chr(65 + r.randrange(16)) for _ in range(r.randrange(0, 60))) for _ in range(300)] + ["E" * 50, "", "A", "I" * 33]
    whole = conversations.solve(strings)
    for size in (1, 2, 7, 16):
        monkeypatch.setattr(conversations, "PIECE", size)
        assert conversations.solve(strings) == whole
    for s, got in list(zip(strings, whole))[:120]:
        rows = [("sua "[(ord(c) - 65) // 4] if (ord(c) - 65) // 4 < 3 else "x", "t", [None, "blank", "duplicate", "truncated"][(ord(c) - 65) % 4]) for c in s]
        assert cheapest(rows)[:2] == (got.cost, got.audit)


def test_a_hot_conversation_is_spread_and_right(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 64)
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Yes.", f"t{t}.", "cut", ""])) for t in range(3000)] + [(c, t, "user", "Hm.") for c in range(2, 300) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(run(df)) == expected(rows)


def test_repaired_turns_are_legal(spark):
    rows = odd_rows()
    table = conversations.plain_rows(spark.createDataFrame(rows, SCHEMA))
    turns = conversations.repaired_turns(table, conversations.audit(table)).collect()
    whole = {}
    for t in sorted(turns, key=lambda t: (t.conv_id is None, t.conv_id or 0, t.position)):
        whole.setdefault(t.conv_id, []).append(t)
    for part in whole.values():
        assert [t.position for t in part] == list(range(len(part)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in part))


@pytest.mark.parametrize("n", [5000, 20000])
def test_long_strings_are_quick(n):
    got = conversations.solve(["EI" * n, "E" * n])
    assert got[0].cost == 0 and got[0].audit == "K" * 2 * n and len(got[1].audit) >= n


def test_the_sql_twin_reads_the_contract_alike():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd_rows())
    assert {r[0]: r[1:] for r in con.execute(sql_twins.conversations()).fetchall()} == expected(odd_rows())
