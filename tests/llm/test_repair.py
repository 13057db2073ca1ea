"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledeframe.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, stretch int, number long, conv string, place int"
WORD = r"[^\x20\x09-\x0D]"


def cheapest(rows):
    """Uniform-cost search over (cost, edits): rows are (initial, fault)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, path, i, state = heapq.heappop(heap)
        if (i, state) in done and i < len(rows):
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, path
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        heapq.heappush(heap, (cost + 5, path + "I", i, due))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, path + "D", i + 1, state))
            if fault not in "bd":
                extra = 5 if fault == "t" else 0
                if initial == due or (initial == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, path + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 1 + extra, path + "R", i + 1, due))


def brute(rows):
    """conv_id -> the query's columns, of undamaged rows (conv_id, turn, role, text)."""
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in turns:
            last = re.findall(WORD, text)[-1:]
            marks.append((role[:1], "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "-"))
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        faults = [m[1] for m in marks]
        initials = [m[0] for m in marks]
        cost, audit = cheapest(marks)
        kept, state, place = [], "", 0
        for e in audit:
            due = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            role, text = turns[place][1:] if e != "I" else ("", "")
            if e != "D":
                state = role[:1] if e == "K" else due
                kept.append((role if e == "K" else {"u": "user", "a": "assistant"}[due]) + ":" + text)
            place += e != "I"
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def rows_for(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(120), None, 500]:
        n = 700 if c == 500 else rnd.randint(1, 9)
        for t in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "useful"])
            text = rnd.choice(["Hi.", "What?", "no end", "", None, " \t\n", "Ok! ", "É ß 中文.", f"n {t}.", f"n {t}!", "x" * 3000 + "."])
            rows.append((c, rnd.choice([t] * 8 + [t + 20, None]), role, text))
    return rows + [rows[0], rows[0], rows[5]]


@pytest.mark.parametrize("seed,bits", [(1, 8), (2, 1), (3, 4)])
def test_brute_force(spark, tmp_path, monkeypatch, seed, bits):
    monkeypatch.setattr(repair, "STRETCH_BITS", bits)
    rows = rows_for(seed)
    df = spark.createDataFrame([(*r, "k", 1, 2, "c", 3) for r in rows], SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_search_finds_the_least_path():
    rnd = random.Random(5)
    codes = {(role, fault): chr(97 + r + 4 * f) for r, role in enumerate("suax") for f, fault in enumerate("-tb")}
    for _ in range(3000):
        marks = [(rnd.choice("suaaux"), rnd.choice("----tb")) for _ in range(rnd.randint(1, 12))]
        cost, path = repair.search("".join(codes[m] for m in marks), repair.NONE, (repair.NONE, repair.ASSISTANT), True)
        assert (cost, path) == cheapest(marks), marks


def test_one_conversation_over_many_tasks(spark):
    """A conversation of 30,000 turns: several partitions and stretches, the same result as in one search."""
    rnd = random.Random(6)
    rows = [(7, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"{t}.", f"{t}", ""])) for t in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, left = repair.repair_conversations(df.repartition(8))
    r = report.collect()
    assert len(r) == 1 and r[0]["audit"].count("I") + 30_000 == len(r[0]["audit"])
    edits = r[0]["audit"]
    assert left.count() == len(edits) - edits.count("D")
    prices = {"D": 2, "I": 5, "K": 0, "R": 1}
    place, cost = 0, 0
    for e in edits:
        cost += prices[e]
        if e != "I":
            cost += 5 if e in "KR" and not rows[place][3].endswith(".") else 0
            place += 1
    assert cost == r[0]["cost"]
    # The price by dynamic programming.
    best = {"": 0}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    for _, _, role, text in rows:
        for s in sorted(best, key=best.get) * 2:
            best[due[s]] = min(best.get(due[s], 1 << 40), best[s] + 5)
        new = {s: v + 2 for s, v in best.items()}
        if text:
            extra = 0 if text.endswith(".") else 5
            for s, v in best.items():
                new[due[s]] = min(new.get(due[s], 1 << 40), v + extra + (role[0] != due[s]))
        best = new
    assert cost == min(best.get("", 1 << 40), best.get("a", 1 << 40), best.get("u", 1 << 40) + 5)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    report, left = repair.repair_conversations(none)
    assert report.collect() == [] and left.collect() == []
    one = spark.createDataFrame([(1, 1, "user", "")], "conv_id long, turn long, role string, text string")
    report, left = repair.repair_conversations(one)
    assert [tuple(r) for r in report.collect()] == [(1, 0, 1, 0, 0, 0, 2, "D")] and left.collect() == []


def test_digests_stream(spark):
    rows = [(g, i, f"line {g} {i}") for g in (None, 1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i int, t string").repartition(7)
    got = {r["g"]: r["sha256"] for r in repair.digests(df, "g", ["i"], "t").collect()}
    assert got == {g: hashlib.sha256("\n".join(f"line {g} {i}" for i in range(500)).encode()).hexdigest() for g in (None, 1, 2)}


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(30), None) for t, r, x in [(0, "user", "Hi. Ho!"), (1, None, None), (None, "assistant", "?")]]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        new = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        want += [] if kind == 0 else [new, new] if kind == 3 else [new]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.select(F.max("turn")).first()[0] == 1
