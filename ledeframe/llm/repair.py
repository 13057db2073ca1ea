"""Conversation structure repair by iterative-deepening A*.

A well-formed conversation is empty, or an optional system turn and then pairs of a user
and an assistant turn. Its turns are walked in order and each is kept, given the
role that is due, or deleted; turns without text may be inserted anywhere. Every edit
has a price, and the cheapest sequence of edits is found by depth-first search, edits in ASCII
order of their initials (Delete, Insert, Keep, Rerole), under a bound on the total price that is
raised until a path is found. The first one found is the answer. A state is the
number of turns behind and the role of the last one left; the transposition table holds for every
state that failed the price that its failure has shown to be needed at least, so it is
entered again only with more than that.

Turns are range-partitioned by conversation and turn and written once with a growing number, so a
conversation of any length is spread over many tasks. What the search has to know of a turn is
one character. Characters are gathered in stretches of at most ``1 << STRETCH_BITS`` turns; nearly every
conversation is one stretch. A longer one is searched stretch by stretch, in parallel,
once for each pair of a state before and a state after it, and the cheapest chain of stretches
is picked from these prices, one small row per stretch. Equal prices go by the paths' ASCII order;
a path ends with the stretch's last turn, so no path of a pair begins another one and the
least chain is the least sequence of the conversation.

Turns without a text are inserted as ``""``. Only the final digest reads a conversation in one
task, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledeframe.llm.common import BLANK, ship_code, written

STRETCH_BITS = 8  # turns with one number after this shift are a stretch
DELETE, RELABEL, INSERT, TRUNCATED = 2, 1, 5, 5  # prices; keeping is free

# A turn is chr(97 + role + 4 * fault), by role's initial and first fault.
ROLES = "sua"  # any other initial is 3
SOUND, CUT, VOID = 0, 1, 2  # VOID: blank or duplicate, must go
# States: nothing left so far, and the role of the last turn left.
NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40


@functools.cache
def _moves(turn: str, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, price, turns consumed, next state) of the edits at a turn, or at the end ("" as turn)."""
    insert = ("I", INSERT, 0, DUE[state])
    if not turn:
        return [insert]
    fault, role = divmod(ord(turn) - 97, 4)
    moves = [("D", DELETE, 1, state), insert]
    if fault != VOID:
        extra = TRUNCATED if fault == CUT else 0
        due = DUE[state]
        if role + 1 == due or (role + 1 == SYSTEM and state == NONE):
            moves.append(("K", extra, 1, role + 1))
        if role + 1 != due:
            moves.append(("R", RELABEL + extra, 1, due))
    return moves


def search(turns: str, start: int, goals: tuple[int, ...], last: bool) -> tuple[int, str]:
    """Price and edits of the cheapest, and of those the ASCII-least, way from ``start`` over all ``turns`` to one of
    the states ``goals``. Only if ``last`` may turns be inserted behind the last one. A goal that cannot be reached costs ``NEVER``."""
    n = len(turns)
    faults = [(ord(t) - 97) // 4 for t in turns]
    if goals == (NONE,) and start != NONE or goals == (SYSTEM,) and not (start == SYSTEM or start == NONE and {chr(97), chr(97 + 4 * CUT)} & set(turns)):
        return NEVER, ""
    least = [0] * (n + 1)  # what the faults from a turn on cost in any case
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (min(DELETE, TRUNCATED) if faults[i] == CUT else DELETE if faults[i] == VOID else 0)
    needed = [[x] * 4 for x in least]  # the transposition table
    if not last:
        needed[n] = [0 if s in goals else NEVER for s in range(4)]
    while True:
        bound = needed[0][start]
        if bound >= NEVER:
            return NEVER, ""
        if n == 0 and start in goals:
            return 0, ""
        path: list[str] = []
        frames = [[0, start, bound, iter(_moves(turns[:1], start)), NEVER, 0]]
        while frames:
            frame = frames[-1]
            i, state, left = frame[0], frame[1], frame[2]
            for initial, price, step, after in frame[3]:
                j = i + step
                least_so = price + needed[j][after]
                if least_so > left:
                    if least_so < frame[4]:
                        frame[4] = least_so
                    continue
                path.append(initial)
                if j == n and after in goals:
                    return bound, "".join(path)
                follow = _moves(turns[j], after) if j < n else _moves("", after) if last else []
                frames.append([j, after, left - price, iter(follow), NEVER, price])
                break
            else:
                frames.pop()
                if frame[4] > needed[i][state]:
                    needed[i][state] = frame[4]
                if frames:
                    path.pop()
                    up = frame[5] + needed[i][state]
                    if up < frames[-1][4]:
                        frames[-1][4] = up


@functools.lru_cache(1 << 16)
def solve(turns: str, first: bool, last: bool) -> tuple[list[int], list[int], list[str]]:
    """For each state before and after a stretch (4 * before + after): price, place of the path among those with the
    same state before, and path. Behind the last stretch the state ``NONE`` stands for any that may end a conversation."""
    prices, paths = [NEVER] * 16, [""] * 16
    for before in (NONE,) if first else range(4):
        for after in (NONE,) if last else range(4):
            goals = (NONE, ASSISTANT) if last else (after,)
            prices[4 * before + after], paths[4 * before + after] = search(turns, before, goals, last)
    places = [sorted(set(paths[4 * (k // 4) : 4 * (k // 4) + 4])).index(paths[k]) for k in range(16)]
    return prices, places, paths


def chain(stretches: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """Price of the cheapest chain of stretches and the pair of states (4 * before + after) it takes each by, given
    prices and places as of ``solve``."""
    rest = [0] * 4  # cheapest from a state to the end
    picks = []
    for number, (prices, places) in enumerate(reversed(stretches)):
        pick, cost = [], []
        for before in range(4):
            ways = [(prices[4 * before + after] + (rest[after] if number else 0), places[4 * before + after], after) for after in range(4)]
            price, _, after = min(ways)
            pick.append(after)
            cost.append(min(price, NEVER))
        picks.append(pick)
        rest = cost
    state, pairs = NONE, []
    for pick in reversed(picks):
        pairs.append(4 * state + pick[state])
        state = pick[state]
    return rest[NONE], pairs


@functools.lru_cache(1 << 16)
def turns_left(turns: str, path: str, before: int) -> list[tuple[int, str | None]]:
    """What a path leaves of a stretch: (place, or -1 for an inserted turn; new role, or null if kept)."""
    out, place, state = [], 0, before
    for edit in path:
        if edit == "K":
            state = (ord(turns[place]) - 97) % 4 + 1
            out.append((place, None))
        elif edit != "D":
            state = DUE[state]
            out.append((-1 if edit == "I" else place, NAMES[state]))
        place += edit != "I"
    return out


def illegal_pairs(turns: str) -> int:
    """Neighbours whose initials are none of su, ua, au."""
    kinds = [(ord(t) - 97) % 4 for t in turns]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:]))


def _solved(stretches: DataFrame) -> DataFrame:
    """``stretches`` with illegal pairs inside, prices, places and paths."""
    ship_code()

    @pandas_udf("struct<illegal: long, prices: array<long>, places: array<int>, paths: array<string>>")
    def solve_all(turns: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = [(illegal_pairs(t), *solve(t, bool(f), bool(e))) for t, f, e in zip(turns, first, last)]
        return pd.DataFrame(rows, columns=["illegal", "prices", "places", "paths"])

    return stretches.withColumn("s", solve_all("turns", "first", "last")).select("*", "s.*").drop("s")


def _chained(stretches: DataFrame) -> DataFrame:
    """(key, cost, across, picks): the cheapest chain of a conversation's stretches, a pair of states each, and the
    illegal pairs across stretches."""
    ship_code()
    ends = F.struct("stretch", F.substring("turns", 1, 1).alias("head"), F.expr("right(turns, 1)").alias("tail"), "prices", "places")
    rows = stretches.groupBy("key").agg(F.array_sort(F.collect_list(ends)).alias("parts"))

    @pandas_udf("struct<cost: long, across: long, picks: array<struct<stretch: long, pair: int>>>")
    def chain_all(parts: pd.Series) -> pd.DataFrame:
        out = []
        for row in parts:
            cost, pairs = chain([(list(p["prices"]), list(p["places"])) for p in row])
            across = sum(illegal_pairs(p["tail"] + q["head"]) for p, q in zip(row, row[1:]))
            out.append((cost, across, [{"stretch": p["stretch"], "pair": k} for p, k in zip(row, pairs)]))
        return pd.DataFrame(out, columns=["cost", "across", "picks"])

    return rows.select("key", chain_all("parts").alias("c")).select("key", "c.*")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation, as two tables.

    The first has one row per conversation of ``turns``: ``conv``, gaps (turn numbers that are missing between
    the least and the greatest, nulls aside), blank, duplicate and truncated (turns by their
    first fault), illegal (neighbours that are not system-user, user-assistant or assistant-user), cost and audit
    (the edits' initials). The second has the turns that are left or inserted: ``conv``, stretch and place (their
    order), ``role``, ``text``; conversations of which nothing is left have none.

    Turns go by number (null first), role and text. A turn is blank without any but the six ASCII blanks, else
    a duplicate if role and text stood before in the conversation, else truncated if the last
    character that is no such blank is none of ``.!?``. Null roles and texts are one space, null conversation ids
    one conversation. Rows repeated in full are duplicates. No rows give two empty tables.
    """
    slim = turns.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    slim = slim.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    slim = slim.withColumn("twin", F.monotonically_increasing_id())  # parts rows that are equal in full
    order = ["key", "turn", "role", "digest", "twin"]
    placed = written(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("twin").withColumn("number", F.monotonically_increasing_id()))

    bare = F.regexp_replace("text", f"{BLANK}+$", "")
    initial = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.length("role") > 0, initial).otherwise(3)
    sight = placed.select("key", "number", "digest", initial.alias("initial"), (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    again = sight.where("not blank").groupBy("key", "digest").agg(F.min("number").alias("earliest"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    seen = sight.join(again, ["key", "digest"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("number") > F.col("earliest"), F.lit(False))
    fault = F.when(F.col("blank") | duplicate, VOID).when(F.col("cut"), CUT).otherwise(SOUND)
    coded = seen.select("key", "number", F.shiftright("number", STRETCH_BITS).alias("stretch"), F.char(97 + F.col("initial") + 4 * fault).alias("code"), "blank", duplicate.alias("duplicate"), (fault == CUT).alias("truncated"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    stretches = coded.groupBy("key", "stretch").agg(F.array_sort(F.collect_list(F.struct("number", "code"))).alias("r"), count("blank"), count("duplicate"), count("truncated"))
    stretches = stretches.select("key", "stretch", F.array_join("r.code", "").alias("turns"), F.col("r.number").alias("numbers"), "blank", "duplicate", "truncated")
    ends = placed.groupBy("key").agg(
        F.first("conv").alias("conv"),
        F.min(F.shiftright("number", STRETCH_BITS)).alias("head"),
        F.max(F.shiftright("number", STRETCH_BITS)).alias("tail"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    ends = written(ends)
    framed = stretches.join(ends.select("key", "head", "tail"), "key")
    solved = written(_solved(framed.select("*", (F.col("stretch") == F.col("head")).alias("first"), (F.col("stretch") == F.col("tail")).alias("last"))))

    chained = written(_chained(solved))
    picks = chained.select("key", F.explode("picks").alias("p")).select("key", "p.stretch", "p.pair")
    taken = solved.join(picks, ["key", "stretch"]).withColumn("path", F.element_at("paths", F.col("pair") + 1))
    audits = taken.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("stretch", "path")))["path"], "").alias("audit"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    report = ends.join(audits, "key").join(chained.select("key", "cost", "across"), "key")
    report = report.select(
        F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("across")).alias("illegal"), "cost", "audit"
    )

    ship_code()

    @pandas_udf("array<struct<place: int, role: string>>")
    def left(codes: pd.Series, paths: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([[{"place": p, "role": r} for p, r in turns_left(c, path, pair // 4)] for c, path, pair in zip(codes, paths, pairs)])

    kept = taken.select("key", "stretch", "numbers", F.posexplode(left("turns", "path", "pair")).alias("place", "o"))
    new = kept.where("o.place < 0").join(ends.select("key", "conv"), "key").select("conv", "stretch", "place", F.col("o.role").alias("role"), F.lit("").alias("text"))
    old = kept.where("o.place >= 0").select("stretch", "place", F.element_at("numbers", F.col("o.place") + 1).alias("number"), F.col("o.role").alias("given"))
    old = old.join(placed.select("number", "conv", "role", "text"), "number").select("conv", "stretch", "place", F.coalesce("given", "role").alias("role"), "text")
    rows = old.unionByName(new)
    return report, rows.select(F.col("conv").alias(conv), "stretch", "place", F.col("role").alias(role), F.col("text").alias(text))


def digests(rows: DataFrame, group: str, order: list[str], line: str) -> DataFrame:
    """(``group``, sha256): lowercase hex of the lines of each group in order, joined by line feeds.

    A group is read by one task as a sorted stream, which holds no more than a batch of it.
    """
    kind = dict(rows.dtypes)[group]
    slim = rows.select(F.col(group).alias("g"), F.col(group).cast("string").alias("s"), *order, F.col(line).alias("line"))
    ship_code()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, state = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for g, s, text in zip(batch["g"], batch["s"].to_pylist(), batch["line"].to_pylist()):
                if state is None or s != now:
                    if state is not None:
                        out.append((value, state.hexdigest()))
                    now, value, state = s, g.as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], batch["g"].type), pa.array([d for _, d in out], pa.string())], ["g", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([value], batch["g"].type), pa.array([state.hexdigest()], pa.string())], ["g", "sha256"])

    hashed = slim.repartition("g").sortWithinPartitions("g", *order).mapInArrow(fold, f"g {kind}, sha256 string")
    return hashed.withColumnRenamed("g", group)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults planted by crc32(``conv:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the
    row, 4 makes it a user's. Nulls, in the key and in role and text, are one space; ids and turn numbers stay as they are."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")), F.lit(20))
    rows = turns.select(F.col(conv).alias(conv), F.col(turn).alias(turn), spaced(role).alias(role), spaced(text).alias(text), kind.alias("_kind")).where("_kind != 0")
    rows = rows.select(
        conv,
        turn,
        F.when(F.col("_kind") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.expr("if(_kind = 3, array(0, 1), array(0))")).alias("_copy"),
    )
    return rows.drop("_copy")
