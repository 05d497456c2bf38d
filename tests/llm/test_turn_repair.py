"""Conversation repair against a search over all edits, and cases that tables may hold."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest

from plumbline.llm.turn_repair import ENDED, START, Segment, damaged, repair_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies bigint, cost double, part int, key string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """All of one conversation's figures, from its rows (turn, role, text) in order: every edit of every row, inserts too."""
    seen, faults, edits = set(), [], []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(kind)
        more = 5 * (kind == "truncated")
        own = [("D", 2, "", None)]
        if kind not in ("blank", "duplicate"):
            own += [("K", more, role[:1] or "?", f"{role}:{text}"), ("R", 1 + more, "u", f"user:{text}"), ("R", 1 + more, "a", f"assistant:{text}")]
        edits.append(own)
    best = None
    for chosen in itertools.product(*edits):
        base = sum(e[1] for e in chosen)
        if best and base > best[0]:
            continue
        # inserts before each edit and at the end: none, one or two of either role
        states = {("", ""): (0, [])}
        for e in [*chosen, None]:
            grown = {}
            for (letters, roles), (cost, lines) in states.items():
                for extra in ("", "u", "a", "ua", "au"):
                    r = roles + extra + (e[2] if e else "")
                    if not re.match(r"(s?(ua)*u?)\Z", r) and r:
                        continue
                    key = (letters + "I" * len(extra) + (e[0] if e else ""), r)
                    made = cost + 5 * len(extra), lines + [f"{'user' if x == 'u' else 'assistant'}:" for x in extra] + ([e[3]] if e and e[3] is not None else [])
                    if key not in grown or made[0] < grown[key][0]:
                        grown[key] = made
            states = grown
        for (letters, roles), (cost, lines) in states.items():
            if GOOD.match(roles) and (best is None or (base + cost, letters) < best[:2]):
                best = (base + cost, letters, lines)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    )


def plain_damage(rows):
    """Rows by conversation after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        fault, (role, text) = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, (space(role), space(text))
        out[conv] += []
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


ROWS = [
    *((1, t, r, x) for t, (r, x) in enumerate([("system", "Be good."), ("user", "Hi."), ("user", "Again."), ("assistant", "So?"), ("assistant", "cut")])),
    *((2, t, r, "Same.") for t, r in enumerate(["user", "user", "assistant", "user", "assistant"])),
    (3, None, "user", "No turn."), (3, None, "assistant", "None!"), (3, 4, "user", None), (3, 9, None, "No role."),
    (4, None, None, None),
    (5, 0, "tool", "Odd one."), (5, 1, "", "No role at all."), (5, 2, "userish", "Odd!"), (5, 3, "assistant", "Yes.\x0b\n"),
    (6, 3, "assistant", "b."), (6, 3, "assistant", "a."), (6, 3, "assistant", "a."), (6, 5, "user", "z…"), (6, 7, "system", "."),
    (None, 0, "user", "Whose?"), (None, 1, "assistant", "Nobody's."),
    *((7, t, ("user", "assistant")[t % 2], "word " * (5 + t) + ".") for t in range(6)),
    (8, 0, "system", "Only this."), (9, 0, "user", " \t\r\n"), (10, 5, "assistant", "unfinished"), (10, 2, "user", "Well?"),
    (11, 0, "user", "é" * 100), (11, 1, "assistant", "é" * 64 + "b."), (11, 1, "assistant", "é" * 64 + "a."),
]
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def asked(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize(("rows", "parts"), [(4096, "1"), (4096, "3"), (1, "2"), (2, "5")])
def test_against_all_edits(spark, rows, parts):
    table = spark.createDataFrame([(*r, 7, 0.5, 3, "k") for r in ROWS], SCHEMA)
    want = {c: brute(r) for c, r in plain_damage(ROWS).items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert asked(repair_turns(damaged(table), rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_undamaged_turns(spark):
    """Without damage, whichever letters the key would have given."""
    turns = spark.createDataFrame([(*r, 1, 0.5, 3, "k") for r in ROWS], SCHEMA)
    rows = defaultdict(list)
    for c, t, r, x in ROWS:
        rows[c].append((t, " " if r is None else r, " " if x is None else x))
    want = {c: brute(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, r in rows.items()}
    assert asked(repair_turns(turns)) == want
    assert asked(repair_turns(turns, rows=2)) == want


def test_empty_and_dropped(spark):
    assert repair_turns(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert asked(repair_turns(damaged(table))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_very_long_conversation(spark):
    """Twenty thousand turns in segments of 512 rows are the same as in one piece, and a copy said 5,000 times is deleted."""
    n = 20_000
    turns = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "if(id % 4 = 1, 'Said before.', concat('Turn ', id, if(id % 7 = 0, '', '.'))) as text", "1L as copies")
    got = asked(repair_turns(turns, rows=512))
    runs, said = [], set()
    for i in range(n):
        role, text = "user" if i % 3 == 0 else "assistant", "Said before." if i % 4 == 1 else f"Turn {i}" + ("" if i % 7 == 0 else ".")
        good = (role, text) not in said
        said.add((role, text))
        runs.append((role[:1], role, text, 1, good, not text.endswith(".")))
    one = Segment(runs)
    audit, lines, _ = one.walk(START, ENDED, True)
    assert got[7][-2:] == (audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert got[7][5] == one._gap(START, one.minima(ENDED)[0])
    assert got[7][2] == sum(not r[4] for r in runs)


def test_same_as_sql(spark, tmp_path):
    import oracle
    from plumbline.llm.queries import LLM_ORACLES, LLM_QUERIES

    spark.createDataFrame([(*r, 7, 0.5, 3, "k") for r in ROWS], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/c")
    next((tmp_path / "c").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    name = "op13_turn_repair"
    assert oracle.compare(spark, str(tmp_path), LLM_QUERIES[name], LLM_ORACLES[name]) == []
