"""Conversation repair: the grammar against enumeration and a full chart, the query against a plain version row by row."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from ridegauge.llm import turns
from ridegauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def enumerated(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cheapest edits by trying all: at most two insertions in each gap, every edit of every row."""
    insertions = ["", "u", "a", "ua", "au"]
    edits = []
    for initial, fault in rows:
        options = [("D", "", 3)]
        if fault not in (turns.BLANK, turns.DUPLICATE):
            more = int(fault == turns.TRUNCATED)
            options += [("K", initial, more), ("R", "u", 2 + more), ("R", "a", 2 + more)]
        edits.append(options)
    best = None
    for chosen in itertools.product(*edits):
        for gaps in itertools.product(insertions, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(e[1] + g for e, g in zip(chosen, gaps[1:], strict=True))
            if GOOD.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(chosen, gaps[1:], strict=True))
                best = min(best or (99, ""), (sum(e[2] for e in chosen) + 2 * sum(map(len, gaps)), audit))
    return best


def full_chart(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Every span, every cut."""
    n = len(rows)
    chart = {(i, i + 1): turns.ROW_CELLS[r if r in "sua" else "", f] for i, (r, f) in enumerate(rows)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells = [turns.join(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            chart[i, i + length] = tuple(turns._least(c[k] for c in cells) for k in range(16))
    return turns.cheapest(chart[0, n]) if n else turns.cheapest(turns.INSERTIONS)


def cells_of(rows):
    return [turns.ROW_CELLS[r if r in "sua" else "", f] for r, f in rows]


def test_grammar_against_enumeration():
    kinds = list(itertools.product("suax", range(4)))
    cases = [[]] + [[k] for k in kinds] + [list(p) for p in itertools.product(kinds, repeat=2)]
    rng = random.Random(1)
    cases += [[rng.choice(kinds) for _ in range(3)] for _ in range(30)]
    for rows in cases:
        assert turns.cheapest(turns.combine(cells_of(rows))) == enumerated(rows), rows


def test_doubling_spans_against_full_chart():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice("suuaaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14))]
        assert turns.cheapest(turns.combine(cells_of(rows))) == full_chart(rows), rows


def test_join_memo_keeps_its_bound(monkeypatch):
    turns._JOINED.clear()
    monkeypatch.setattr(turns, "JOINS_KEPT", 5)
    test_doubling_spans_against_full_chart()
    assert len(turns._JOINED) <= 5
    turns._JOINED.clear()


def plain(rows: list[tuple], damaged: bool = True) -> dict:
    """conv_id -> what op13 returns, row by row."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        kept[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in kept.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        found = sorted(found, key=key)
        seen, faults = set(), []
        for _, role, text in found:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = turns.BLANK if not solid else turns.DUPLICATE if (role, text) in seen else turns.TRUNCATED if solid[-1] not in ".!?" else turns.SOUND
            seen.add((role, text))
            faults.append(fault)
        numbers = [t for t, _, _ in found if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit = turns.cheapest(turns.combine(cells_of([(r[1][:1] or "x", f) for r, f in zip(found, faults, strict=True)])))
        lines, at, before = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else found[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if before == "u" else "user"
            before = role[:1]
            lines.append(f"{role}:{text}")
        assert GOOD.fullmatch("".join(line[0] for line in lines)) and at == len(found)
        counts = [faults.count(f) for f in (turns.BLANK, turns.DUPLICATE, turns.TRUNCATED)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def strange(rng: random.Random) -> list[tuple]:
    texts = ["Yes.", "No!", "cut off", "Really? \n", "", " \t", None, "é…", "long " * 3000 + "end.", "same.", "same."]
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "agent", "\nx"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            number = rng.choice([turn, turn, turn, turn + 2, 1, None, -3])
            rows.append((conv, number, rng.choice(roles[:3] * 4 + roles), rng.choice(texts)))
    rows += [(70, t, ["user", "assistant"][t % 2], f"line {t % 40}.") for t in range(700)]
    rows += [(71, 5, "user", "again.")] * 300 + [(72, None, "system", None)] * 3
    rows += [(80 + i, i, "user", "alone") for i in range(60)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block", [turns.BLOCK_ROWS, 7])
def test_messy_conversations_against_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK_ROWS", block)
    rows = strange(random.Random(3))
    damaged = turns.damage(spark.createDataFrame(rows, SCHEMA).repartition(5))
    summary = turns.summarize(damaged)
    shas = {r["conv_id"]: r["repaired_sha256"] for r in turns.digests(turns.repaired(damaged, summary)).collect()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], shas[r["conv_id"]]) for r in summary.collect()}
    want = plain(rows)
    assert got == want
    assert any(not w[6] for w in want.values()) and any(w[4] for w in want.values())


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 4, "assistant", "More."), (2, 0, "assistant", "First."), (3, 0, "user", "")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", edit string, position int")
    summary, repaired = turns.repair(docs)
    found = defaultdict(list)
    for r in repaired.collect():
        found[r["conv_id"]].append((r["position"], r["edit"], r["role"], r["text"]))
    assert sorted(found[1]) == [(0, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (2, "K", "assistant", "Hello."), (3, "I", "user", ""), (4, "K", "assistant", "More.")]
    assert sorted(found[2]) == [(0, "I", "user", ""), (1, "K", "assistant", "First.")] and found[3] == [(None, None, None, None)]
    assert {r["conv_id"]: (r["cost"], r["audit"], r["gaps"]) for r in summary.collect()} == {1: (2, "KKKIK", 1), 2: (2, "IK", 0), 3: (3, "D", 0)}


def test_query(spark):
    query = QUERIES["op13_conversation_repair"](spark, SF)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert query.columns == ["conv_id", *columns]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = query.collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in got} == plain(rows)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    summary, repaired = turns.repair(nothing)
    assert summary.count() == 0 and turns.digests(repaired).count() == 0
