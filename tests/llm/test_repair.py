"""Repairs by layers of cost against a plain search over whole strings of edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pixloom.llm import queries, repair

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """(cost, audit, repaired): from the end, the least (cost, letters) of each place and state; inserts are relaxed until nothing changes."""
    lead = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    choice = [2, 2, 3, 2]
    best = [[None] * 4 for _ in range(len(turns) + 1)]
    for i in range(len(turns), -1, -1):
        for q in range(4):
            options = [(0, "")] if i == len(turns) and q in (0, 3) else []
            if i < len(turns):
                c, letters = best[i + 1][q]
                options.append((c + 4, "D" + letters))
                if found[i] in ("", "truncated"):
                    more = 3 * (found[i] == "truncated")
                    if to := lead.get((q, turns[i][0][:1])):
                        c, letters = best[i + 1][to]
                        options.append((c + more, "K" + letters))
                    c, letters = best[i + 1][choice[q]]
                    options.append((c + 3 + more, "R" + letters))
            best[i][q] = min(options, default=(10**9, ""))
        for _ in range(5):
            for q in range(4):
                c, letters = best[i][choice[q]]
                best[i][q] = min(best[i][q], (c + 3, "I" + letters))
    cost, audit = best[0][0]
    out, at, q = [], 0, 0
    for x in audit:
        role, text = turns[at] if x != "I" else ("", "")
        at += x != "I"
        if x == "D":
            continue
        q = lead[q, role[:1]] if x == "K" else choice[q]
        out.append((role if x == "K" else ["", "", "user", "assistant"][q], text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return cost, audit, out


def by_hand(rows):
    """Each conversation's row. Rows are (conv, turn, role, text) after damage."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).digest(), text))
    out = {}
    for conv, group in groups.items():
        group.sort()
        turns = [(g[2], g[4]) for g in group]
        known = [g[1] for g in group if g[0]]
        found = faults(turns)
        cost, audit, left = cheapest(turns, found)
        pairs = ["".join(p) for p in itertools.pairwise([r[:1] for r, _ in turns])]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        )
    return out


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def made_up(n, long):
    rng, rows = random.Random(n), []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 14, 30]) if not long or conv else long):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "cut", "", " \t", "Really?  ", None, f"unlike {turn}.", f"open {turn}"])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("limits", [(4096, 1 << 20, 12), (3, 1 << 20, 2), (4096, 30, 5)])
def test_against_a_plain_search(spark, monkeypatch, limits):
    monkeypatch.setattr(repair, "CHUNK_TURNS", limits[0])
    monkeypatch.setattr(repair, "CHUNK_CHARS", limits[1])
    monkeypatch.setattr(repair, "SEGMENT", limits[2])
    rows = made_up(150, 400)
    frame = spark.createDataFrame([(None, 1, "user", "Alone."), *rows], "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("x")).withColumn("part", F.lit(1))
    want = by_hand([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in [(None, 1, "user", "Alone."), *rows]])
    fixed = repair.repair_conversations(frame.repartition(5))
    got = {r[0]: tuple(r)[1:] for r in fixed.conversations.collect()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    lines = collections.defaultdict(list)
    for r in sorted(fixed.turns.collect(), key=lambda r: tuple(r.position)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]


def test_layers_and_costs_of_every_short_conversation():
    codes = [bytes(c) for n in range(4) for c in itertools.product([r * 4 + f for r in range(4) for f in (0, 1, 3)], repeat=n)]
    names = {0: "", 1: "blank", 3: "truncated"}
    for code, (cost, edits) in zip(codes, repair.solve(codes), strict=True):
        turns = [("suax"[c >> 2], "") for c in code]
        assert (cost, "".join(edits)) == cheapest(turns, [names[c & 3] for c in code])[:2]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = dict.fromkeys({r[0] for r in rows}, EMPTY) | by_hand(damaged_by_hand(rows))
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair_conversations(spark, DATA).collect()}
    assert got == want and sum(bool(v[5]) for v in want.values()) > 10


def test_damage_and_conversations_without_turns(spark):
    rows = made_up(60, 0) + [(None, None, None, None), (10**6, None, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, map(tuple, queries.damaged(frame).collect()))) == sorted(map(repr, damaged_by_hand(rows)))
    some = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    got = repair.repair_conversations(frame.where("conv_id < 0"), some).conversations.collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, *EMPTY), (None, *EMPTY)]))
    assert repair.repair_conversations(frame.where("conv_id < 0")).conversations.collect() == []
