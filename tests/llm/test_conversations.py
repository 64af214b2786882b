"""Repair of conversations against an exhaustive search."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pytest

from orbweave.llm import conversations, queries

from . import samples

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, kind string, digest string"


def blank(text):
    return text.strip(" \t\n\x0b\x0c\r")


def plain(rows):
    """The report of one conversation's rows (turn, role, text), by trying lattice paths one by one."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, marks = set(), []
    for _, role, text in rows:
        bare = blank(text)
        marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": {0: (0, "", ())}}  # by state: cost, edits, turns

    def insert(ways):
        for _ in range(3):
            for state, (cost, audit, turns) in list(ways.items()):
                to = 3 if state == 2 else 2
                way = (cost + 3, audit + "I", (*turns, ("assistant" if to == 3 else "user", "")))
                ways[to] = min(ways.get(to, way), way)
        return ways

    ways = insert(best[""])
    for (_, role, text), mark in zip(rows, marks):
        after = {}

        def offer(state, way):
            after[state] = min(after.get(state, way), way)

        for state, (cost, audit, turns) in ways.items():
            offer(state, (cost + 4, audit + "D", turns))
            if mark in ("blank", "duplicate"):
                continue
            more = 3 if mark == "truncated" else 0
            to = {"u": 2, "a": 3, "s": 1}.get(role[:1])
            if to and (to, state) in {(1, 0), (2, 0), (2, 1), (2, 3), (3, 2)}:
                offer(to, (cost + more, audit + "K", (*turns, (role, text))))
            to = 3 if state == 2 else 2
            offer(to, (cost + 3 + more, audit + "R", (*turns, ("assistant" if to == 3 else "user", text))))
        ways = insert(after)
    cost, audit, turns = min(ways[s] for s in (0, 3) if s in ways)
    known = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [max(known) - min(known) + 1 - len(known) if known else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs)]
    return (*counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def damage(rows):
    out = defaultdict(list)
    space = lambda v: " " if v is None else v
    for r in rows:
        out[r["conv_id"]]
        h = zlib.crc32(f"{space(r['conv_id'])}:{space(r['turn'])}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in space(r["text"]) if c not in ".!?") if h == 2 else space(r["text"])
        out[r["conv_id"]] += [] if h == 0 else [(r["turn"], "user" if h == 4 else space(r["role"]), text)] * (2 if h == 3 else 1)
    return out


def report(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def edge(spark):
    draw, rows = random.Random(5), []
    texts = ["Yes.", "No!", "Why?", "cut of", " \t", "", None, "Yes. \n", "a" * 50_000 + ".", "日本語."]
    for conv in [*range(60), None]:
        for turn in range(draw.randrange(9)):
            row = (conv, draw.choice([turn, turn, turn, turn + 1, None]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(texts), "c", "a", "k", "d")
            rows += [row] * draw.choice([1, 1, 1, 2])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def long(spark):
    """A conversation that holds most rows, with one very common text, beside short ones."""
    draw = random.Random(6)
    rows = [(1, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["Yes.", f"Turn {t}.", f"Turn {t}.", f"cut {t}"]), "", "", "", "") for t in range(1500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Hello {t}.", "", "", "", "") for c in range(2, 40) for t in range(4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("make", [edge, long, lambda spark: spark.createDataFrame([], SCHEMA), lambda spark: spark.read.parquet(f"{samples.SF}/conversations.parquet")])
@pytest.mark.parametrize("stretch", [1024, 3])
def test_report(spark, make, stretch):
    rows = make(spark)
    hurt = conversations.damaged(rows).withColumnRenamed("conv", "conv_id")
    got = report(conversations.repair_report(hurt, ids=rows.selectExpr("conv_id as conv"), stretch=stretch))
    want = {conv: plain(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, own in damage(rows.collect()).items()}
    assert got == want


def test_query_is_the_report(spark):
    rows = spark.read.parquet(f"{samples.SF}/conversations.parquet").collect()
    got = report(queries.QUERIES["op13_conversations"](spark, samples.SF))
    assert got == {conv: plain(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, own in damage(rows).items()}


def test_turns_are_those_of_the_digest(spark):
    rows = edge(spark)
    turns = defaultdict(list)
    for r in conversations.repaired_turns(rows, stretch=2).collect():
        turns[r["conv_id"]].append((r["at"], r["role"], r["text"], r["edit"]))
    for r in conversations.repair_report(rows).collect():
        own = sorted(turns[r["conv_id"]])
        assert [t[0] for t in own] == list(range(len(own))) and "".join(t[3] for t in own) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t[1]}:{t[2]}" for t in own).encode()).hexdigest() == r["repaired_sha256"]


def test_search_against_all_edits():
    """Every string of edits with at most two turns put in between rows."""
    draw = random.Random(8)
    between = ["", "I", "II"]
    for n in (0, 1, 2, 3):
        for _ in range(30):
            rows = [(draw.choice(["u", "a", "s", "t", ""]), draw.choice([0, 0, 1, 2, 3])) for _ in range(n)]
            found = []
            for edits in product("KRD", repeat=n):
                for puts in product(between, repeat=n + 1):
                    audit = puts[0] + "".join(e + p for e, p in zip(edits, puts[1:]))
                    state, cost, at, ok = 0, 0, 0, True
                    for e in audit:
                        initial, fault = rows[at] if e != "I" else ("", 0)
                        at += e != "I"
                        cost += conversations.COST[e] + (3 if fault == 3 and e != "D" else 0)
                        if e == "D":
                            continue
                        ok = ok and fault not in (1, 2)
                        step = initial if e == "K" else "a" if state == 2 else "u"
                        ok = ok and step in conversations.STEPS[state]
                        state = conversations.STEPS[state].get(step, 0)
                    if ok and state in (0, 3):
                        found.append((cost, audit))
            (got,) = conversations.cheapest_edits(rows).values()
            assert got == min(found)
            joined = conversations.Joined()
            for k, row in enumerate(rows):
                ways = {(entry, after): way for entry in range(4) for after, way in conversations.cheapest_edits([row], entry, False).items()}
                joined.add(ways, 0, row[0], row[0])
            assert not rows or joined.best() == min(found)
