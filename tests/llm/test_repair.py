"""Conversation repair against a plain recurrence over all prefixes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from facetspark.llm import repair
from facetspark.llm.repair_query import damaged


def plain_repair(initials, faults):
    """Cheapest (cost, audit) by keeping the best label of each end after every row."""

    def filled(labels):
        for _ in range(2):
            for last, (cost, audit) in list(labels.items()):
                to = "a" if last == "u" else "u"
                labels[to] = min(labels.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return labels

    labels = filled({"": (0, "")})
    for initial, fault in zip(initials, faults):
        new = {}
        for last, (cost, audit) in labels.items():
            found = [(last, cost + 2, "D")]
            if fault not in ("blank", "duplicate"):
                stay = cost + 5 * (fault == "truncated")
                due = "a" if last == "u" else "u"
                found.append((due, stay + (initial != due), "K" if initial == due else "R"))
                if initial == "s" and last == "":
                    found.append(("s", stay, "K"))
            for to, price, edit in found:
                new[to] = min(new.get(to, (10**9, "")), (price, audit + edit))
        labels = filled(new)
    return min(labels[last] for last in ("", "a") if last in labels)


def test_search_agrees_with_the_plain_recurrence():
    draw = random.Random(7)
    for _ in range(3000):
        n = draw.randint(0, 12)
        initials = [draw.choice("suax ") for _ in range(n)]
        faults = [draw.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        assert repair.cheapest_repair(initials, faults) == plain_repair(initials, faults)


@pytest.mark.parametrize("roles", ["s", "u", "sua", "us"])
def test_long_conversations_are_searched_in_bounded_time(roles):
    draw = random.Random(5)
    initials = [draw.choice(roles) for _ in range(8000)]
    faults = [draw.choice(["", "", "blank", "truncated"]) for _ in initials]
    assert repair.cheapest_repair(initials, faults) == plain_repair(initials, faults)


def plain_row(conv_id, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    rows = [(t, r or "", x or "") for t, r, x in rows]
    faults = []
    for k, (_, role, text) in enumerate(rows):
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif any((role, text) == r[1:] for r in rows[:k]):
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = plain_repair([r[1][:1] for r in rows], faults)
    return (
        conv_id, len(rows), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
    )


def test_odd_conversations(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "hello"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 5, "user", "End?"),
        (2, None, "user", None), (2, None, None, "What?"), (2, 3, "", "x."), (None, 1, "user", "A."), (None, 2, "assistant", "B!"),
        (3, 0, "assistant", "Only."), (4, 7, "user", " \n\t"), (5, 0, "user", "é?"), (5, 1, "tool", "w" * 300_000 + "."), (5, 1, "assistant", "fine. \n"),
        (6, 0, "system", "S."), (7, 1, "user", "A."), (7, 1, "user", "B."), (7, 1, "assistant", "A."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("cost", "audit", "roles", "k")})
    out = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
    assert set(out) == {r[0] for r in rows}
    for conv_id, got in out.items():
        assert tuple(got)[:9] == plain_row(conv_id, [r[1:] for r in rows if r[0] == conv_id])
        initials = "".join(r[:1] for r in got.roles)
        assert initials == "" or set(initials.removeprefix("s").replace("ua", "")) == set() and initials != "s"
    assert list(zip(out[1].roles, out[1].texts))[0] == ("system", "Be kind.")
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_conversations_without_rows_stay(spark):
    df = spark.createDataFrame([(9, 0, "user", "a.", True), (9, 1, "user", "b.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    (got,) = repair.repair_conversations(df).collect()
    assert tuple(got) == (9, 0, 0, 0, 0, 0, 0, 0, "", [], [])


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, None if t % 7 == 0 else "assistant", None if t % 5 == 0 else "A. b! c?") for c in (1, 2, None) for t in [*range(40), None] if t is not None]
    rows += [(3, None, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        want += [(c, t, "user" if h == 4 else role, text, h == 0)] * (2 if h == 3 else 1)
    got = [tuple(r)[:5] for r in damaged(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
