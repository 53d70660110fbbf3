"""Conversation repair against all repairs of small conversations, and against dynamic programming of longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sluice.llm import conversations as cv

OK = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """Rows after damage, in order, from rows (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def damage(rows):
    """{conv_id: rows (turn, role, text) in order} after the damage."""
    out: dict = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        mine += [(turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(rows, key=key) for c, rows in out.items()}


def programmed(kinds):
    """Least (cost, audit) by dynamic programming over rows and last roles."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def closed(best):
        for _ in range(4):
            for q, (c, p) in list(best.items()):
                for r in "ua":
                    if (q, r) in step and (c + 2, p + "I") < best.get(r, (9**9, "")):
                        best[r] = (c + 2, p + "I")
        return best

    best = closed({"": (0, "")})
    for initial, wrong in kinds:
        new: dict = {}
        for q, (c, p) in best.items():
            ways = [("D", 3, q)]
            if wrong not in "bd":
                more = wrong == "t"
                ways += [("K", more, step[q, initial])] if (q, initial) in step else []
                ways += [("R", 2 + more, step[q, r]) for r in "ua" if (q, r) in step]
            for letter, cost, to in ways:
                new[to] = min(new.get(to, (9**9, "")), (c + cost, p + letter))
        best = closed(new)
    return min(best[q] for q in ("", "a") if q in best)


def enumerated(kinds):
    """Least (cost, audit) over all edits with at most two inserts in each gap."""
    found = []
    for edits in itertools.product("DKR", repeat=len(kinds)):
        if any(w in "bd" and e != "D" for (_, w), e in zip(kinds, edits, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            slots, audit, cost = ["ua"] * gaps[0], "I" * gaps[0], 2 * gaps[0]
            for (initial, wrong), e, n in zip(kinds, edits, gaps[1:], strict=True):
                slots += ([] if e == "D" else [initial or "-"] if e == "K" else ["ua"]) + ["ua"] * n
                audit += e + "I" * n
                cost += {"D": 3, "K": 0, "R": 2}[e] + (wrong == "t" and e != "D") + 2 * n
            if any(OK.fullmatch("".join(x)) for x in itertools.product(*slots)):
                found.append((cost, audit))
    return min(found)


def kinds_at_random(rng, n):
    return [(rng.choice(["u", "a", "u", "a", "s", " ", "t", ""]), rng.choice("----tbd")) for _ in range(n)]


def test_search_against_all_repairs():
    rng = random.Random(3)
    for _ in range(120):
        kinds = kinds_at_random(rng, rng.randrange(5))
        assert cv.search(kinds) == enumerated(kinds) == programmed(kinds), kinds


def test_search_of_longer_conversations_and_with_loose_bounds():
    rng = random.Random(4)
    for n in [*range(9), 30, 300, 2000]:
        kinds = kinds_at_random(rng, n)
        assert cv.search(kinds) == programmed(kinds)
        if n < 9:  # without bounds the tables and the incumbent prove the same
            assert cv.search(kinds, bounds=[[0] * 4] * (n + 1)) == programmed(kinds)


def test_joined_segments():
    rng = random.Random(5)
    for _ in range(60):
        kinds = kinds_at_random(rng, rng.randrange(1, 40))
        size = rng.randrange(1, 9)
        parts = []
        for k in range(0, len(kinds), size):
            found = [(a, b, cv.search(kinds[k : k + size], a, (b,))) for a in range(4) for b in range(4)]
            parts.append([{"start": a, "end": b, "cost": w[0], "audit": w[1]} for a, b, w in found if w])
        assert cv.joined(parts)[:2] == programmed(kinds)


def wanted(rows):
    for conv, kept in damage(rows).items():
        wrong, initials = faulty(kept), [r[1][:1] for r in kept]
        cost, audit = programmed(list(zip(initials, wrong, strict=True)))
        out, left = [], iter(kept)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((role, text))
        assert OK.fullmatch("".join(r[:1] for r, _ in out))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, gaps, *(wrong.count(w) for w in "bdt"), bad, cost, audit, digest


def odd_rows():
    rng = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Hello.", "Yes!", "Why?", "cut off", None, "", " \n", "é 😀.", "x " * 500 + ".", "same.", "same."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(12))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    rows += [(101, None, "user", "no turn."), (101, None, "assistant", "no turn."), (101, None, "user", "no turn."), (101, 5, "user", "x."), (None, 1, "user", "no name."), (None, None, None, None)]
    rows += [(102, 3, "user", "all the same.")] * 50 + [(103, t, "user", "again.") for t in range(60)] + [(104, None, None, None)]
    return rows


@pytest.mark.parametrize("segment", [cv.SEGMENT, 5, 1])
def test_report_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = odd_rows()
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("clash") for n in ("n", "gone", "place", "c", "part", "copy")})
    got = [tuple(r) for r in cv.report(df).collect()]
    assert sorted(got, key=str) == sorted(wanted(rows), key=str)


def test_bytes_split_too(spark, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT_BYTES", 400)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, cv.report(df).collect()), key=str) == sorted(wanted(rows), key=str)


def test_given_and_empty_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = [tuple(r) for r in cv.report(df).collect()]
    assert sorted(got, key=str) == sorted(wanted([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]), key=str)
    assert cv.report(df.limit(0)).isEmpty()
