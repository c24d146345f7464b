"""Repair of conversations against exhaustive search."""

import collections
import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from flighttone.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, place long, block int, audit string"
GOAL = re.compile("(s?(ua)+)?")
FULL = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "a") for r in rows], SCHEMA)


def said(x):
    return " " if x is None else str(x)


def brute_damage(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def best(rows):
    """Least cost and letters for ``(initial, kind)`` rows by all edits, kinds as in ``turns``."""
    full = {"": 0, "s": 1, "u": 2, "a": 3}
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def least(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in (0, 3) else []
        steps = []
        if i < len(rows):
            initial, kind = rows[i]
            steps.append(("D", 4, i + 1, state, 0))
            if kind < 2:
                if (state, initial) in legal:
                    steps.append(("K", 3 * kind, i + 1, legal[state, initial], 0))
                steps += [("R", 3 + 3 * kind, i + 1, legal[state, r], 0) for r in "ua" if (state, r) in legal]
        if inserted < 4:
            steps += [("I", 3, i, legal[state, r], inserted + 1) for r in "ua" if (state, r) in legal]
        for letter, cost, *to in steps:
            found = least(*to)
            if found:
                options.append((cost + found[0], letter + found[1]))
        return min(options, default=None)

    assert full and GOAL
    return least(0, 0, 0)


def brute(rows):
    convs = collections.defaultdict(list)
    for r in brute_damage(rows):
        convs[r[0]].append(r[1:])
    for conv in dict.fromkeys(r[0] for r in rows):
        held = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, kinds = set(), []
        for _, role, text in held:
            full = FULL.findall(text)
            kinds.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "fine")
            seen.add((role, text))
        codes = tuple((r[1][:1], {"fine": 0, "truncated": 1}.get(k, 2)) for r, k in zip(held, kinds))
        known = [r[0] for r in held if r[0] is not None]
        cost, audit = best(codes)
        out, left, state = [], iter(held), ""
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            out.append(f"{role}:{row[2] if row else ''}")
        assert GOAL.fullmatch("".join(o[0] for o in out))
        yield (
            conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held)),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "sys", "ant", None, ""])
            text = rng.choice(["Hello.", "Yes!", "cut of", " \t\n", "", None, "So?  ", "a.b\x85", "é。", "x" * 3000 + "."])
            out.append((conv, None if rng.random() < 0.05 and turn == 0 else turn * int(rng.choice([1, 1, 2])), role and str(role), text and str(text)))
    seen, rows = set(), []
    for r in out:
        if r[:2] not in seen:
            rows.append(r)
        seen.add(r[:2])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (900, None, None, None), (901, -5, "user", "a."), (901, 10**12, "assistant", "b.")]
    # Repeated rows are duplicates of each other, whatever their order.
    rows += [(902, 3, "user", "Same.")] * 7 + [(903, t, "user" if t % 2 else "assistant", f"t{t}" + "." * (t % 3)) for t in range(300)]
    return rows


@pytest.mark.parametrize("least", [turns.BLOCK_ROWS, 2])
def test_turns(spark, rows, monkeypatch, least):
    """Also with conversations cut into blocks."""
    monkeypatch.setattr(turns, "BLOCK_ROWS", least)
    held = table(spark, rows).repartition(4, "text")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, map(tuple, turns.digests(held).select(columns).collect()))) == sorted(map(str, brute(rows)))


def test_repaired_rows(spark, rows):
    found = collections.defaultdict(list)
    for r in sorted(turns.repair(table(spark, rows)).collect(), key=lambda r: r.place):
        found[r.conv_id].append(r)
    for conv, *_, sha in brute(rows):
        assert [r.place for r in found[conv]] == list(range(len(found[conv])))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found[conv]).encode()).hexdigest() == sha


def test_every_short_conversation():
    """All rows of up to four, whole and cut into blocks of every length."""
    kinds = [(i, k) for i in "sua?" for k in range(3)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            codes = bytes(turns._code(*r) for r in rows)
            cost, audit = best(tuple((i if i != "?" else "", k) for i, k in rows))
            paid, vectors = turns._vectors(codes, turns.END)
            assert (paid + vectors[0][0], turns.walk(codes, 0, turns.END, True)[0]) == (cost, audit)
            if n == 3:
                parts = [codes[:1], codes[1:]]
                total, after = turns.checkpoints([turns.crossing(c) for c in parts])
                state, letters = 0, ""
                for i, (part, vector) in enumerate(zip(parts, after)):
                    more, state = turns.walk(part, state, vector, i == 1)
                    letters += more
                assert (total, letters) == (cost, audit)


def test_turns_of_nothing(spark):
    assert turns.digests(table(spark, [])).count() == 0
    assert turns.repair(table(spark, [])).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = turns.digests(table(spark, [(7, gone, "user", "a.")])).first()
    assert row[:8] == (7, 0, 0, 0, 0, 0, 0, "") and row[8] == hashlib.sha256(b"").hexdigest()
