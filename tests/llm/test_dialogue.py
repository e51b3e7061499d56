import hashlib
import random
import zlib
from functools import cache

import numpy as np

from spandrel.llm import dialogue

from . import cases

ROLES = ("system", "user", "assistant", "tool", "user", "assistant")
FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(codes):
    """Cost and least audit by plain recursion over suffixes."""

    @cache
    def best(i, state, room):
        ways = []
        if i == len(codes) and state in ("", "a"):
            ways.append((0, ""))
        if room:
            ways.append((2, "I", best(i, FOLLOW[state], room - 1)))
        if i < len(codes):
            kind, late = codes[i].lower(), codes[i].isupper()
            ways.append((3, "D", best(i + 1, state, 3)))
            if kind not in "bd":
                ways.append((2 + late, "R", best(i + 1, FOLLOW[state], 3)))
                if (kind == "s" and state == "") or kind == FOLLOW[state]:
                    ways.append((late, "K", best(i + 1, kind, 3)))
        done = [w if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1]) for w in ways if len(w) == 2 or w[2]]
        return min(done, default=None)

    for i in range(len(codes), 0, -1):  # so that recursion stays flat
        for state in ("", "s", "u", "a"):
            best(i, state, 3)
    return best(0, "", 3)


def brute(rows, every=()):
    talks = {c: [] for c in every}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest(), turn, role, text))
    out = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda t: t[:4])
        seen, codes = set(), ""
        for *_, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            head = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "b" if not bare else "d" if (role, text) in seen else head if bare[-1] in ".!?" else head.upper()
            seen.add((role, text))
        cost, audit = cheapest(codes)
        lines, state, at = [], "", 0
        for edit in audit:
            role, text = turns[at][5:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit in "RI":
                role = {"u": "user", "a": "assistant"}[FOLLOW[state]]
            state = role[0]
            lines.append(f"{role}:{text}")
        known = [t[4] for t in turns if t[4] is not None]
        pairs = [a[5][:1] + b[5][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, codes.count("b"), codes.count("d"), sum(c in "SUAX" for c in codes), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        for _ in range((fault != 0) + (fault == 3)):
            yield conv, turn, "user" if fault == 4 else role, text


def talks(n, seed, longest=12):
    rnd = random.Random(seed)
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            text = rnd.choice(("Yes.", "No!", "so", "what? ", "Fine.", "", " \t", "a\nb.", "über.", f"text {rnd.random()}.", None))
            yield conv, rnd.choice((turn, turn, turn, turn + 1, None)), rnd.choice((*ROLES, None, "")) if rnd.random() < 0.4 else ROLES[1 + turn % 2], text


SHAPE = "conv_id long, turn long, role string, text string"


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = list(talks(150, 1)) + [(None, None, "user", "Hi."), (None, 3, None, None), (None, None, "assistant", "Hi."), (None, None, "assistant", "Hi.")] + [(900, t, "system", "one.") for t in range(4)]
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    assert got(dialogue.report(df)) == brute(rows)
    after = list(damaged(rows))
    assert got(dialogue.report(dialogue.damage(df), df)) == brute(after, {r[0] for r in rows})


def test_long_conversations_are_cut(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (_, _, r, x) in enumerate(x for s in range(60) for x in talks(1, 50 + 100 * c + s))]
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    have = got(dialogue.report(df))
    want = {c: v for c, v in brute(rows).items()}
    assert min(len(v[6]) for v in want.values()) > 3 * dialogue.SEGMENT
    assert have == want


def test_repaired_turns(spark):
    rows = list(talks(40, 3))
    df = spark.createDataFrame(rows, SHAPE)
    by = {}
    for r in sorted(dialogue.repair(df).collect(), key=lambda r: (r.conv_id, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, want in brute(rows).items():
        turns = by.get(conv, [])
        assert [r.place for r in turns] == list(range(len(turns)))
        assert "".join(r.edit for r in turns) == want[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == want[7]
        heads = "".join(r.role[0] for r in turns)
        assert not heads or heads.removeprefix("s") == "ua" * (len(heads) // 2)


def test_layers_of_random_codes():
    rnd = random.Random(5)
    for length in range(1, 9):
        codes = ["".join(rnd.choice("suaxSUAXbduaua") for _ in range(length)) for _ in range(60)]
        part = np.frombuffer("".join(codes).encode(), np.uint8).reshape(60, length)
        sets = dialogue.cost_layers(part, np.array([dialogue._SHUT] * 60), 1)
        for k, code in enumerate(codes):
            letters, end = dialogue.traced(np.ascontiguousarray(sets[:, :, k]).tobytes(), length, code, 0)
            first = next(c for c in range(len(sets)) if sets[c, 0, k] & 1)
            assert (first, letters + dialogue.TAIL[end]) == cheapest(code)


def test_awkward_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    assert dialogue.report(none).count() == dialogue.repair(none).count() == 0
    nothing = got(dialogue.report(none, spark.createDataFrame([(4, 1, "user", "x")], SHAPE)))
    assert nothing == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    # repeated rows, extra columns, a text of 300 kB, keys that are texts
    rows = [("k", 1, "user", "word " * 60_000 + ".", "x", 1)] * 3 + [("k", 2, "assistant", "Yes.", None, None), ("", None, None, None, "y", 2)]
    df = spark.createDataFrame(rows, "conv string, n int, role string, text string, g string, pos int")
    have = got(dialogue.report(df, conv="conv", turn="n"))
    assert have == brute([r[:4] for r in rows]) and have["k"][6] == "KDDK"
    assert cases.docs(spark).count() > 0
