"""Conversation repair against exhaustive search and plain dynamic programming."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from regstat.llm import convrepair as cr
from regstat.llm.common import table
from tests.conftest import SF_SMALL

SHAPE = re.compile(r"(s?(ua)+)?")
FAULTS = (None, "blank", "duplicate", "truncated")


def after(state, letter, initial):
    """The role initials grow one by one; the state is their last one."""
    if letter == "K":
        return initial
    return "a" if state == "u" else "u"


def allowed(state, new):
    return (state or "0") + new in ("0s", "0u", "su", "ua", "au")


def cost_of(letter, fault):
    return {"K": 0, "R": 1, "D": 2, "I": 5}[letter] + (5 if fault == "truncated" and letter in "KR" else 0)


def exhaustive(rows):
    """Every edit string with at most two inserts in a place."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            text, initials, cost, ok = "", "", 0, True
            for i in range(len(rows) + 1):
                for _ in range(inserts[i]):
                    initials += after(initials[-1:], "I", "")
                    cost += 5
                text += "I" * inserts[i]
                if i < len(rows):
                    initial, fault = rows[i]
                    text += letters[i]
                    cost += cost_of(letters[i], fault)
                    if letters[i] != "D":
                        ok = ok and fault not in ("blank", "duplicate")
                        initials += after(initials[-1:], letters[i], initial)
            if ok and SHAPE.fullmatch(initials) and (best is None or (cost, text) < best):
                best = (cost, text)
    return best


def plain(rows):
    """Dynamic programming over (row, last initial) with whole strings."""
    now = {"": (0, "")}

    def inserted(states):
        for _ in range(3):
            for state, (cost, text) in list(states.items()):
                new = after(state, "I", "")
                if new not in states or (cost + 5, text + "I") < states[new]:
                    states[new] = (cost + 5, text + "I")
        return states

    for initial, fault in rows:
        nxt = {}
        for state, (cost, text) in inserted(now).items():
            for letter in "D" if fault in ("blank", "duplicate") else "KRD":
                new = state if letter == "D" else after(state, letter, initial)
                if letter == "D" or allowed(state, new):
                    key = (cost + cost_of(letter, fault), text + letter)
                    if new not in nxt or key < nxt[new]:
                        nxt[new] = key
        now = nxt
    return min(v for s, v in inserted(now).items() if s in ("", "a"))


def streamed(rows):
    line, out = cr.Survivors(), ""
    for initial, fault in rows:
        out += "".join(x[2] for x in line.step(cr.row_moves(initial, fault), None, (initial, fault)))
    end = line.best_end()
    out += "".join(x[2] for x in line.finish(end)) + "I" * cr.CLOSE[end]
    return line.spent + line.costs[end] + 5 * cr.CLOSE[end], out


def test_viterbi_equals_exhaustive_search():
    rng = random.Random(1)
    cases = [[]] + [[(i, f)] for i in "suax" for f in FAULTS]
    cases += [[(rng.choice("suaax"), rng.choice(FAULTS + (None, None))) for _ in range(n)]
              for n in (2, 3) for _ in range(60)]
    for rows in cases:
        assert streamed(rows) == plain(rows) == exhaustive(rows), rows


def test_viterbi_equals_plain_programming_on_long_rows():
    rng = random.Random(2)
    for n in (5, 20, 60):
        for weights in ((1, 1, 1, 1), (0, 9, 9, 1), (0, 1, 0, 0), (9, 1, 1, 0), (0, 0, 5, 1)):
            for faults in ((None,), FAULTS, ("truncated", None), ("blank", "truncated")):
                rows = [(rng.choices("suax", weights)[0], rng.choice(faults)) for _ in range(n)]
                assert streamed(rows) == plain(rows), rows


def test_resolved_edits_leave_memory():
    line, most = cr.Survivors(), 0
    for i in range(20_000):
        line.step(cr.row_moves("ua"[i % 2], None), i, "ua"[i % 2])
        most = max(most, len(line.finish(line.best_end())))
    assert most < 10


def want(rows):
    """The contract on plain rows: {conv_id: digest}."""
    out = {}
    damaged = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, None)
        def s(v):
            return " " if v is None else str(v)
        how = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        damaged.setdefault(conv, []).extend([(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1))
    for conv in out:
        seen, kinds, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        own = sorted(damaged.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        for turn, role, text in own:
            left = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not left else "duplicate" if (role, text) in seen
                     else "truncated" if left[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                kinds[fault] += 1
            marked.append((role[:1], fault))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit = plain(marked)
        kept, state, i = [], "", 0
        for letter in audit:
            if letter == "I":
                state = after(state, "I", "")
                kept.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = own[i]
            i += 1
            if letter != "D":
                state = after(state, letter, role[:1])
                if letter == "R":
                    role = {"u": "user", "a": "assistant"}[state]
                kept.append(role + ":" + text)
        out[conv] = (gaps, *kinds.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, segment string, pos int"


def test_query_on_given_table(spark):
    from regstat.llm.catalog import queries

    rows = table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert got(queries()["op13_conversation_repair"](spark, SF_SMALL)) == want([tuple(r) for r in rows])


@pytest.mark.parametrize("segment_rows", [cr.SEGMENT_ROWS, 7])
def test_edges_and_segments(spark, segment_rows):
    rng = random.Random(3)
    rows = [(1, None, "user", None), (1, 3, None, "x."), (1, 3, "", "é?"), (None, None, None, None), (None, 2, "user", "a."),
            (2, 1, "user", "long " * 30_000), (2, 2, "assistant", "\t\n "), (3, 5, "system", "s."), (3, 5, "system", "s."),
            (4, 1, "user", "q?"), (4, 1, "assistant", "r!"), (4, 1, "user", "q?")]
    rows += [(9, rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool"]),
              rng.choice(["a.", "b", "c!", "d?", "", "e.", f"x{k}."])) for k in range(150)]
    rows += [(8, k, rng.choice(["user", "assistant"]), f"t{k}.") for k in range(60)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)
    assert got(cr.audit_conversations(df, segment_rows)) == want(rows)


def test_empty(spark):
    assert cr.audit_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repair_gives_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "user", "c.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = sorted(cr.repair(df).collect(), key=lambda r: r.pos)
    assert "".join(r.edit for r in edits) == "RRD" or "".join(r.edit for r in edits) == plain([("a", None), ("u", None), ("u", None)])[1]
    kept = [(r.new_role, r.text) for r in edits if r.new_role]
    assert SHAPE.fullmatch("".join(r[0][0] for r in kept))
