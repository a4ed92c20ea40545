import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bootlens.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """(cost, audit, repaired lines) by plain dynamic programming over whole edit strings.

    ``rows``: (role, text, fault).  A state is the initials put out so far, up to what the pattern can tell apart."""
    def step(state, mark):
        if mark == "s":
            return "s" if state == "" else None
        if mark == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if mark == "a" and state == "u" else None

    best = {"": (0, "", [])}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                for mark, role in (("u", "user"), ("a", "assistant")):
                    to = step(state, mark)
                    new = (cost + 3, audit + "I", [*out, f"{role}:"])
                    if to is not None and (to not in best or new < best[to]):
                        best[to] = new
        return best

    for role, text, fault in rows:
        nxt = {}

        def offer(to, new):
            if to is not None and (to not in nxt or new < nxt[to]):
                nxt[to] = new

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            offer(step(state, role[:1]), (cost + more, audit + "K", [*out, f"{role}:{text}"]))
            for mark, name in (("u", "user"), ("a", "assistant")):
                offer(step(state, mark), (cost + 3 + more, audit + "R", [*out, f"{name}:{text}"]))
        best = nxt
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(conversation, damage=True):
    """The contract's row of one conversation: (conv_id, turn, role, text) rows in the order of their turns."""
    rows = []
    for conv, turn, role, text in conversation:
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20 if damage else 5
        role, text = show[2:]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    kinds = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    marks = [r[:1] for _, r, _ in rows]
    cost, audit, out = plain_repair([(r, t, f) for (_, r, t), f in zip(rows, kinds)])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversation(conv, n, seed):
    rng = random.Random(seed)
    turns = sorted(rng.sample(range(3 * n + 1), n))
    return [(conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]),
             rng.choice(["Yes.", "No!", "so what?", "broken off", "", " \t\n", "x" * 30 + ".", "é. "])) for t in turns]


def held(df, conversations, damage=True, **_):
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in (cv.audit(df) if damage else cv.repaired(df)).collect()}
    assert got == {c: plain(rows, damage) for c, rows in conversations.items()}


def by_conversation(rows):
    return {k: list(g) for k, g in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0])}


def test_tables_agree_with_single_rows():
    t = cv.tables()
    rng = np.random.default_rng(0)
    for v in range(len(t.vectors)):
        for _ in range(60):
            rows = rng.integers(0, cv.SYMBOLS, cv.BLOCK)
            vec, states = t.vectors[v], np.arange(4)
            b = int(rows @ (cv.SYMBOLS ** np.arange(cv.BLOCK - 1, -1, -1)))
            steps = [vec]
            for s in rows[::-1]:
                steps.append(cv.before(int(s), steps[-1]))
            assert tuple(x + int(t.add[v, b]) for x in t.vectors[t.to[v, b]]) == steps[-1]
            steps.reverse()
            for q in states:
                state = int(q)
                for i, s in enumerate(rows):
                    state = cv.edits(int(s), steps[i], steps[i + 1], state)[1]
                assert state == t.end[v, b, q]


def symbols(rows, kinds):
    def one(role, fault):
        kind = cv.KINDS.index(role[0]) if role[:1] in ("s", "u", "a") else 3
        return cv.GONE if fault in ("blank", "duplicate") else 1 + kind + len(cv.KINDS) * (fault == "truncated")

    return np.array([one(r, f) for (r, _), f in zip(rows, kinds)], dtype=np.int64)


@pytest.mark.parametrize("seed", range(150))
def test_trace_as_plain(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"text {k}" + rng.choice([".", "", "."])) for k in range(rng.randint(0, 23))]
    kinds = [rng.choice([f, f, f, "blank"]) for f in faults(rows)]
    letters, cost, state = cv.trace(symbols(rows, kinds))
    lines, _ = cv.repair(rows, letters, cv.START, True)
    audit = "".join(letters) + cv.tail(state)
    assert (cost, audit, lines) == plain_repair([(r, t, f) for (r, t), f in zip(rows, kinds)])
    assert LEGAL.fullmatch("".join(x[0] for x in lines))


@pytest.mark.parametrize("seed", range(40))
def test_pieces_compose(seed):
    """Cut anywhere, a conversation's pieces as functions give what the whole gives."""
    rng = np.random.default_rng(seed)
    whole = rng.integers(0, cv.SYMBOLS, 40)
    cuts = sorted(rng.integers(0, 41, 4))
    pieces = np.split(whole, cuts)
    acts, v, behind = [cv.act(p) for p in pieces], 0, []
    for to, _, _ in reversed(acts):
        behind.append(v)
        v = int(to[v])
    behind.reverse()
    letters, state = [], cv.START
    for p, (_, _, end), b in zip(pieces, acts, behind):
        own, _, after = cv.trace(p, b, state)
        assert after == end[b, state]
        letters, state = letters + own, after
    assert (letters, state) == cv.trace(whole)[::2]


def test_audit_as_brute_force(spark):
    convs = {k: conversation(k, 1 + k % 17, k) for k in range(120)}
    df = spark.createDataFrame([r for c in convs.values() for r in c], SCHEMA).repartition(5)
    held(df, convs)


def test_long_conversation_spans_ranges(spark):
    """A conversation that holds most rows is cut into many ranges and still is one sequence."""
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["ok.", f"step {t}", f"step {t}."]) * rng.randint(1, 3)) for t in range(6000)]
    convs = {7: rows, 8: conversation(8, 12, 8), 9: conversation(9, 12, 9)}
    df = spark.createDataFrame([r for c in convs.values() for r in c], SCHEMA).repartition(4)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    slice_, cv.SLICE = cv.SLICE, 500
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        held(df, convs)
    finally:
        cv.SLICE = slice_
        for k, v in was.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    convs = {1: [(1, None, None, None), (1, 3, None, "x."), (1, 9, "", "")], 2: [(2, 1, "user", "a.")] * 3 + [(2, 2, "assistant", "b.")] * 2,
             None: [(None, None, "user", "Hi."), (None, 4, "assistant", "中文. "), (None, 5, "assistant", "y" * 200_000)],
             4: [(4, 1, "system", "s."), (4, 2, "system", "s."), (4, 3, "user", "!\n")], 5: [(5, None, "user", None)]}
    df = spark.createDataFrame([r for c in convs.values() for r in c], SCHEMA).repartition(3)
    for name in ("key", "at", "range", "code", "copy", "state", "begins", "audit", "fault", "symbol", "initial"):
        df = df.withColumn(name, F.lit("x"))
    held(df, convs)
    held(df, convs, damage=False)


def test_all_rows_dropped_and_empty(spark):
    gone = [(c, t) for c in range(400) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(c, t, "user", "a.") for c, t in gone], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, cv.audit(df).collect())) == sorted((c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in gone)
    assert cv.audit(spark.createDataFrame([], SCHEMA)).collect() == []
